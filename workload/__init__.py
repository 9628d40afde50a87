"""Feeds, catalogs and imports derived from the test tables, and the registered queries over them."""
