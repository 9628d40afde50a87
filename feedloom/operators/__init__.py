"""Relational operators over feeds, catalogs and imports."""
