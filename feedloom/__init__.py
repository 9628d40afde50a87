"""Supplier CSV feeds into product catalogs, as Spark DataFrame jobs."""
