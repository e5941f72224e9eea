"""Catalog analytics as Spark DataFrame operators."""
