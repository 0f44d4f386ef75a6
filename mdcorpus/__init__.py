"""Spark jobs over collections of markdown documentation trees."""
