"""Schemas of the tables that callers bring."""

FILES = "root string, path string, content string"
QUERIES = "query_id long, root string, topic string, tags array<string>, match string"
PATHS = "root string, path string"
