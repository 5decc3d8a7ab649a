"""Spark jobs over catalogs of schema documents, their graphs, and the text around them."""
