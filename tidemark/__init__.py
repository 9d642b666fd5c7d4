"""Tidemark: named, versioned databases of typed tables, queried with Spark SQL."""
