"""Vector, text and hybrid search analytics on PySpark."""
