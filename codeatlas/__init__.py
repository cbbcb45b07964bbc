"""codeatlas: a PySpark engine for linked data as a property graph."""
