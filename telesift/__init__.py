"""Caption analytics and ingest for PySpark."""
