"""A PySpark engine that assigns reads to taxa from homology hits and aggregates them into profiles."""
