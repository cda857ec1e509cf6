"""Code-graph and package-registry analytics expressed as PySpark DataFrame jobs."""
