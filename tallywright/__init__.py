"""Income-document screening as Spark DataFrame transformations."""
