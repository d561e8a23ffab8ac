"""Market-data, trade-lifecycle and corpus analytics as PySpark DataFrame transformations."""
