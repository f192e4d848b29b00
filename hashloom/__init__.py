"""Hash-partitioned join analytics on PySpark DataFrames."""
