"""Privacy analytics over text at scale, on PySpark DataFrames."""
