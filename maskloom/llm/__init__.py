"""Training-data operators: deduplication, search, scoring, filtering and sharding of text tables.

Nothing outside this subpackage imports it. Operators take and return DataFrames; intermediate
tables are cut with Parquet files in the shared folder named by ``spark.checkpoint.dir``.
"""
