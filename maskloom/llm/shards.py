"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.store import saved, shuffle_partitions


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in order of id, into ``n_shards`` contiguous shards of near-equal bytes.

    Size is the UTF-8 length of the text plus one. Rows are range-partitioned on (id, size, crc32)
    and the partition number is frozen by writing the narrow table; each partition's total goes to
    the driver (one row a partition), prefix sums come back as a broadcast of that size, and a
    running sum inside each partition completes the global prefix. A document belongs to the shard
    that holds its middle byte, so a shard misses its equal target by at most about one document.

    Only (id, size, crc32) is shuffled, never the text. Null text: size 1, crc32 of the empty
    string. Null ids sort first. Rows equal in all three columns are interchangeable. An empty table
    gives an empty result; extra columns are ignored.

    Returns id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc"),
    )
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("crc")]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    placed = saved(placed, "shard-sizes")

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()
    starts, at_byte, at_row = [], 0, 0
    for t in totals:
        starts.append((t["part"], at_byte, at_row))
        at_byte, at_row = at_byte + t["bytes"], at_row + t["n"]
    offsets = spark.createDataFrame(starts, "part int, byte0 long, row0 long")

    inside = Window.partitionBy("part").orderBy(*order)
    cut = (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("upto", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.col("row0") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * upto - size) * {n_shards}) div {max(1, 2 * at_byte)}) as int)"))
    )
    first = cut.groupBy("shard").agg(F.min("row").alias("row_first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("row_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
