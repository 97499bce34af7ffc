"""Values that table cells cut apart: runs of clean cells, and spans that stop at a cell's edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.detect import found_in
from maskloom.operators.types import flag_of

ROW = ("doc_id", "block_id", "row")


def run_merges(cells: DataFrame) -> DataFrame:
    """Spans over two or more clean neighbouring cells of a row, as (doc, block, row, col, token cell, ...).

    ``cells`` has (doc_id, block_id, row, col, text). Cells without a hit of their own are clean, blank
    ones too; neighbours are neighbours in column order. A run is joined without a separator and
    searched again; adjacency-safe spans that cross an edge count. One row for each cell touched:
    ``first`` marks the one that carries the token, the others become empty.
    """
    clean = F.size(F.coalesce(found_in(F.col("text")), F.array())) == 0
    order = Window.partitionBy(*ROW).orderBy("col")
    marked = cells.withColumn("clean", clean).withColumn("nth", F.row_number().over(order))
    run = F.col("nth") - F.row_number().over(Window.partitionBy(*ROW, "clean").orderBy("col"))
    runs = marked.withColumn("run", run).where("clean")
    whole = runs.groupBy(*ROW, "run").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("cells")).where(F.size("cells") > 1)
    whole = whole.withColumn("joined", F.array_join(F.transform("cells", lambda c: c["text"]), ""))
    hits = whole.select(*ROW, "run", "cells", F.explode(found_in(F.col("joined"))).alias("s")).where(flag_of(F.col("s.entity_type"), "adjacency_safe"))
    ends = F.transform("cells", lambda c, i: F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.char_length(x["text"])))
    parts = hits.withColumn("ends", ends).select(*ROW, "s", F.posexplode("cells").alias("i", "c"), "ends")
    stop = F.element_at("ends", F.col("i") + 1)
    start = stop - F.char_length("c.text")
    touched = parts.where((F.col("s.start") < stop) & (start < F.col("s.end")))
    n = F.count("*").over(Window.partitionBy(*ROW, "s"))
    first = F.row_number().over(Window.partitionBy(*ROW, "s").orderBy("i")) == 1
    out = touched.withColumn("n", n).withColumn("first", first).where("n > 1")
    return out.select(*ROW, F.col("c.col").alias("col"), "s.entity_type", F.col("s.value").alias("value"), F.greatest(F.col("s.start") - start, F.lit(0)).alias("start"), F.least(F.col("s.end") - start, F.char_length("c.text")).alias("end"), "first")


def edge_extensions(cells: DataFrame) -> DataFrame:
    """A cell's only safe span, ending where the cell ends, that goes on in the next clean cell."""
    order = Window.partitionBy(*ROW).orderBy("col")
    hits = cells.withColumn("hits", F.coalesce(found_in(F.col("text")), F.array()))
    ahead = hits.withColumn("next", F.lead("text").over(order)).withColumn("next_col", F.lead("col").over(order)).withColumn("next_hits", F.lead("hits").over(order))
    one = ahead.where((F.size("hits") == 1) & (F.size("next_hits") == 0) & F.col("next").isNotNull() & (F.col("next") != "")).withColumn("s", F.get("hits", F.lit(0)))
    one = one.where((F.col("s.end") == F.char_length("text")) & flag_of(F.col("s.entity_type"), "adjacency_safe"))
    again = one.withColumn("t", F.explode(found_in(F.concat("text", "next"))))
    again = again.where((F.col("t.entity_type") == F.col("s.entity_type")) & (F.col("t.start") == F.col("s.start")) & (F.col("t.end") > F.col("s.end")))
    return again.select(*ROW, "col", "next_col", "s.entity_type", "t.value", F.col("s.start").alias("start"), (F.col("t.end") - F.char_length("text")).alias("next_end"))
