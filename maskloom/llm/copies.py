"""Exact copies set aside without shuffling the texts of documents that have none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskloom.llm.sketch import bitmap, flagged
from maskloom.llm.store import saved, prepare
from maskloom.llm.words import tidy


def filtered(batches: Iterator[pa.RecordBatch], bits: np.ndarray, column: str, want: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = flagged(bits, batch.column(column)) == want
        if keep.any():
            yield batch if keep.all() else batch.filter(pa.array(keep))


class Distinct:
    """One row for each different text: the one with the smallest id.

    ``docs`` has (id, text); rows with a null id must be left out. ``key`` is a 64-bit hash that only
    steers rows; groups are formed on a 128-bit digest. A bitmap of the keys that repeat, of bounded
    size, tells most rows at the scan that they have no copy. The rest go through a join with their
    group's smallest id. A fuller bitmap sends more rows that way and changes no result. A column
    ``rest`` is carried along if there is one.
    """

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        text = F.coalesce(F.col("text"), F.lit(""))
        self.carried = ["rest"] if "rest" in docs.columns else []
        self.docs = docs.select("id", text.alias("text"), *self.carried).withColumn("key", F.xxhash64("text"))
        digest = F.md5("text")
        groups = self.docs.select("id", "key", digest.alias("digest")).groupBy("digest", "key")
        groups = saved(groups.agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1"), "copy-groups")
        self.groups = groups
        self.n_groups = groups.count()
        self.bits = bitmap(groups, "key", self.n_groups)
        bits = self.bits
        some = self.docs.mapInArrow(lambda it: filtered(it, bits.value, "key", True), self.docs.schema).withColumn("digest", F.md5("text"))
        grouped = some.join(groups.select("digest", "first_id"), "digest", "left")
        is_first = F.col("first_id").isNull() | (F.col("id") == F.col("first_id"))
        self.firsts = saved(grouped.where(is_first).select(*self.docs.columns), "copy-firsts")

    def map(self, fn: Callable, schema: str | StructType) -> DataFrame:
        """``mapInArrow(fn)`` over (id, text, rest, key) of each different text."""
        bits = self.bits
        alone = self.docs.mapInArrow(tidy(lambda it: fn(filtered(it, bits.value, "key", False))), schema)
        return alone.unionByName(self.firsts.mapInArrow(tidy(fn), schema))

    def later(self) -> DataFrame:
        """(id, text, rest, key, first_id) of every row whose text a smaller id has too."""
        bits = self.bits
        some = self.docs.mapInArrow(lambda it: filtered(it, bits.value, "key", True), self.docs.schema)
        some = some.withColumn("digest", F.md5("text"))
        return some.join(self.groups.select("digest", "first_id"), "digest").where("id > first_id").select(*self.docs.columns, "first_id")
