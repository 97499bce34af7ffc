"""Documents, blocks and cells as ordered text units; plain text and dense rows back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_LIMIT = 50_000


def file_kind(name: Column) -> Column:
    """pdf, docx or xlsx by the lower-cased suffix, else null."""
    ending = F.regexp_extract(F.lower(name), r"\.(pdf|docx|xlsx)$", 1)
    return F.when(ending != "", ending)


def explode_units(blocks: DataFrame) -> DataFrame:
    """(doc_id, unit_ord, unit_id, text) of blocks (doc_id, ord, block_id, text, cells?).

    A cell's id is ``<block>:r<row>c<col>``; repeated ids get ``#2``, ``#3`` in order.
    """
    has_cells = "cells" in blocks.columns
    cells = F.col("cells") if has_cells else F.lit(None).cast("array<struct<row:int,col:int,text:string>>")
    parts = F.when(F.size(cells) > 0, F.transform(cells, lambda c: F.struct(F.concat(F.col("block_id"), F.lit(":r"), c["row"], F.lit("c"), c["col"]).alias("base"), c["text"].alias("text")))).otherwise(
        F.array(F.struct(F.col("block_id").alias("base"), F.col("text").alias("text")))
    )
    rows = blocks.select("doc_id", "ord", F.posexplode(parts).alias("part", "u")).select("doc_id", "ord", "part", "u.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ord", "part"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "part"))
    unit_id = F.concat("base", F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth"))).otherwise(""))
    return rows.withColumn("nth", nth).select("doc_id", place.alias("unit_ord"), unit_id.alias("unit_id"), "text")


def lines_as_units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every line of a document that is not blank as a unit (doc_id, line, text)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    return lines.where(F.trim("text") != "")


def plain_rows(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_id")) -> DataFrame:
    """Rows of sparse cells as lines: cells by column joined with `` | ``, rows in order; the first 50,000 cells.

    Works on (keys, row, col, text); returns (keys, text).
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col"))
    first = cells.withColumn("nth", nth).where(F.col("nth") <= CELL_LIMIT)
    lines = first.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cells"))
    lines = lines.withColumn("line", F.array_join(F.transform("cells", lambda c: c["text"]), " | "))
    by_row = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    return by_row.select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def dense_rows(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_id")) -> DataFrame:
    """Rows (keys, row, values): one value for each column up to the block's last, "" where there is no cell.

    Of repeated cells the last by ``ord`` counts.
    """
    width = cells.groupBy(*keys).agg(F.max("col").alias("last"))
    rows = cells.groupBy(*keys, "row", "col").agg(F.max_by("text", "ord").alias("text")).groupBy(*keys, "row")
    rows = rows.agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col")).join(width, list(keys))
    values = F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")))
    return rows.select(*keys, "row", values.alias("values"))


def language_rule(chars: Column, tr: Column, en: Column) -> Column:
    """unknown under 12 characters; mixed if both are .25 or more; else the likelier of tr and en; else unknown."""
    return (
        F.when(chars < 12, "unknown")
        .when((tr >= 0.25) & (en >= 0.25), "mixed")
        .when((tr > en) & (tr > 1 - tr - en), "tr")
        .when((en > tr) & (en > 1 - tr - en), "en")
        .otherwise("unknown")
    )


def language_rollup(blocks: DataFrame, key: str, lang_col: str = "lang", a: str = "tr", b: str = "en", fallback: str = "unknown") -> DataFrame:
    """One language for each key: any mixed block, or both languages, make it mixed."""
    lang = F.col(lang_col)
    has = lambda v: F.coalesce(F.bool_or(lang == v), F.lit(False))
    return blocks.groupBy(key).agg(
        F.when(has("mixed") | (has(a) & has(b)), "mixed").when(has(a), a).when(has(b), b).otherwise(fallback).alias("language")
    )


def blocking_reasons(warnings: Column, text: Column, prefixes: dict[str, str]) -> Column:
    """Reasons from warning prefixes, and ``no_text`` for blank text."""
    starts = lambda p: F.exists(warnings, lambda w: w.startswith(p))
    found = [F.when(starts(p), F.lit(reason)) for p, reason in prefixes.items()]
    return F.array_compact(F.array(*found, F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("no_text"))))
