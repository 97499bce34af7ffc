"""Uploads: a recursive scan of files, ordered checks, kinds; names for what is written."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.units import file_kind

#: Bounds of an office package and its required parts.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 2_000, 500_000_000, 200
PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` as (path, name, length, content), but for dot files and ``~$`` locks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(~F.col("name").rlike(r"^(\.|~\$)")).select("path", "name", "length", "content")


def package_fault(content: Column, kind: Column) -> Column:
    """What is wrong with an office package, or null. An Arrow UDF over the standard library's zip reader."""

    def fault(body: bytes | None, kind: str | None) -> str | None:
        try:
            entries = zipfile.ZipFile(io.BytesIO(body or b"")).infolist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return "not_a_package"
        packed, full = sum(e.compress_size for e in entries), sum(e.file_size for e in entries)
        if len(entries) > MOST_ENTRIES or full > MOST_BYTES or full > MOST_RATIO * max(1, packed):
            return "package_too_large"
        return None if PARTS.get(kind or "") in {e.filename for e in entries} else "missing_part"

    @F.pandas_udf("string")
    def run(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([fault(b, k) for b, k in zip(bodies, kinds, strict=True)], dtype=object)

    return run(content, kind)


def checked(files: DataFrame, most: int = 25_000_000) -> DataFrame:
    """Files with ``kind`` and the first ``error`` of: empty, too_large, unsupported, invalid; null if sound."""
    kind = file_kind(F.col("name"))
    magic = F.hex(F.substring("content", 1, 4))
    rows = files.withColumn("kind", kind).withColumn("bytes", F.coalesce(F.octet_length("content"), F.lit(0)))
    early = (
        F.when(F.col("bytes") == 0, "empty")
        .when(F.col("bytes") > most, "too_large")
        .when(F.col("kind").isNull(), "unsupported")
        .when((F.col("kind") == "pdf") & (magic != "25504446"), "invalid")
        .when((F.col("kind") != "pdf") & (magic != "504B0304"), "invalid")
    )
    rows = rows.withColumn("error", early)
    office = F.col("error").isNull() & F.col("kind").isin("docx", "xlsx")
    body = F.when(office, F.col("content"))  # the reader sees nothing of files that failed before
    return rows.withColumn("fault", package_fault(body, F.col("kind"))).withColumn("error", F.coalesce("error", F.when(office & F.col("fault").isNotNull(), "invalid"))).drop("fault", "bytes")


def safe_name(stem: Column) -> Column:
    """A file name part: ``< >`` dropped, other odd runs become ``_``, no edge ``._-``, at most 80 characters."""
    plain = F.regexp_replace(F.regexp_replace(stem, "[<>]", ""), r"[^A-Za-z0-9_.-]+", "_")
    out = F.substring(F.regexp_replace(plain, r"^[._-]+|[._-]+$", ""), 1, 80)
    return F.when(out == "", "document").otherwise(out)


def batch_manifest(results: DataFrame) -> DataFrame:
    """Status of each file and a free output name: later files of the same name get ``_2``, ``_3``, ..."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("out").orderBy("path"))
    status = F.when(F.col("error") == "too_large", "SKIPPED_TOO_LARGE").when(F.col("error").isNotNull(), "FAILED").when(F.col("status") == "approved", "OK").otherwise("NEEDS_REVIEW")
    named = results.withColumn("out", safe_name(F.regexp_replace("name", r"\.[^.]*$", ""))).withColumn("nth", nth)
    return named.select("path", status.alias("status"), F.concat("out", F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth"))).otherwise("")).alias("out_name"))
