"""URL rules judged through Bloom filter cascades: exact membership without joins."""

from __future__ import annotations

import math
import string
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter held as bytes, one binary literal of the plan, tested by JVM expressions only."""

    seed: int
    bits: int
    hashes: int
    table: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self.positions(key):
            one = F.substring(F.lit(self.table), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
            byte = F.ascii(F.decode(one, "ISO-8859-1"))  # of one byte, its value
            found = found & (F.getbit(byte, (at % 8).cast("int")) == 1)
        return found


def _bloom(spark: SparkSession, keys: list[str], seed: int, rate: float) -> Bloom:
    bits = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    hashes = min(16, max(1, round(bits / max(1, len(keys)) * math.log(2))))
    empty = Bloom(seed, bits, hashes, b"")
    table = np.zeros(bits, np.uint8)
    if keys:
        rows = spark.createDataFrame([(k,) for k in keys], "key string").select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
        table[rows.toArrow()["at"].to_numpy()] = 1
    return Bloom(seed, bits, hashes, np.packbits(table, bitorder="little").tobytes())


@dataclass(frozen=True)
class Cascade:
    """Levels alternate: listed keys, false positives of the universe, listed keys that pass those, ..."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe and every listed key."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].holds(key), answer).otherwise(F.lit(k % 2 == 1))
        return answer


def build_cascade(universe: DataFrame, listed: Iterable[str], seed: int = 0) -> Cascade:
    """A cascade for ``listed`` that errs for no key in ``universe`` (one string column, ``key``).

    The whole universe is tested against the first level. That level's rate is chosen from the
    universe's size so that about as many false positives come back as there are listed keys; these
    are what later levels work on, so the driver holds a multiple of the rule list, never the corpus.
    """
    spark = universe.sparkSession
    keys = sorted(set(listed))
    size = universe.count()
    rate = min(0.5, max(1e-9, len(keys) / (math.sqrt(2) * max(1, size))))
    levels = [_bloom(spark, keys, seed, rate)]
    named = spark.createDataFrame([(k,) for k in keys], "key string")
    wrong = universe.where(levels[0].holds(F.col("key"))).join(named, "key", "left_anti").distinct()
    ours, theirs = keys, [r["key"] for r in wrong.collect()]
    while theirs:  # encode the side that errs; what then passes wrongly is the next side
        levels.append(_bloom(spark, theirs, seed + len(levels), 0.25))
        passed = spark.createDataFrame([(k,) for k in ours], "key string").where(levels[-1].holds(F.col("key")))
        ours, theirs = theirs, [r["key"] for r in passed.collect()]
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's keys of each (labels, path length) that some rule has, longest first."""
    labels = F.split(host, r"\.")
    keys = [
        F.when(
            (host != "") & (F.size(labels) >= n) & (F.char_length(path) >= m),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, m)),
        )
        for n, m in shapes
    ]
    return F.reverse(F.array_sort(F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key")))))


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict of the longest rule that fits each url.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
    rule's path. The key universe is every (host suffix, path prefix) of the whole corpus that has
    the shape of some rule; one cascade for allowed and one for blocked keys over that universe give
    exact membership, so judging is a scan with neither join nor shuffle. Without a fitting rule the
    verdict is ``default``. Null urls and urls without ``://`` have empty host and path and no rule.
    Every row is kept, repeated ones and null ids too; an empty table gives an empty result. Other
    columns of the table are ignored. The rule list is the caller's and must fit the driver; the plan
    holds its filters as one binary each, a few bits a rule.

    Returns id, host, path, rule, verdict.
    """
    rules = list(dict.fromkeys(rules))
    verdicts = {h + p: v for h, p, v in rules}
    if len(verdicts) < len(rules) or not set(verdicts.values()) <= {"allow", "block"}:
        raise ValueError("rules must have verdicts allow or block, one for a host and path")
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    keyed = parts.withColumn("keys", _keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("keys.key").alias("key")).distinct()
    block = build_cascade(universe, [k for k, v in verdicts.items() if v == "block"], seed=100)
    allow = build_cascade(universe, [k for k, v in verdicts.items() if v == "allow"], seed=200)
    hits = F.transform(
        F.col("keys"),
        lambda k: F.struct(
            k["key"].alias("key"),
            F.when(block.holds(k["key"]), "block").when(allow.holds(k["key"]), "allow").alias("verdict"),
        ),
    )
    best = F.get(F.filter(hits, lambda h: h["verdict"].isNotNull()), 0)
    return keyed.withColumn("best", best).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
