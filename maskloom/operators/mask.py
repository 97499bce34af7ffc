"""Masking: placeholder numbers, splicing, edits and their offset maps, counters, the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import PLACEHOLDER, collapsed
from maskloom.functions.spans import merged, overlaps, resolved, spliced, within
from maskloom.operators.detect import prioritised
from maskloom.operators.types import family_of


def resolve(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of each unit by the greedy rule (see ``functions.spans.resolved``)."""
    per_unit = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "entity_type", "score", "source")).alias("all"))
    out = per_unit.select(*keys, F.explode(resolved(prioritised(F.col("all")))).alias("s"))
    return out.select(*keys, "s.start", "s.end", "s.entity_type", "s.score", "s.source")


def value_key(value: Column) -> Column:
    """Two spellings with one key share a placeholder: white space collapsed, case ignored."""
    return F.lower(collapsed(value))


def numbered(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ("start",)) -> DataFrame:
    """Spans with family, n and token: ``<FAMILY_n>``, n by first occurrence in the document and family."""
    doc = keys[0]
    with_key = spans.withColumn("family", family_of(F.col("entity_type"))).withColumn("value_key", value_key(F.col("value")))
    place = F.struct(*[F.col(c) for c in (*keys[1:], *order)])
    first = F.min(place).over(Window.partitionBy(doc, "family", "value_key"))
    n = F.dense_rank().over(Window.partitionBy(doc, "family").orderBy("first_at", "value_key"))
    out = with_key.withColumn("first_at", first).withColumn("n", n).drop("first_at")
    return out.withColumn("token", F.concat(F.lit("<"), "family", F.lit("_"), "n", F.lit(">")))


def masked_units(units: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Units with ``masked_text`` and ``n_masked``; tokens are disjoint (keys, start, end, token)."""
    edits = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("edits"))
    both = units.join(edits, list(keys), "left")
    masked = F.when(F.col("edits").isNull(), F.col(text_col)).otherwise(spliced(F.col(text_col), F.col("edits")))
    return both.withColumn("masked_text", masked).withColumn("n_masked", F.coalesce(F.size("edits"), F.lit(0))).drop("edits")


def edits(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens with masked_start and masked_end: the original start moved by all length changes before it."""
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    change = F.char_length("token") - (F.col("end") - F.col("start"))
    moved = F.coalesce(F.sum(change).over(before), F.lit(0))
    out = tokens.withColumn("masked_start", (F.col("start") + moved).cast("long"))
    return out.withColumn("masked_end", F.col("masked_start") + F.char_length("token"))


def latest(value: Column) -> Column:
    """The last value that is not null."""
    return F.last(value, ignorenulls=True)


def as_of(rows: DataFrame, at: str, marks: DataFrame, mark_at: str, value: Column, how: Callable[[Column], Column], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with ``as_of``: ``how`` (an aggregate without nulls) over the marks of their unit that stand at or before them.

    Rows and marks of a unit pass in order through one running window, so that no pairs are made.
    """
    known = marks
    for k in keys:  # null keys are nobody's; said so that the marks' plan stays one that is reused
        known = known.where(F.col(k).isNotNull())
    known = known.select(*keys, F.col(mark_at).alias("__at"), F.lit(False).alias("__row"), value.alias("__value"))
    both = rows.withColumn("__at", F.col(at)).withColumn("__row", F.lit(True)).unionByName(known, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("as_of", how(F.col("__value")).over(so_far)).where("__row").drop("__at", "__row", "__value")


def original_offset(points: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As-of join: masked positions (keys, pos) with the original position, moved by the last edit that ends there or before."""
    moved = as_of(points.select(*keys, "pos").distinct(), "pos", done, "masked_end", F.col("end") - F.col("masked_end"), latest, keys)
    return moved.select(*keys, "pos", (F.col("pos") + F.coalesce("as_of", F.lit(0))).alias("original_pos"))


def family_counts(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Highest n and number of edits of each family and document."""
    return tokens.groupBy(doc, "family").agg(F.max("n").alias("placeholders"), F.count("*").alias("edits"))


def source_counts(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Edits by document and the stage that found them."""
    return tokens.groupBy(doc, "source").agg(F.count("*").alias("n"))


def forced_ranges(mask: Column, keep: Column) -> Column:
    """Reviewer masks: the union of ranges that overlap, less those inside a keep range."""
    return F.filter(merged(mask), lambda r: ~within(r, keep))


def kept_in_current(keeps: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keep ranges that no edit touches, with the offsets they have in the masked text."""
    same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    touched, before = overlaps(F.col("k.start"), F.col("k.end"), F.col("e.start"), F.col("e.end")), F.col("e.end") <= F.col("k.start")
    for c in same("k", "e"):
        touched, before = touched & c, before & c
    free = keeps.alias("k").join(done.alias("e"), touched, "left_anti")
    shift = F.coalesce(F.max_by(F.col("e.masked_end") - F.col("e.end"), F.col("e.end")), F.lit(0))
    by = [*[F.col(f"k.{k}").alias(k) for k in keys], F.col("k.start").alias("start"), F.col("k.end").alias("end")]
    return free.alias("k").join(done.alias("e"), before, "left").groupBy(*by).agg(shift.alias("__by")).select(*keys, (F.col("start") + F.col("__by")).alias("start"), (F.col("end") + F.col("__by")).alias("end"))


def absorbed(current: Column, done: Column, start: Column, end: Column, token: Column) -> Column:
    """Edits after ``current[start:end)`` has become ``token``: those it meets become one edit with it.

    ``done``: array<struct<start, end, masked_start, masked_end, token>> of disjoint edits whose result is
    ``current``. The new edit's token is what then stands where the edits and the range stood, so that
    splicing the original with the returned edits (start, end, token, by start) gives the same text.
    """
    original = lambda at, side: at + F.aggregate(F.filter(done, lambda e: e[f"masked_{side}"] <= at), F.lit(0), lambda _, e: (e["end"] - e["masked_end"]).cast("int"))
    meets = lambda e: overlaps(e["masked_start"], e["masked_end"], start, end)
    hit = F.filter(done, meets)
    low = F.least(start, F.array_min(F.transform(hit, lambda e: e["masked_start"].cast("int"))))
    high = F.greatest(end, F.array_max(F.transform(hit, lambda e: e["masked_end"].cast("int"))))
    text = F.concat(F.substr(current, low + 1, start - low), token, F.substr(current, end + 1, high - end))
    # where a bound lies inside an edit, that edit's own bound is the original's
    first = F.coalesce(F.array_min(F.transform(F.filter(hit, lambda e: e["masked_start"] <= start), lambda e: e["start"])), original(start, "end"))
    last = F.coalesce(F.array_max(F.transform(F.filter(hit, lambda e: e["masked_end"] >= end), lambda e: e["end"])), original(end, "end"))
    one = F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"), text.alias("token"))
    others = F.transform(F.filter(done, lambda e: ~meets(e)), lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["token"].alias("token")))
    return F.array_sort(F.array_append(others, one))


def mapping(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Restricted table (document, token, value): the first spelling of each token."""
    return tokens.groupBy(doc, "token").agg(F.min_by("value", "start").alias("value"))


def unmasked(units: DataFrame, table: DataFrame, doc: str = "doc_id", text_col: str = "masked_text") -> DataFrame:
    """Units with every token put back (``restored``) and the tokens that the mapping does not have (``unmapped``)."""
    by_doc = table.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("values"))
    both = units.join(by_doc, doc, "left")
    found = F.regexp_extract_all(F.col(text_col), F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(F.col(text_col), PLACEHOLDER, -1)
    value = lambda t: F.coalesce(F.try_element_at("values", t), t)
    back = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform(found, value), F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")
    missing = F.filter(F.array_distinct(found), lambda t: F.try_element_at("values", t).isNull())
    return both.withColumn("restored", back).withColumn("unmapped", missing).drop("values")
