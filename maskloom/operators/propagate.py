"""Variants of masked values elsewhere in the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import PLACEHOLDER, projected
from maskloom.functions.spans import OPEN, disjoint, let, regex_spans
from maskloom.operators.lists import not_contained
from maskloom.operators.mask import masked_units, value_key
from maskloom.operators.types import family_of, flag_of

#: Least projected length of a needle by how it was made (fixed values).
LEAST = {"any": 8, "glued": 8, "surname": 4, "company": 8}
PREFIX = (8, 24)


def needles(spans: DataFrame) -> DataFrame:
    """(doc_id, mode, family, needle) of resolved spans (doc_id, unit_id, start, value, entity_type).

    Structural types as they are (any), names of several words run together (glued), their last
    word of four letters or more (surname), and prefixes of company names from each word on.
    """
    rows = spans.select("doc_id", "entity_type", "value", "start", family_of(F.col("entity_type")).alias("family"))
    person = rows.where("entity_type in ('PERSON', 'TR_PERSON_CTX')").where(F.size(F.split(F.trim("value"), r"\s+")) > 1)
    company = rows.where("entity_type = 'TR_COMPANY'")
    words = F.split(F.trim("value"), r"\s+")
    parts = [
        rows.where(flag_of(F.col("entity_type"), "adjacency_safe")).select("doc_id", F.lit("any").alias("mode"), "family", "start", F.col("value").alias("raw")),
        person.select("doc_id", F.lit("glued").alias("mode"), "family", "start", F.col("value").alias("raw")),
        person.select("doc_id", F.lit("surname").alias("mode"), "family", "start", F.element_at(words, -1).alias("raw")),
        company.select("doc_id", F.lit("company").alias("mode"), "family", "start", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("raw")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("needle", projected(F.col("raw"))["proj"])
    lengths = F.sequence(F.lit(PREFIX[0]), F.greatest(F.lit(PREFIX[0]), F.least(F.lit(PREFIX[1]), F.char_length("needle"))))
    prefixes = F.transform(lengths, lambda n: F.substr(F.col("needle"), F.lit(1), n))
    out = out.withColumn("needle", F.explode(F.when(F.col("mode") == "company", prefixes).otherwise(F.array("needle"))))
    least = F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])
    out = out.where(F.char_length("needle") >= F.element_at(least, F.col("mode")))
    return out.groupBy("doc_id", "mode", "needle").agg(F.max_by("family", "start").alias("family"), F.min("start").alias("first_at"))


def variants(units: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """Disjoint hits (doc_id, unit_id, start, end, value, family, mode) of needles in the units of their document.

    Units are compared without case, marks and white space. glued and surname hits hold no white
    space; company and surname hits start with a capital and stand alone; hits in placeholders do not
    count. Needles of a document come to its units as one array, so units are not multiplied by them,
    and each needle is found in one pass over the unit.
    """
    pool = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("needle", "mode", "family")).alias("pool"))
    rows = units.join(pool, "doc_id").withColumn("p", projected(F.col(text_col)))
    held = F.filter("pool", lambda n: F.contains(F.col("p.proj"), n["needle"]))
    rows = rows.withColumn("n", F.explode(held))
    rows = rows.withColumn("i", F.explode(starts_of(F.col("p.proj"), F.col("n.needle"))))
    start = F.element_at("p.at", F.col("i"))
    end = F.element_at("p.at", F.col("i") + F.char_length("n.needle") - 1) + 1
    hits = rows.select("doc_id", "unit_id", text_col, "n.mode", "n.family", start.alias("start"), end.alias("end"))
    hits = hits.withColumn("value", F.substr(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")))
    left = F.substr(F.col(text_col), F.col("start"), F.lit(1))
    right = F.substr(F.col(text_col), F.col("end") + 1, F.lit(1))
    spaceless = ~F.col("value").rlike(r"\s")
    alone = F.col("value").rlike(r"^\p{Lu}") & ~(left.rlike(r"\p{L}") & (F.col("start") > 0)) & ~right.rlike(r"\p{L}")
    good = F.when(F.col("mode") == "glued", spaceless).when(F.col("mode") == "surname", spaceless & alone).when(F.col("mode") == "company", alone).otherwise(True)
    holders = regex_spans(F.col(text_col), PLACEHOLDER)
    free = ~F.exists(holders, lambda h: (h["start"] < F.col("end")) & (F.col("start") < h["end"]))
    hits = hits.where(good & free)
    by_unit = hits.groupBy("doc_id", "unit_id").agg(F.collect_set(F.struct("start", "end", "value", "family", "mode")).alias("all"))
    return by_unit.select("doc_id", "unit_id", F.explode(disjoint(F.col("all"))).alias("h")).select("doc_id", "unit_id", "h.*")


def starts_of(text: Column, needle: Column) -> Column:
    """Places (from 1) at which ``needle`` begins, overlapping ones too: marked in one pass, then summed up."""
    marked = F.regexp_replace(text, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")), F.lit(OPEN))
    step = lambda acc, x: F.struct((acc["at"] + F.char_length(x)).alias("at"), F.array_append(acc["out"], acc["at"] + F.char_length(x)).alias("out"))
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    return let(F.split(marked, OPEN, -1), lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), first, step, lambda acc: acc["out"]))


def applied(units: DataFrame, hits: DataFrame, tokens: DataFrame, keeps: DataFrame | None = None, text_col: str = "masked_text") -> DataFrame:
    """Units (doc_id, unit_id, text) with the hits of ``variants`` in them masked too, but for those inside ``keeps``.

    A spelling whose key has a token in the document gets that token; others are numbered on after the
    family's last, by where they first stand. ``tokens``: (doc_id, family, value_key, n, token).
    """
    doc, by = "doc_id", ["doc_id", "family"]
    if keeps is not None:
        hits = not_contained(hits, keeps, (doc, "unit_id"))
    known = tokens.select(*by, "value_key", "n", "token").distinct()
    last = tokens.groupBy(*by).agg(F.max("n").alias("last"))
    keyed = hits.select(doc, "unit_id", "start", "end", "family", value_key(F.col("value")).alias("value_key"))
    met = keyed.join(known, [*by, "value_key"], "left").join(last, by, "left")
    first = F.min(F.struct("unit_id", "start")).over(Window.partitionBy(*by, "value_key"))
    new = met.where("token is null").withColumn("first", first)
    n = F.coalesce("last", F.lit(0)) + F.dense_rank().over(Window.partitionBy(*by).orderBy("first", "value_key"))
    new = new.withColumn("token", F.concat(F.lit("<"), "family", F.lit("_"), n, F.lit(">")))
    columns = [doc, "unit_id", "start", "end", "token"]
    every = met.where("token is not null").select(*columns).unionByName(new.select(*columns))
    return masked_units(units.select(doc, "unit_id", F.col(text_col).alias("text")), every, (doc, "unit_id")).select(doc, "unit_id", "masked_text", "n_masked")


def first_seen(found: DataFrame) -> DataFrame:
    """Variants by document, family and value with the place they first stand at."""
    place = Window.partitionBy("doc_id", "family", "value").orderBy("unit_id", "start")
    return found.withColumn("nth", F.row_number().over(place)).where("nth = 1").drop("nth")
