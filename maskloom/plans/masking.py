"""The masking plan: units, spans, resolution, tokens, masked text, audit, route."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.fold import collapsed
from maskloom.functions.spans import let, resolved, spans_in, spliced, unmarked, within
from maskloom.operators import audit, mask
from maskloom.operators.detect import FOUND, found_in, prioritised
from maskloom.operators.recognizers import GENERAL, Recognizer
from maskloom.operators.types import family_of


def resolved_spans(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, external: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Disjoint spans (keys, start, end, value, entity_type, score, source) of each unit.

    Detection and resolution happen inside the row, so nothing is shuffled unless ``external`` spans
    (of a statistical detector) have to be brought in.
    """
    text = F.col(text_col)
    spans = found_in(text, tuple(recognizers))
    rows = units
    if external is not None:
        mine = external.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "value", "entity_type", "score", "source")).alias("__x"))
        rows = units.join(mine, list(keys), "left")
        spans = F.concat(spans, F.coalesce(F.col("__x").cast(f"array<{FOUND}>"), F.array().cast(f"array<{FOUND}>")))
    one = rows.select(*keys, text_col, F.explode(resolved(prioritised(spans))).alias("s"))
    value = F.substr(text, F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return one.select(*keys, "s.start", "s.end", value.alias("value"), "s.entity_type", "s.score", "s.source")


def mask_documents(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, external: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(units with masked_text and n_masked, tokens). Texts are shuffled once, for documents with tokens and without."""
    spans = resolved_spans(units, recognizers, external, keys, text_col)
    tokens = mask.numbered(spans, keys)
    return mask.masked_units(units, tokens, keys, text_col), tokens


def masked_value(text: Column, spans: Column) -> Column:
    """struct<text, n>: the text with its spans resolved, numbered and replaced, all inside the row."""

    def numbered(all_: Column) -> Column:
        value = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])
        return F.transform(all_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), family_of(s["entity_type"]).alias("family"), mask.value_key(value(s)).alias("key")))

    def replaced(keyed: Column) -> Column:
        def token(s: Column) -> Column:
            same = F.array_distinct(F.transform(F.filter(keyed, lambda t: t["family"] == s["family"]), lambda t: t["key"]))
            name = F.concat(F.lit("<"), s["family"], F.lit("_"), F.array_position(same, s["key"]), F.lit(">"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), name.alias("token"))

        done = F.when(F.size(keyed) > 0, let(F.transform(keyed, token), lambda e: spliced(text, e))).otherwise(text)
        return F.struct(done.alias("text"), F.greatest(F.size(keyed), F.lit(0)).alias("n"))

    every = F.coalesce(spans, F.array().cast(f"array<{FOUND}>"))
    return let(let(resolved(prioritised(every)), numbered), replaced)


def masked_rows(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, text_col: str = "text") -> DataFrame:
    """Units with masked_text and n_masked where each unit is a whole document.

    Placeholder numbers need no other row then, so detection, resolution, numbering and splicing all
    stay inside the row: one scan, no shuffle. Same result as ``mask_documents``.
    """
    done = units.withColumn("__m", masked_value(F.col(text_col), found_in(F.col(text_col), recognizers)))
    return done.withColumn("masked_text", F.col("__m.text")).withColumn("n_masked", F.col("__m.n")).drop("__m")


def term_spans(text: Column, terms: Column, suffix: str = "") -> Column:
    """Spans of every place of an array of terms: case ignored, white space any run of it, then ``suffix``."""
    pattern = lambda t: F.concat(F.lit(r"(?iu)\Q"), F.regexp_replace(F.replace(collapsed(t), F.lit(r"\E"), F.lit("")), " ", r"\\E\\s+\\Q"), F.lit(r"\E" + suffix))
    named = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"), F.lit("SENSITIVE").alias("entity_type"), F.lit(1.0).alias("score"), F.lit("deny").alias("source"))
    return F.flatten(F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t: F.transform(spans_in(text, pattern(t)), named)))


def audited_rows(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, rounds: int = 2, text_col: str = "text") -> DataFrame:
    """Units (whole documents) with masked_text, n_masked, residuals (what the last audit still found) and repair_terms.

    Mask, audit, and while hard patterns are left, at most ``rounds`` times: what was found is denied
    from then on, in all its places and with all that earlier rounds found, and the original is masked
    anew. Rounds are expressions of the same row, worked out only where the one before left something:
    one scan, no join, whatever repeats.
    """
    text, recognizers = F.col(text_col), tuple(recognizers)
    rows = units.withColumn("__s", F.coalesce(found_in(text, recognizers), F.array().cast(f"array<{FOUND}>")))
    rows = rows.withColumn("__m", masked_value(text, F.col("__s"))).withColumn("__r", F.coalesce(audit.residuals(F.col("__m.text")), F.array().cast(f"array<{audit.ITEM}>")))
    rows = rows.withColumn("__t", F.array().cast("array<string>"))
    for _ in range(rounds - 1):
        dirty = F.size("__r") > 0
        terms = F.array_distinct(F.concat("__t", F.transform("__r", lambda r: F.trim(r["value"]))))
        rows = rows.withColumn("__t", F.when(dirty, terms).otherwise(F.col("__t")))
        again = masked_value(text, F.concat("__s", let(unmarked(text), lambda t: term_spans(t, F.col("__t")))))
        rows = rows.withColumn("__m", F.when(dirty, again).otherwise(F.col("__m")))
        rows = rows.withColumn("__r", F.when(dirty, audit.residuals(F.col("__m.text"))).otherwise(F.col("__r")))
    out = rows.withColumn("masked_text", F.col("__m.text")).withColumn("n_masked", F.col("__m.n")).withColumn("residuals", F.col("__r")).withColumn("repair_terms", F.col("__t"))
    return out.drop("__s", "__m", "__r", "__t")


def process(units: DataFrame, verdicts: DataFrame | None = None, recognizers: Iterable[Recognizer] = GENERAL, text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Units through to a routed state: masked text, digest, audit, status. ``verdicts``: (doc_id, raw) of a model.

    One scan; only where verdicts are given are they joined in by doc_id. Repeated ids stay rows of their own.
    """
    rows = audited_rows(units, recognizers, rounds, text_col).withColumn("h", audit.judged(F.col("residuals")))
    if verdicts is not None:
        rows = rows.join(verdicts.select("doc_id", audit.parse_verdict(F.col("raw")).alias("v")), "doc_id", "left")
    else:
        rows = rows.withColumn("v", F.lit(None).cast(audit.VERDICT_TYPE))
    rows = rows.withColumn("c", audit.combined(F.col("h"), F.col("v"))).withColumn("digest", audit.digest(F.col("masked_text")))
    state = rows.select("doc_id", "masked_text", "n_masked", "digest", "c.risk_level", "c.n_items", F.col("c.approved").alias("clean"), "c.llm_ok", F.lit(False).alias("blocking"), F.lit(0).alias("pending"), F.col("masked_text").isNotNull().alias("has_output"))
    return audit.route(state)


def repaired(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(doc_id, masked_text, n_left) after the mask-audit-repair rounds."""
    rows = audited_rows(units, recognizers, rounds, text_col)
    return rows.select("doc_id", "masked_text", F.size("residuals").alias("n_left"))


def redecided(units: DataFrame, recognizers: Iterable[Recognizer] = GENERAL, text_col: str = "text") -> DataFrame:
    """Documents masked anew from the original with a reviewer's decisions, in one scan.

    ``units`` has (doc_id, text, revision, mask_terms, keep_terms), the terms as arrays. Masked terms are
    denied in all their places; no span inside a place of a kept term (with an apostrophe suffix) is
    masked. The revision goes up, and the document goes back to review until it is audited again.
    """
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    terms = lambda c: F.coalesce(F.col(c), none)
    denied = let(unmarked(text), lambda t: term_spans(t, terms("mask_terms")))
    kept = let(unmarked(text), lambda t: term_spans(t, terms("keep_terms"), r"(?:['’]\p{L}+)?"))
    rows = units.withColumn("__k", kept).withColumn("__s", F.concat(found_in(text, tuple(recognizers)), denied))
    free = F.filter("__s", lambda s: ~within(s, F.col("__k")))
    rows = rows.withColumn("__m", masked_value(text, free))
    return rows.select("doc_id", F.col("__m.text").alias("masked_text"), F.col("__m.n").alias("n_masked"), (F.col("revision") + 1).alias("revision"), F.lit("needs_human_review").alias("status"))
