"""Evaluation: span, character, entity, leak and utility metrics, gates, samples.

Three conventions for an empty denominator live side by side and are named where they are used:
``ratio`` with 0.0, 1.0 or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import PLACEHOLDER, collapsed, literal_pattern
from maskloom.functions.spans import covered, merged, overlaps, regex_spans


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """(1 + b²) P R / (b² P + R); 0 if that is 0 / 0."""
    low = beta * beta * p + r
    return F.when(low == 0, 0.0).otherwise((1 + beta * beta) * p * r / low)


def _meets(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    on = overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, "left_semi")


def span_scores(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row: precision, recall, F1 and over-masking of spans by overlap; empty denominators are 1.0.

    Interval semi joins on the unit keys; hit and all are counted in one aggregation each.
    """
    g, p = gold.select(*keys, "start", "end"), predicted.select(*keys, "start", "end")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(g, "n_gold").crossJoin(n(_meets(g, p, keys), "n_covered")).crossJoin(n(p, "n_pred")).crossJoin(n(_meets(p, g, keys), "n_hit"))  # single rows
    precision = ratio(F.col("n_hit"), F.col("n_pred"), 1.0)
    recall = ratio(F.col("n_covered"), F.col("n_gold"), 1.0)
    out = one.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0)).withColumn("over_masking", 1 - F.col("precision"))


def locate(text: Column, surface: Column, nth: Column) -> Column:
    """Start of the n-th (from 1) occurrence of ``surface``, overlapping ones too; null if there is none.

    Where there are not so many exact ones, the n-th with any white space for white space counts.
    """
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - F.char_length(surface) + 1)), lambda i: F.substr(text, i, F.char_length(surface)) == surface)
    exact = F.when(F.contains(text, surface), F.get(starts, nth - 1) - 1)
    words = F.concat(F.lit(r"\Q"), F.regexp_replace(F.replace(collapsed(surface), F.lit(r"\E"), F.lit("")), " ", r"\\E\\s+\\Q"), F.lit(r"\E"))
    loose = F.when(F.trim(surface) != "", F.get(regex_spans(text, words), nth - 1)["start"])
    return F.when(F.char_length(surface) > 0, F.coalesce(exact, loose))


def locate_loose(text: Column, term: str) -> Column:
    """True if the term stands in the text, case and runs of white space aside."""
    return text.rlike(literal_pattern(term))


def mention_results(mentions: DataFrame, detections: DataFrame, masked: DataFrame, export: DataFrame | None = None) -> DataFrame:
    """One row for each gold mention (doc_id, mention_id, start, end, surface, ...): characters detected, masked, residual.

    Detections of a document are merged first, so no character counts twice. ``start`` is null for
    mentions that were not located; they have no detected characters and are not masked. With ``export``
    (doc_id, export_text) there is also ``leaked_in_export``: the located value stands in what was exported.
    """
    ranges = detections.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    both = mentions.join(ranges, "doc_id", "left").join(masked.select("doc_id", "masked_text"), "doc_id", "left")
    cut = F.transform(
        F.filter(F.coalesce("ranges", F.array()), lambda r: overlaps(r["start"], r["end"], F.col("start"), F.col("end"))),
        lambda r: F.struct(F.greatest(r["start"], F.col("start")).alias("start"), F.least(r["end"], F.col("end")).alias("end")),
    )
    located = F.col("start").isNotNull()
    plain, surface = collapsed(F.coalesce("masked_text", F.lit(""))), collapsed(F.col("surface"))
    parts = F.filter(F.split(surface, " "), lambda w: (F.char_length(w) >= 3) & F.contains(plain, w))
    hidden = located & ~F.contains(plain, surface)
    out = both.withColumn("located", located).withColumn("total_chars", F.char_length("surface"))
    out = out.withColumn("detected_chars", F.when(located, covered(cut)).otherwise(0)).withColumn("masked", hidden)
    out = out.withColumn("residual_chars", F.when(hidden, F.aggregate(parts, F.lit(0), lambda n, w: n + F.char_length(w))).otherwise(0))
    full = (F.col("detected_chars") == F.col("total_chars")) & (F.col("total_chars") > 0) & located
    out = out.withColumn("fully_detected", full).withColumn("partially_detected", (F.col("detected_chars") > 0) & ~full).drop("ranges", "masked_text")
    if export is None:
        return out
    leaked = F.col("located") & F.contains(collapsed(F.coalesce("export_text", F.lit(""))), surface)
    return out.join(export.select("doc_id", "export_text"), "doc_id", "left").withColumn("leaked_in_export", leaked).drop("export_text")


def char_coverage(detections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Characters in the union of a document's detections, and in their sum."""
    per = detections.groupBy(doc).agg(F.collect_list(F.struct("start", "end")).alias("r"))
    return per.select(doc, covered(F.col("r")).cast("long").alias("union_chars"), F.aggregate("r", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long").alias("sum_chars"), F.size(merged(F.col("r"))).cast("long").alias("islands"))


def entity_recall(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mention recall, entity recall (every mention masked) and the same of critical entities; empty is 0.0."""
    by = group or []
    entity = results.groupBy(*by, "entity_id").agg(F.bool_and("masked").alias("all_masked"), F.bool_or("critical").alias("critical"), F.count("*").alias("n"), F.count_if("masked").alias("n_masked"))
    return entity.groupBy(*by).agg(
        F.sum("n").alias("mentions"),
        F.round(ratio(F.sum("n_masked"), F.sum("n")), 4).alias("mention_recall"),
        F.count("*").alias("entities"),
        F.round(ratio(F.count_if("all_masked"), F.count("*")), 4).alias("entity_recall"),
        F.round(ratio(F.count_if(F.col("all_masked") & F.col("critical")), F.count_if("critical")), 4).alias("critical_entity_recall"),
    )


def recall_by(results: DataFrame, *columns: str) -> DataFrame:
    """Mention recall by each of the columns apart, in one pass (grouping sets)."""
    grouped = results.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("masked").alias("n_masked"))
    which = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(columns) - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(columns)])
    value = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(columns) - 1 - i)) == 0, F.col(c).cast("string")) for i, c in enumerate(columns)])
    return out.select(which.alias("dimension"), value.alias("value"), "n", "n_masked", F.round(ratio(F.col("n_masked"), F.col("n")), 4).alias("recall"))


def char_metrics(results: DataFrame, detected_total: Column | None = None) -> DataFrame:
    """Character recall, precision, F1 and F2 of located mentions (classes other than NO_MASK); empty is 0.0."""
    mask = F.col("identifier_class") != "NO_MASK"
    hit = F.sum(F.when(mask, F.col("detected_chars")).otherwise(0))
    total = F.sum(F.when(mask, F.col("total_chars")).otherwise(0))
    wrong = F.sum(F.when(~mask, F.col("detected_chars")).otherwise(0))
    out = results.where("located").agg(ratio(hit, total).alias("char_recall"), ratio(hit, hit + wrong).alias("char_precision"))
    p, r = F.col("char_precision"), F.col("char_recall")
    return out.select(*[F.round(c, 4).alias(n) for c, n in ((r, "char_recall"), (p, "char_precision"), (f_beta(p, r, 1), "f1"), (f_beta(p, r, 2), "f2"))])


def over_masking(results: DataFrame) -> DataFrame:
    """Mentions that should stay and were masked; empty is 0.0."""
    keep = results.where("located and identifier_class = 'NO_MASK'")
    return keep.agg(F.count("*").alias("no_mask_total"), F.count_if("masked").alias("violations"), F.round(ratio(F.count_if("masked"), F.count("*")), 4).alias("over_masking_rate"))


def coverage_score(results: DataFrame, fp: float = 0.5, boundary: float = 0.5) -> DataFrame:
    """Coverage of mandatory mentions (of all, if none is) less half the share of partial ones and of violations, in 0..1."""
    mask = F.col("located") & (F.col("identifier_class") != "NO_MASK")
    must = mask & (F.col("necessity") == "MANDATORY")
    stay = F.col("located") & (F.col("identifier_class") == "NO_MASK")
    sums = results.agg(
        *[x for name, c in (("m", must), ("a", mask)) for x in (
            F.count_if(c).alias(f"{name}_n"),
            F.sum(F.when(c, F.col("total_chars")).otherwise(0)).alias(f"{name}_total"),
            F.sum(F.when(c, F.col("detected_chars")).otherwise(0)).alias(f"{name}_hit"),
            F.count_if(c & F.col("partially_detected")).alias(f"{name}_part"),
        )],
        F.count_if(stay).alias("stay"), F.count_if(stay & F.col("masked")).alias("stay_masked"),
    )
    pick = lambda x: F.when(F.col("m_n") > 0, F.col(f"m_{x}")).otherwise(F.col(f"a_{x}"))
    score = ratio(pick("hit"), pick("total")) - ratio(pick("part"), pick("n")) * boundary - ratio(F.col("stay_masked"), F.col("stay")) * fp
    return sums.select(F.when((F.col("a_n") == 0) | (pick("total") == 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).alias("score"))


def escapes(cases: DataFrame) -> DataFrame:
    """Strict scoring (case_id, surface, masked_text, processed): the value or a part of 3 characters is still seen."""
    parts = F.filter(F.split(collapsed(F.col("surface")), " "), lambda w: F.char_length(w) >= 3)
    seen = F.contains("masked_text", F.col("surface")) | F.exists(parts, lambda w: F.contains(F.col("masked_text"), w))
    return cases.withColumn("escape", F.coalesce(~F.col("processed") | seen, F.lit(True)))


def nearest_rank(rows: DataFrame, group: str, value: str, q: float, buckets: int = 4096) -> DataFrame:
    """(group, n, ranked): the nearest-rank quantile, element 1 + round(q (n - 1)) of the sorted values, halves to even.

    Values are counted in buckets of equal width; only the bucket that holds the rank is looked into, by
    its distinct values and their counts. Nothing is collected. Nulls do not count.
    """
    v = F.col(value)
    span = rows.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    span = span.withColumn("__at", F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long"))
    share = (v - F.col("__low")) / (F.col("__high") - F.col("__low"))
    bucket = F.when(F.col("__high") > F.col("__low"), F.least(F.lit(buckets - 1), F.floor(share * buckets))).otherwise(0).cast("int")
    placed = rows.where(v.isNotNull()).join(span, group).withColumn("__b", bucket)
    upto = F.sum("__c").over(Window.partitionBy(group).orderBy("__b"))
    counts = placed.groupBy(group, "n", "__at", "__b").agg(F.count("*").alias("__c")).withColumn("__upto", upto)
    held = counts.where("__upto > __at and __upto - __c <= __at").select(group, "__b", (F.col("__upto") - F.col("__c")).alias("__before"))
    inside = placed.join(held, [group, "__b"]).groupBy(group, "n", "__at", "__before", v.alias("ranked")).agg(F.count("*").alias("__c"))
    inside = inside.withColumn("__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy(group).orderBy("ranked")))
    return inside.where("__upto > __at and __upto - __c <= __at").select(group, "n", "ranked")


def canary_report(results: DataFrame, outcomes: DataFrame, by: str) -> DataFrame:
    """Placements joined to the status of their carrier: recall, shipped and contained leaks; empty is 1.0."""
    both = results.join(outcomes.select("marker", "status"), "marker", "left")
    ex, ok = F.col("extracted"), F.coalesce(F.col("status") == "approved", F.lit(False))
    return both.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(ex).alias("n_extracted"),
        F.count_if(ex & F.col("masked")).alias("n_masked"),
        F.round(ratio(F.count_if(ex), F.count("*"), 1.0), 3).alias("coverage"),
        F.round(ratio(F.count_if(ex & F.col("masked")), F.count_if(ex), 1.0), 3).alias("recall"),
        F.count_if(F.col("residual") & ok).alias("shipped"),
        F.count_if(F.col("residual") & ~ok).alias("contained"),
    )


def failure_stage(extracted: Column, detected: Column, masked: Column, family_ok: Column, residual: Column) -> Column:
    """First stage at which a placed value went wrong; null if none did."""
    return F.when(~extracted, "S3").when(~detected, "S5").when(~masked, "S7").when(~family_ok, "S6").when(residual, "S10")


def determinism(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """By carrier and family: distinct values against distinct tokens; a full outer join of two counts."""
    v = values.groupBy("carrier", "family").agg(F.countDistinct("value").alias("n_values"))
    t = tokens.groupBy("carrier", "family").agg(F.countDistinct("token").alias("n_tokens"))
    out = v.join(t, ["carrier", "family"], "full_outer").na.fill(0, ["n_values", "n_tokens"])
    return out.withColumn("deterministic", F.col("n_values") == F.col("n_tokens"))


def density(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Placeholders per 1,000 characters: of the corpus, and the median of the documents; empty is null."""
    per = F.when(F.col("chars") > 0, F.col("placeholders") * 1000 / F.col("chars"))
    return units.withColumn("d", per).groupBy(*(by or [])).agg(
        F.sum("chars").alias("chars"),
        F.sum("placeholders").alias("placeholders"),
        F.round(ratio(F.sum("placeholders") * 1000, F.sum("chars"), None), 4).alias("density"),
        F.round(F.median("d"), 4).alias("median_density"),
    )


#: Release criteria as (name, measure, rule, bound, what must be there to measure it).
CRITERIA = (
    ("critical_false_negatives", "critical_false_negatives", "eq", 0.0, "critical_mentions"),
    ("critical_entity_recall", "critical_entity_recall", "ge", 0.95, "critical_entities"),
    ("over_masking_rate", "over_masking_rate", "le", 0.10, "no_mask_total"),
    ("utility_retention", "utility_retention", "ge", 0.90, None),
    ("critical_false_approval", "critical_false_approval", "eq", 0.0, None),
    ("leaked_in_export", "leaked_in_export", "eq", 0.0, "mentions_located"),
)


def release_gate(measures: DataFrame, key: str) -> DataFrame:
    """Each criterion PASS, FAIL or UNMEASURED; overall FAIL if any fails, else INCOMPLETE if any is unmeasured, else OK."""
    cells = []
    for name, col, rule, bound, needs in CRITERIA:
        v = F.col(col)
        good = (v == bound) if rule == "eq" else (v >= bound) if rule == "ge" else (v <= bound)
        missing = v.isNull() | (F.coalesce(F.col(needs), F.lit(0)) == 0 if needs else F.lit(False))
        cells.append(F.struct(F.lit(name).alias("criterion"), F.when(missing, "UNMEASURED").when(good, "PASS").otherwise("FAIL").alias("verdict")))
    out = measures.withColumn("cells", F.array(*cells))
    count = lambda w: F.size(F.filter("cells", lambda c: c["verdict"] == w)).cast("long")
    overall = F.when(count("FAIL") > 0, "FAIL").when(count("UNMEASURED") > 0, "INCOMPLETE").otherwise("OK")
    return out.select(key, overall.alias("overall"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("UNMEASURED").alias("unmeasured"))


def stress_verdict(expected: Column, approved: Column, leaked: Column) -> Column:
    """An approved leak is critical; a case that must close fails if it was approved; a closed safe case is closed."""
    return F.when(approved & leaked, "critical_false_approval").when((expected == "FAIL_CLOSED") & approved, "not_closed").when(approved, "safe_output").when(expected == "FAIL_CLOSED", "closed").otherwise("over_closed")


def mapping_checks(masked: DataFrame, mapping: DataFrame, planted: DataFrame, shareable: DataFrame) -> DataFrame:
    """(doc_id, complete, round_trip, contained) of documents kept with a mapping.

    complete: every token of the masked text is in the mapping. round_trip: every planted value that is
    gone from the masked text is among the mapping's values. contained: no planted value stands in what
    may be shared; without anything shared that is not shown, so it fails. White space counts as one blank.
    """
    by_doc = mapping.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"), F.collect_set(collapsed(F.col("value"))).alias("values"))
    own = planted.where(collapsed(F.col("value")) != "").groupBy("doc_id").agg(F.collect_set(collapsed(F.col("value"))).alias("planted"))
    texts = shareable.groupBy("doc_id").agg(F.collect_list(collapsed(F.col("text"))).alias("shared"))
    rows = masked.select("doc_id", "masked_text").join(by_doc, "doc_id", "left").join(own, "doc_id", "left").join(texts, "doc_id", "left")
    none = F.array().cast("array<string>")
    c = lambda name: F.coalesce(F.col(name), none)
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("masked_text", F.lit("")), F.lit(PLACEHOLDER), F.lit(0)))
    gone = F.filter(c("planted"), lambda v: ~F.contains(collapsed(F.coalesce("masked_text", F.lit(""))), v))
    leaks = F.exists(c("shared"), lambda t: F.exists(c("planted"), lambda v: F.contains(t, v)))
    return rows.select(
        "doc_id",
        (F.size(F.array_except(found, c("tokens"))) == 0).alias("complete"),
        (F.size(F.array_except(gone, c("values"))) == 0).alias("round_trip"),
        ((F.size(c("shared")) > 0) & ~leaks).alias("contained"),
    )


def destructive_checks(docs: DataFrame, original: DataFrame, extracted: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, no_original, no_extracted, no_mapping) of documents that must not be reversible."""
    out = docs.select("doc_id")
    for name, layer in (("no_original", original), ("no_extracted", extracted), ("no_mapping", mapping)):
        out = out.join(layer.select("doc_id").distinct().withColumn(name, F.lit(False)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(True)))
    return out


def check_rates(checks: DataFrame) -> DataFrame:
    """One row: documents, those that pass every check, and the share that passes each; empty is null."""
    names = [c for c in checks.columns if c != "doc_id"]
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return checks.agg(F.count("*").alias("documents"), F.count_if(every).alias("passed"), *[F.round(ratio(F.count_if(n), F.count("*"), None), 4).alias(n) for n in names])


def strict_verdict(expected: Column, shipped: Column, values: Column, output: Column) -> Column:
    """Strict verdict of a stress case: a shipped value of six characters or more is critical, white space aside.

    Else a case that must close passes if nothing was shipped, and one that must not is conservative then.
    """
    plain = lambda c: collapsed(F.coalesce(c, F.lit("")))
    leak = shipped & F.exists(F.filter(values, lambda v: F.char_length(v) >= 6), lambda v: F.contains(plain(output), plain(v)))
    closed = F.when(~shipped, "pass").otherwise("fail")
    return F.when(leak, "critical_false_approval").when(expected == "fail_closed", closed).otherwise(F.when(shipped, "pass").otherwise("conservative"))


def class_char_recall(gold: DataFrame, detections: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(identifier_class, hit, total, recall) over the characters of gold spans that are not white space; empty is null.

    ``gold`` has (keys, start, end, surface, identifier_class). Detections of a unit are merged first.
    """
    ranges = detections.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("all")).select(*keys, merged(F.col("all")).alias("ranges"))
    rows = gold.join(ranges, list(keys), "left")
    dense = lambda t: F.char_length(F.regexp_replace(t, r"\s+", "")).cast("long")
    part = lambda r: F.substr(F.col("surface"), F.greatest(r["start"] - F.col("start"), F.lit(0)) + 1, F.greatest(F.least(r["end"], F.col("end")) - F.greatest(r["start"], F.col("start")), F.lit(0)))
    hit = F.aggregate(F.coalesce("ranges", F.array()), F.lit(0).cast("long"), lambda n, r: n + dense(part(r)))
    out = rows.groupBy("identifier_class").agg(F.sum(hit).alias("hit"), F.sum(dense(F.col("surface"))).alias("total"))
    return out.withColumn("recall", F.round(ratio(F.col("hit"), F.col("total"), None), 4))


def file_name_grade(value: Column, safe: Column) -> Column:
    """Whether a value is gone from the safe file name, and the stage that failed otherwise."""
    masked = ~F.contains(collapsed(safe), collapsed(value))
    return F.struct(masked.alias("masked"), F.when(masked, "ok").otherwise("S15_filename_not_anonymized").alias("stage"))


def round_robin(rows: DataFrame, group: str, order: str, per_group: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows interleaved over groups: first of each, then second of each, ...; optional bounds for each group and in all."""
    out = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    if per_group:
        out = out.where(F.col("turn") <= per_group)
    return out if limit is None else out.orderBy("turn", group, order).limit(limit)


def top_groups(rows: DataFrame, group: str, order: str, groups: int = 3, each: int = 10) -> DataFrame:
    """The first ``each`` rows of the ``groups`` commonest values (count down, name up)."""
    top = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(groups)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.join(F.broadcast(top.select(group)), group).withColumn("nth", nth).where(F.col("nth") <= each)


def macro_micro(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean of the documents' recalls (macro) beside the recall of all mentions (micro); empty is null."""
    per = results.groupBy(doc).agg(F.count("*").alias("n"), F.count_if("masked").alias("k"))
    return per.agg(F.round(F.avg(ratio(F.col("k"), F.col("n"), None)), 6).alias("macro"), F.round(ratio(F.sum("k"), F.sum("n"), None), 6).alias("micro"))


def utility(questions: DataFrame) -> DataFrame:
    """Share of evidence (evidence, original, masked) still found after masking, of what was found before; empty is null."""
    before, after = F.contains("original", F.col("evidence")), F.contains("masked", F.col("evidence"))
    out = questions.agg(F.count_if(before).alias("before"), F.count_if(before & after).alias("after"))
    return out.withColumn("retention", F.round(ratio(F.col("after"), F.col("before"), None), 4))


def attack_success(guesses: DataFrame) -> DataFrame:
    """Share of cases whose first guess, or any of the first three, is the truth, case aside."""
    same = lambda g: F.lower(F.trim(g)) == F.lower(F.trim(F.col("truth")))
    first = F.coalesce(same(F.get("guesses", F.lit(0))), F.lit(False))
    return guesses.agg(F.count("*").alias("n"), F.round(ratio(F.count_if(first), F.count("*")), 4).alias("exact"), F.round(ratio(F.count_if(F.exists(F.slice("guesses", 1, 3), same)), F.count("*")), 4).alias("top3"))


def attack_options(distractors: Column, truth: Column, slot: Column, n: int = 4) -> Column:
    """n options: distinct distractors in order without the truth, which goes to ``slot`` (from 0)."""
    others = F.slice(F.filter(F.array_distinct(distractors), lambda d: d != truth), 1, n - 1)
    at = F.pmod(slot, F.size(others) + 1).cast("int")
    return F.concat(F.slice(others, F.lit(1), at), F.array(truth), F.slice(others, at + 1, F.lit(n)))


def variants_of(value: Column) -> Column:
    """Canary variants: a line break at the first space, and upper case with doubled spaces."""
    return F.array(F.regexp_replace(value, r"^(\S+) ", "$1\n"), F.regexp_replace(F.upper(value), " ", "  "))


def operational(rows: DataFrame, by: str) -> DataFrame:
    """Rates of runs by ``by``: share of each status, density, failures; empty is null."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(ratio(F.count_if(F.col("status") == "approved"), F.count("*"), None), 4).alias("approved_rate"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(ratio(F.sum("placeholders") * 1000, F.sum("chars"), None), 4).alias("density"),
    )
