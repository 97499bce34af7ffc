"""What reviewers, readers and reports see: payloads, labels, exports, prompts, sweeps, guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import PLACEHOLDER
from maskloom.operators.audit import value_hash

#: What a reason is called.
REASONS = {
    "auditor_unavailable": "The second check did not run",
    "residual_risk": "Personal data may be left",
    "blocked": "The document could not be read whole",
    "open_findings": "Findings wait for a decision",
    "no_output": "There is no masked text",
    "no_text": "No text was found",
}
#: Keys that an evaluation record must not have.
RAW_FIELDS = ("value", "surface", "text", "original", "masked_text")
MOST_SELECTED = 200


def reason_label(code: Column) -> Column:
    """The label of a reason; ``ocr:...`` and such by their prefix; unknown ones as they are."""
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(table, F.substring_index(code, ":", 1)), code)


def location_label(page: Column, sheet: Column, row: Column, col: Column) -> Column:
    """``page n``, ``sheet, A1`` or the empty string."""
    letter = F.char(F.lit(65) + F.pmod(col, F.lit(26)))
    name = F.when(col >= 26, F.concat(F.char(F.lit(64) + F.floor(col / 26)), letter)).otherwise(letter)
    return F.when(sheet.isNotNull(), F.concat(sheet, F.lit(", "), name, row + 1)).when(page.isNotNull(), F.concat(F.lit("page "), page)).otherwise("")


def review_payload(state: DataFrame, findings: DataFrame, tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: counts of findings by status and of masked values, and what may be done with it."""
    f = findings.groupBy(doc).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("open", "kept", "masked")])
    t = tokens.groupBy(doc).agg(F.count("*").alias("n_values"), F.countDistinct("token").alias("n_tokens"))
    out = state.join(f, doc, "left").join(t, doc, "left").na.fill(0, ["n_open", "n_kept", "n_masked", "n_values", "n_tokens"])
    review = F.col("status") == "needs_human_review"
    return out.withColumn("may_approve", review & (F.col("n_open") == 0) & F.coalesce(F.col("llm_ok"), F.lit(False))).withColumn("may_reject", review).withColumn("may_decide", review & (F.col("revision") == F.col("audited_revision")))


def target_spans(edits: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Edits that a reviewer's selection (keys, from, to) touches; empty, reversed and over-long selections touch none."""
    good = targets.where((F.col("to") > F.col("from")) & (F.col("to") - F.col("from") <= MOST_SELECTED) & (F.col("from") >= 0))
    on = (F.col("e.masked_start") < F.col("t.to")) & (F.col("t.from") < F.col("e.masked_end"))
    for k in keys:
        on = on & (F.col(f"e.{k}") == F.col(f"t.{k}"))
    return edits.alias("e").join(good.alias("t"), on, "left_semi")


def export_text(units: DataFrame, doc: str = "doc_id", order: str = "unit_ord", text_col: str = "masked_text") -> DataFrame:
    """Masked units of a document as one text, blocks apart by a blank line."""
    parts = units.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, text_col))).alias("parts"))
    return parts.select(doc, F.array_join(F.transform("parts", lambda p: p[text_col]), "\n\n").alias("text"))


def export_html(text: Column) -> Column:
    """Masked text as HTML: escaped, placeholders marked, paragraphs by line."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = F.regexp_replace(safe, r"&lt;([A-Z_]+_[0-9]+)&gt;", "<mark>$1</mark>")
    return F.concat(F.lit("<p>"), F.replace(marked, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))


def system_prompt(sources: DataFrame, head: str = "Answer from these sources and cite them.") -> DataFrame:
    """One row: the head and the ranked sources (id, text) in order."""
    rows = sources.agg(F.array_sort(F.collect_list(F.struct(F.substring("id", 2, 9).cast("int").alias("n"), "id", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["text"])), "\n\n")
    return rows.select(F.concat(F.lit(head + "\n\n"), body).alias("prompt"))


def chat_sources(texts: DataFrame, state: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Only approved documents may be asked about; a document without a state is not approved."""
    return texts.join(state.where("status = 'approved'").select(doc), doc, "left_semi")


def sweep(files: DataFrame, values: Iterable[str], text_col: str = "text") -> DataFrame:
    """(vhash, n_files) of each value: files that contain it. Values are a short list (a catalogue), tested in the scan."""
    listed = F.array(*[F.lit(v) for v in dict.fromkeys(values)])
    hit = files.select(F.explode(F.filter(listed, lambda v: F.contains(F.col(text_col), v))).alias("value"))
    return hit.groupBy(value_hash(F.col("value")).alias("vhash")).agg(F.count("*").alias("n_files"))


def raw_field_guard(columns: Iterable[str], allowed: Iterable[str]) -> tuple[list[str], list[str]]:
    """(columns nobody asked for, forbidden columns) of an evaluation table."""
    columns = list(columns)
    return sorted(set(columns) - set(allowed)), sorted(set(columns) & set(RAW_FIELDS))


def model_evidence(calls: DataFrame) -> DataFrame:
    """Sums of model calls (seconds, tokens, ok) and whether they look like a model's: some, none instant, most readable."""
    out = calls.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 3).alias("seconds"), F.count_if("ok").alias("readable"), F.min("seconds").alias("fastest"))
    return out.withColumn("plausible", (F.col("calls") > 0) & (F.col("fastest") > 0.05) & (F.col("readable") * 2 > F.col("calls"))).drop("fastest")


def placeholder_use(units: DataFrame, doc: str = "doc_id", text_col: str = "masked_text") -> DataFrame:
    """Placeholders of each family as they stand in the masked text."""
    one = units.select(doc, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PLACEHOLDER), F.lit(0))).alias("token"))
    return one.groupBy(doc, F.regexp_extract("token", r"<([A-Z_]+)_[0-9]+>", 1).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


def identity_check(records: DataFrame, key: str) -> DataFrame:
    """Keys that stand in a table more than once, for resumable runs."""
    return records.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1").drop("n")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
