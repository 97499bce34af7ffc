"""Review: findings in masked text, decisions, term life cycle, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.fold import PLACEHOLDER, collapsed
from maskloom.functions.spans import let, overlaps, spans_in, unmarked
from maskloom.operators.mask import as_of, latest


def locate_terms(units: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "masked_text") -> DataFrame:
    """Findings (keys, term, start, end, f): each term of a document in its masked units.

    Case is ignored and white space in a term is any run of it. Hits in a placeholder do not count;
    a place is found once, for the first term. ``f`` numbers a document's findings in order.
    A text meets its document's terms in one row, and what leaves that row is places.
    """
    doc = keys[0]
    literal = F.replace(collapsed(F.col("term")), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.regexp_replace(literal, " ", r"\\E\\s+\\Q"), F.lit(r"\E"))
    sought = terms.where(collapsed(F.col("term")) != "").groupBy(doc).agg(F.collect_set(F.struct("term", pattern.alias("pattern"))).alias("__terms"))

    def places(text):
        def of_term(holders, t):
            free = F.filter(spans_in(text, t["pattern"]), lambda h: ~F.exists(holders, lambda x: overlaps(x["start"], x["end"], h["start"], h["end"])))
            return F.transform(free, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), t["term"].alias("term")))

        return let(spans_in(text, PLACEHOLDER), lambda holders: F.flatten(F.transform("__terms", lambda t: of_term(holders, t))))

    found = units.join(sought, doc).select(*keys, F.explode(let(unmarked(F.col(text_col)), places)).alias("__x"))
    once = found.groupBy(*keys, F.col("__x.start").alias("start"), F.col("__x.end").alias("end")).agg(F.min("__x.term").alias("term"))
    order = [F.col(k) for k in keys[1:]]
    return once.withColumn("f", F.row_number().over(Window.partitionBy(doc).orderBy(*order, "start", "end")))


def placed(findings: DataFrame, done: DataFrame, keeps: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings with the range they have in the original (``original_start``, ``original_end``) and ``status``.

    Offsets go back over the edits before them (an as-of join). A finding inside a kept range of the
    original is kept, any other open. Findings, edits and kept ranges meet in running windows of a unit.
    """
    out = findings
    for c in ("start", "end"):
        out = as_of(out, c, done, "masked_end", F.col("end") - F.col("masked_end"), latest, keys).withColumn(f"original_{c}", F.col(c) + F.coalesce("as_of", F.lit(0))).drop("as_of")
    # of the kept ranges that open at or before a finding, the one that reaches furthest tells
    held = as_of(out, "original_start", keeps, "start", F.col("end"), F.max, keys)
    return held.withColumn("status", F.when(F.col("original_end") <= F.col("as_of"), "kept").otherwise("open")).drop("as_of")


def unlocated(terms: DataFrame, findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Terms of a document that were found nowhere in it."""
    return terms.join(findings.select(doc, "term").distinct(), [doc, "term"], "left_anti")


def pending(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    return findings.groupBy(doc).agg(F.count_if(F.col("status") == "open").alias("pending"))


def decided(findings: DataFrame, decisions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Findings with the status that the last decision of their scope sets: occurrence, document or global.

    Each scope is an equality join with its last decisions, one a key, so that rows grow with the
    findings, however many decisions name a term. Equal findings are one row.
    """
    columns = findings.columns
    out = findings.distinct().withColumn("__term", F.lower("term"))
    scopes = {"occurrence": [doc, "f", "__term"], "document": [doc, "__term"], "global": ["__term"]}
    for scope, keys in scopes.items():
        made = decisions.where(F.col("scope") == scope).withColumn("__term", F.lower("term"))
        last = made.groupBy(*keys).agg(F.max_by(F.struct("op"), F.struct("at")).alias(f"__{scope}"))
        out = out.join(last, keys, "left")
    op = F.coalesce(*[F.col(f"__{scope}") for scope in scopes])["op"]
    status = F.when(op.isin("keep", "unmask"), "kept").when(op == "mask", "masked").otherwise("open")
    return out.withColumn("status", status).select(*columns, *([] if "status" in columns else ["status"]))


def fresh(decisions: DataFrame, state: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Decisions made on the current revision; stale ones are refused."""
    return decisions.join(state.select(doc, "revision"), doc).where("expected_revision = revision")


def may_approve(state: DataFrame) -> DataFrame:
    """Documents whose current revision and text are what was audited."""
    return state.where("audited_revision = revision and audited_digest = digest and llm_ok = true")


def acted(state: DataFrame, actions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """State after reviewers' actions (doc, action: approve, reject, delete), with ``audit_again``.

    A document in review is approved only if its current revision and text are what a model audited;
    otherwise it stays and has to be audited again. Deleted documents leave the table.
    """
    rows = state.join(actions.select(doc, "action"), doc, "left")
    asked = lambda what: F.coalesce(F.col("action") == what, F.lit(False)) & (F.col("status") == "needs_human_review")
    sound = F.coalesce((F.col("audited_revision") == F.col("revision")) & (F.col("audited_digest") == F.col("digest")) & F.col("llm_ok"), F.lit(False))
    status = F.when(asked("approve") & sound, "approved").when(asked("reject"), "rejected").otherwise(F.col("status"))
    out = rows.withColumn("audit_again", asked("approve") & ~sound).withColumn("status", status)
    return out.where("action is null or action <> 'delete'").drop("action")


def term_life(final: DataFrame, repairs: DataFrame) -> DataFrame:
    """Terms of both lists by key; the final list's state wins over the repairs'."""
    both = final.alias("f").join(repairs.alias("r"), "key", "full_outer")
    return both.select("key", F.coalesce("f.state", "r.state").alias("state"), F.coalesce("f.term", "r.term").alias("term"))


def always_or_never(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """User lists (key, list) after changes: a key stands in one list only, the last change's."""
    last = changes.groupBy("key").agg(F.max_by("list", "at").alias("list"))
    return lists.join(last.select("key"), "key", "left_anti").select("key", "list").unionByName(last.where("list <> 'remove'").select("key", "list"))


def page_marks(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words of a page to mark: the n-th whole-word match of a block for its n-th span; all, if counts differ."""
    nth = lambda *by: F.row_number().over(Window.partitionBy("doc_id", "block_id", "value").orderBy(*by))
    w = words.withColumn("nth", nth("ord")).withColumn("n_words", F.count("*").over(Window.partitionBy("doc_id", "block_id", "value")))
    s = spans.withColumn("nth", nth("start")).withColumn("n_spans", F.count("*").over(Window.partitionBy("doc_id", "block_id", "value")))
    exact = w.join(s.select("doc_id", "block_id", "value", "nth", "n_spans"), ["doc_id", "block_id", "value", "nth"]).where("n_words = n_spans")
    odd = w.join(s.select("doc_id", "block_id", "value", "n_spans").distinct(), ["doc_id", "block_id", "value"]).where("n_words <> n_spans")
    cols = ["doc_id", "block_id", "value", "ord"]
    return exact.select(*cols).unionByName(odd.select(*cols)).distinct()


def occurrence_counts(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Items with how often their text, case aside, stands in the document."""
    return items.withColumn("occurrences", F.count("*").over(Window.partitionBy(doc, F.lower("value"))))


def page_of(edits: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Edits with the page whose range of offsets holds their start."""
    on = (F.col(f"e.{doc}") == F.col(f"p.{doc}")) & (F.col("p.start") <= F.col("e.start")) & (F.col("e.start") < F.col("p.end"))
    return edits.alias("e").join(pages.alias("p"), on, "left").select("e.*", "p.page")
