"""Audit of masked text, routing, log redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.checks import tckn_valid
from maskloom.functions.fold import PLACEHOLDER
from maskloom.functions.spans import let, spans_in, unmarked

#: What must never be left in masked text, by code. They must find what the audit they stand for finds.
HARD_PATTERNS = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("IBAN", r"(?i)\bTR\d{2}(?:[ ]?\d){22}\b"),
    ("CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("TR_PHONE", r"\b(?:\+?90[ ]?|0)5\d{2}[\s.\-]?\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2}\b"),
    ("SECRET", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{8,}\b"),
    ("SECRET", r"\bAKIA[0-9A-Z]{12,}\b"),
    ("SECRET", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("SECRET", r"\bAIza[0-9A-Za-z_\-]{18,}\b"),
    ("SECRET", r"(?i)\b(?:api[_\s-]?key|secret|token|bearer|password|passwd)\b[\s:=]+[A-Za-z0-9_\-.]{12,}"),
)
#: For each of them, lower-case strings of which a text with a hit has one; "#" stands for seven digits, blanks and dashes aside.
HARD_NEEDS = (("@",), ("#",), ("#",), (), ("_live_", "_test_"), ("akia",), ("ghp_",), ("aiza",), ("api", "secret", "token", "bearer", "password", "passwd", "ſ"))
MOST_ITEMS, MOST_COMBINED = 25, 30
#: Replacements in logs, in this order.
LOG_PATTERNS = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("IBAN", r"(?i)\bTR(?:[ ]?\d){24}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("TCKN", r"\b[1-9]\d{10}\b"),
    ("VKN", r"\b\d{10}\b"),
    ("PLATE", r"\b\d{2}\s?[A-ZÇĞİÖŞÜ]{1,3}\s?\d{2,4}\b"),
    ("PASSPORT", r"\b[A-Z]\d{8}\b"),
    ("CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("PHONE", r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"),
)
#: Fixed value: a run of digits in a snippet.
NUMBERS = r"(?:\d[ -]?){6,}"
#: Words, digits and white space of any script.
UNICODE = "(?U)"
RISK = ("low", "medium", "high")


def redacted(text: Column) -> Column:
    """Log redaction: each pattern in order becomes ``<LABEL_REDACTED>``."""
    for label, pattern in LOG_PATTERNS:
        text = F.regexp_replace(text, UNICODE + pattern, f"<{label}_REDACTED>")
    return text


def mini_redacted(text: Column) -> Column:
    """E-mail addresses become ``<EMAIL>``, runs of six digits or more, spaces and dashes between them, ``<NUM>``."""
    return F.regexp_replace(F.regexp_replace(text, UNICODE + LOG_PATTERNS[0][1], "<EMAIL>"), UNICODE + NUMBERS, "<NUM>")


ITEM = "struct<code:string,start:int,end:int,value:string>"


def residuals(text: Column) -> Column:
    """array<struct<code, start, end, value>> of hard patterns and valid TCKNs outside placeholders; null for null."""

    def found(bare: Column, low: Column, run: Column) -> Column:
        coded = lambda hits, code: F.transform(hits, lambda h: F.struct(F.lit(code).alias("code"), h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value")))
        none = F.array().cast(f"array<{ITEM}>")

        def where(needs: tuple[str, ...], hits: Column) -> Column:
            may = F.lit(not needs)
            for w in needs:
                may = may | (run if w == "#" else F.contains(low, F.lit(w)))
            return F.when(may, hits).otherwise(none)

        numbers = F.filter(spans_in(bare, UNICODE + r"\b\d{11}\b"), lambda h: tckn_valid(h["value"]))
        hits = [where(needs, coded(spans_in(bare, UNICODE + p), code)) for (code, p), needs in zip(HARD_PATTERNS, HARD_NEEDS, strict=True)]
        return F.concat(*hits, where(("#",), coded(numbers, "TCKN")))

    every = lambda bare: let(F.lower(bare), lambda low: let(bare.rlike(UNICODE + r"\d(?:[ -]?\d){6}"), lambda run: found(bare, low, run)))
    return F.when(text.isNotNull(), let(unmarked(F.regexp_replace(text, PLACEHOLDER, " ")), every))


def judged(items: Column) -> Column:
    """struct<approved, risk_level, n_found, codes>: any item means not approved, high risk; at most 25 codes."""
    return F.struct(
        (F.size(items) == 0).alias("approved"),
        F.when(F.size(items) > 0, "high").otherwise("low").alias("risk_level"),
        F.size(items).cast("long").alias("n_found"),
        F.slice(F.transform(items, lambda i: i["code"]), 1, MOST_ITEMS).alias("codes"),
    )


def heuristic_audit(units: DataFrame, text_col: str = "masked_text", doc: str = "doc_id") -> DataFrame:
    """(doc, approved, risk_level, n_found, codes) of documents that may have several units."""
    rows = units.select(doc, residuals(F.coalesce(F.col(text_col), F.lit(""))).alias("items"))
    per = rows.groupBy(doc).agg(F.flatten(F.collect_list("items")).alias("items"))
    return per.select(doc, judged(F.col("items")).alias("j")).select(doc, "j.*")


VERDICT = "approved boolean, risk_level string, items array<struct<type:string,length:int,page:int>>, next_action string, ok boolean"
VERDICT_TYPE = "struct<approved:boolean,risk_level:string,items:array<struct<type:string,length:int,page:int>>,next_action:string,ok:boolean>"
#: Types that an item of a verdict may name.
KNOWN_TYPES = frozenset((
    "ACCOUNT ACCOUNT_NUMBER ADDRESS API_KEY BANK_ACCOUNT CARD COMPANY CONFIDENTIAL CREDENTIAL CREDIT_CARD DATE DATE_OF_BIRTH DATE_TIME DL DRIVER_LICENSE "
    "EMAIL EMAIL_ADDRESS FINANCIAL GOVERNMENT_ID HEALTH IBAN IBAN_CODE ID ID_NUMBER IP IP_ADDRESS LICENSE_PLATE LOCATION MEDICAL NAME NATIONAL_ID NRP ORG "
    "ORGANIZATION PASSPORT PASSPORT_NUMBER PASSWORD PERSON PHONE PHONE_NUMBER PLATE SALARY SECRET SECRET_KEY SENSITIVE SSN TAX_ID TAX_NUMBER TCKN TR_ACCOUNT "
    "TR_ADDRESS TR_COMPANY TR_DISABILITY TR_GSM TR_HEALTH TR_IBAN TR_PASSPORT TR_PERSON_CTX TR_PHONE TR_PLATE TR_SALARY_BAND TR_TCKN TR_VKN UK_PHONE UNKNOWN "
    "URL US_DRIVER_LICENSE US_SSN USERNAME VEHICLE_PLATE VKN"
).split())
PAGE = re.compile(r"\b(?:page|sayfa|p\.|s\.)\s*(\d{1,4})(?!\d)", re.IGNORECASE)


def safe_item(item: dict) -> tuple[str, int, int | None]:
    """(type, length, page) of a verdict's item: a known type or UNKNOWN, how long its snippet is, the page it names."""
    kind = "_".join(re.findall("[A-Z0-9]+", str(item.get("type", "")).upper()))
    page = PAGE.search(str(item.get("location") or ""))
    return kind if kind in KNOWN_TYPES else "UNKNOWN", len(str(item.get("snippet", "")).strip()), int(page[1]) if page else None


def parse_verdict(raw: Column) -> Column:
    """The first balanced JSON object of a model's answer; anything wrong fails closed. An Arrow UDF.

    ``ok`` says whether an answer could be read; it never comes from the answer. Items keep a type of
    the known set, the length of their snippet and a page number, nothing of their content.
    """

    def first_object(text: str) -> dict | None:
        depth, start, quoted, skip = 0, -1, False, False
        for i, c in enumerate(text):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"' and depth:
                quoted = True
            elif c == "{":
                start, depth = (i if depth == 0 else start), depth + 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    try:
                        found = json.loads(text[start : i + 1])
                    except ValueError:
                        return None
                    return found if isinstance(found, dict) else None
        return None

    def verdict(text: str | None) -> tuple:
        closed = (False, "high", [], "needs_human_review", False)
        found = first_object(text or "")
        if found is None or not isinstance(found.get("approved"), bool) or found.get("risk_level") not in RISK:
            return closed
        items = found.get("remaining_sensitive_items", [])
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            return closed
        return (found["approved"], found["risk_level"], [safe_item(i) for i in items], str(found.get("recommended_next_action", "needs_human_review")), True)

    @F.pandas_udf(VERDICT)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict(v) for v in values], columns=["approved", "risk_level", "items", "next_action", "ok"])

    return run(raw)


def risk_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RISK]), level), F.lit(3))


def clean_approval(approved: Column, action: Column, n_items: Column, level: Column, most: str = "low") -> Column:
    """Approved, asked to approve, nothing left, risk no higher than ``most``; null is never clean."""
    return F.coalesce(approved & (action == "approve") & (n_items == 0) & (risk_rank(level) <= RISK.index(most) + 1), F.lit(False))


def combined(heuristic: Column, model: Column, required: bool = True) -> Column:
    """struct<approved, risk_level, n_items, llm_ok> of a row's two audits (structs of ``judged`` and of a verdict).

    Approved only if both are clean, the worse risk, at most 30 items. Without a readable model verdict
    the result fails closed, or is the heuristic's where none is required.
    """
    ok = F.coalesce(model["ok"], F.lit(False))
    n_model = F.coalesce(F.greatest(F.size(model["items"]), F.lit(0)), F.lit(0))
    m_clean = ok & clean_approval(model["approved"], model["next_action"], n_model, model["risk_level"])
    approved = heuristic["approved"] & (m_clean if required else F.when(ok, m_clean).otherwise(True))
    worst = F.greatest(risk_rank(heuristic["risk_level"]), F.when(ok, risk_rank(model["risk_level"])).otherwise(F.lit(3) if required else F.lit(1)))
    items = F.least(F.lit(MOST_COMBINED), heuristic["n_found"] + F.when(ok, n_model).otherwise(0))
    return F.struct(approved.alias("approved"), F.element_at(F.array(*[F.lit(r) for r in RISK]), worst.cast("int")).alias("risk_level"), items.alias("n_items"), ok.alias("llm_ok"))


def combined_audit(heuristic: DataFrame, model: DataFrame, required: bool = True, doc: str = "doc_id") -> DataFrame:
    """``combined`` of two tables by document; one without a model verdict counts as unreadable."""
    h = heuristic.select(doc, F.struct("approved", "risk_level", "n_found").alias("h"))
    m = model.select(doc, F.struct("approved", "risk_level", "items", "next_action", "ok").alias("m"))
    return h.join(m, doc, "left").select(doc, combined(F.col("h"), F.col("m"), required).alias("c")).select(doc, "c.*")


def route(state: DataFrame) -> DataFrame:
    """Rows (clean, llm_ok, blocking, pending, has_output, ...) with status and reasons; null llm_ok never approves."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = flag("llm_ok") & flag("clean") & ~F.coalesce(F.col("blocking"), F.lit(True)) & (F.coalesce(F.col("pending"), F.lit(1)) == 0) & flag("has_output")
    reasons = F.array_compact(F.array(
        F.when(~flag("llm_ok"), "auditor_unavailable"),
        F.when(~flag("clean"), "residual_risk"),
        F.when(F.coalesce(F.col("blocking"), F.lit(True)), "blocked"),
        F.when(F.coalesce(F.col("pending"), F.lit(1)) > 0, "open_findings"),
        F.when(~flag("has_output"), "no_output"),
    ))
    return state.withColumn("status", F.when(ok, "approved").otherwise("needs_human_review")).withColumn("reasons", F.array_join(reasons, ","))


def digest(text: Column) -> Column:
    """sha256 of the masked text."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)


def value_hash(value: Column) -> Column:
    """What reports carry instead of a value: 16 hex digits of its sha256."""
    return F.substring(F.sha2(F.encode(value, "utf-8"), 256), 1, 16)


#: Allowed steps of a document's status.
STEPS = {
    "queued": ("extracted", "failed"),
    "extracted": ("masking", "failed"),
    "masking": ("auditing", "failed"),
    "auditing": ("approved", "needs_human_review", "failed"),
    "needs_human_review": ("approved", "rejected", "masking"),
    "approved": ("needs_human_review",),
    "rejected": (),
    "failed": ("queued",),
}


def step_allowed(old: Column, new: Column) -> Column:
    table = F.create_map(*[x for s, to in STEPS.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, old), new), F.lit(False))
