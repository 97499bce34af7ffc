"""Seeded test corpora: people, documents with known values, canaries. Pure expressions over ``range``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import checks

#: Word lists of the generator (fixed values, invented).
FIRST = ("Ada", "Bora", "Cem", "Defne", "Ece", "Filiz", "Gamze", "Hakan")
LAST = ("Aksoy", "Bulut", "Candan", "Duran", "Erdem", "Fidan", "Güneş")
DOMAINS = ("legal", "health", "finance", "hr", "support", "research")
SPLITS = ("dev", "dev", "public", "holdout")


def pick(values: tuple[str, ...], at: Column) -> Column:
    """The value at ``at`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def people(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(subject_id, name, email, phone, tckn, iban, card): every number passes its checksum."""
    k = F.col("id") * 7919 + seed * 104729
    nine = F.format_string("%09d", k % 899_999_999 + 100_000_000)
    name = F.concat(pick(FIRST, k), F.lit(" "), pick(LAST, F.floor(k / 8)))
    return spark.range(n).select(
        F.concat(F.lit("S"), "id").alias("subject_id"),
        name.alias("name"),
        F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"),
        F.format_string("+1 (%03d) 555-%04d", k % 800 + 200, k % 9000 + 1000).alias("phone"),
        checks.tckn_complete(nine).alias("tckn"),
        checks.iban_complete(F.lit("TR"), F.lpad((k % 10_000_000_000).cast("string"), 22, "0")).alias("iban"),
        checks.luhn_complete(F.concat(F.lit("453211"), F.substring(nine, 1, 9))).alias("card"),
    )


#: What each domain's documents say (invented); names of fields stand for a person's values.
TEMPLATES = {
    "legal": ("AGREEMENT\nThis contract is made with {name}.", "Identity number: {tckn}.", "Notices go to {email} or {phone}.", "Payment to IBAN {iban}.", "Signed by both parties."),
    "health": ("Clinic letter\nPatient: {name}.", "kimlik no {tckn}.", "Call {phone} for results.", "Mail reports to {email}.", "Fees by card {card}, refunds to {iban}."),
    "finance": ("Statement of account\nHolder {name}.", "iban {iban}, card {card}.", "Questions: {email}, phone {phone}.", "tckn {tckn}."),
    "hr": ("Staff file\nEmployee {name} joined the team.", "Salary is paid to {iban}.", "Contact: {phone}; {email}.", "kimlik {tckn}, company card {card}."),
    "support": ("Ticket\nDear {name},", "we wrote to {email} and rang {phone}.", "Your card {card} was charged twice.", "Please confirm {iban} and tckn {tckn}."),
    "research": ("Interview notes\nSubject {name} agreed.", "Reach them at {phone}.", "Expenses to {iban}, or card {card}.", "Consent by {email}; kimlik {tckn}."),
}
FIELDS = ("name", "email", "phone", "tckn", "iban", "card")


def _written(sentences: tuple[str, ...]) -> Column:
    parts = []
    for piece in re.split(r"(\{\w+\})", "\n".join(sentences)):
        if piece:
            parts.append(F.col(piece[1:-1]) if piece.startswith("{") else F.lit(piece))
    return F.concat(*parts)


def gold_documents(spark: SparkSession, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions): one person's values in the text of a domain, with where each of them stands."""
    rows = people(spark, n, seed).withColumn("n", F.substring("subject_id", 2, 9).cast("int"))
    docs = rows.withColumn("domain", pick(DOMAINS, F.col("n"))).withColumn("split", pick(SPLITS, F.floor(F.col("n") / 6)))
    docs = docs.withColumn("text", F.coalesce(*[F.when(F.col("domain") == d, _written(t)) for d, t in TEMPLATES.items()])).withColumnRenamed("subject_id", "doc_id")
    values = F.array(*[F.struct(F.lit(f).alias("entity_type"), F.col(f).alias("surface")) for f in FIELDS])
    m = docs.select("doc_id", "text", F.explode(values).alias("v")).select("doc_id", "text", "v.*").where(F.contains("text", F.col("surface")))
    start = F.instr("text", F.col("surface")) - 1
    mentions = m.select("doc_id", F.concat("doc_id", F.lit("-"), "entity_type").alias("mention_id"), "entity_type", "surface", start.alias("start"), (start + F.char_length("surface")).alias("end"))
    return docs.select("doc_id", "domain", "split", "text"), mentions


#: The canary catalogue as (id, value, family, context word, critical, found by general recognizers).
CANARIES = (
    ("prs_tr", "Kemal Vardar", "PERSON", "Sayın", True, True),
    ("prs_en", "Jonathan Whitfield", "PERSON", "Mr.", True, True),
    ("gsm_tr", "0532 764 21 09", "PHONE", "cep", True, True),
    ("lnd_tr", "0212 555 34 76", "PHONE", "tel", True, True),
    ("phn_uk", "+44 7911 123456", "PHONE", "phone", True, True),
    ("eml", "kemal.vardar@ornekposta.com", "EMAIL", "e-posta", True, True),
    ("adr", "Bağdat Caddesi No 145 Kadıköy İstanbul", "LOCATION", "adres", True, False),
    ("iban", "TR84 0009 1000 8765 4321 0987 65", "IBAN", "IBAN", True, True),
    ("card", "4111 1111 1111 1111", "CARD", "kart", True, True),
    ("acct", "8842-556310-04", "ACCOUNT", "Müşteri No", True, False),
    ("ip", "192.168.14.203", "IP", "IP", False, True),
    ("secret", "sk_live_9Qm2fXbT7hVrN4KpLZ", "SECRET", "secret", True, False),
    ("url_tok", "https://portal.ornek.com/r?token=aZ39Kp7Qw12M", "URL", "link", True, True),
    ("plate", "34 KVR 218", "PLATE", "plaka", False, True),
    ("passport", "U12345678", "PASSPORT", "passport", True, True),
)


def canaries(spark: SparkSession) -> DataFrame:
    """(canary_id, value, expected_family, context, critical, base_detectable): the catalogue, and a made TCKN."""
    schema = "canary_id string, value string, expected_family string, context string, critical boolean, base_detectable boolean"
    tckn = people(spark, 1, 42).select(F.lit("tckn").alias("canary_id"), F.col("tckn").alias("value"), F.lit("TCKN").alias("expected_family"), F.lit("TCKN").alias("context"), F.lit(True).alias("critical"), F.lit(True).alias("base_detectable"))
    return spark.createDataFrame(list(CANARIES), schema).unionByName(tckn)


def placements(spark: SparkSession) -> DataFrame:
    """Every canary bare, after its context word and in its two other spellings: (marker, canary_id, variant, value, text)."""
    c = canaries(spark)
    ways = F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("value")) for n, v in (("bare", F.col("value")), ("contextual", F.col("value")), ("line_break", F.regexp_replace("value", r"^(\S+) ", "$1\n")), ("case_space", F.regexp_replace(F.upper("value"), " ", "  ")))])
    one = c.select("canary_id", "expected_family", "context", F.explode(ways).alias("w")).select("canary_id", "expected_family", "context", "w.*")
    text = F.when(F.col("variant") == "bare", F.col("value")).otherwise(F.concat("context", F.lit(": "), "value"))
    return one.select(F.concat("canary_id", F.lit("-"), "variant").alias("marker"), "canary_id", "variant", "expected_family", "value", text.alias("text"))


#: The formats in which a stress scenario makes sense; those that must close; those that cannot reach an export.
SCENARIOS = {
    "split_run_pii": ("pdf", "docx", "xlsx"), "header_footer": ("pdf", "docx", "xlsx"), "comment": ("docx", "xlsx"), "hidden_sheet": ("xlsx",),
    "sheet_name": ("xlsx",), "metadata": ("pdf", "docx", "xlsx"), "external_link": ("pdf", "docx", "xlsx"), "scanned_image": ("pdf",),
    "pdf_form_annotation": ("pdf",), "corrupt_ooxml": ("docx", "xlsx"), "zip_bomb": ("docx", "xlsx"), "format_variants": ("pdf", "docx", "xlsx"),
}
MUST_CLOSE, SAFE = ("corrupt_ooxml", "zip_bomb"), ("metadata", "external_link")


def stress_plan(spark: SparkSession, n: int = 72, seed: int = 1) -> DataFrame:
    """(case_id, fmt, scenario, expected, architecturally_safe, planted_values): ``n`` cases dealt over formats and scenarios in turn."""
    pairs = [(f, s) for f in ("pdf", "docx", "xlsx") for s, formats in SCENARIOS.items() if f in formats]
    table = F.array(*[F.struct(F.lit(f).alias("fmt"), F.lit(s).alias("scenario")) for f, s in pairs])
    p = people(spark, n, seed).withColumn("k", F.substring("subject_id", 2, 9).cast("int")).withColumn("c", F.element_at(table, F.col("k") % len(pairs) + 1))
    case = F.concat_ws("-", F.col("c.fmt"), F.col("c.scenario"), F.format_string("%02d", F.col("k")))
    expected = F.when(F.col("c.scenario").isin(*MUST_CLOSE), "fail_closed").otherwise("safe_output")
    return p.select(case.alias("case_id"), "c.fmt", "c.scenario", expected.alias("expected"), F.col("c.scenario").isin(*SAFE).alias("architecturally_safe"), F.array("email", "phone", "iban").alias("planted_values"))
