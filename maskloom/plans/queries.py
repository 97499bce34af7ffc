"""Registered queries: each applies one operator to whole tables; ``SQL`` says the same in plain SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.functions.spans import regex_spans
from maskloom.operators import audit, detect, lists, mask, metrics, propagate, report, retrieval, tables, units
from maskloom.operators import recognizers as R
from maskloom.plans import masking
from maskloom.plans.registry import QUERIES, SQL, query
from maskloom.session import ship
from maskloom.sources import synthetic, uploads
from maskloom.streaming import pipeline as streaming

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def _quoted(pattern: str) -> str:
    """A pattern as an SQL string. The other engine has no look-around: the digits that these keep out are in the run anyway."""
    return "'" + pattern.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace("'", "''") + "'"


def _spans_sql(pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """SELECT of (key, start, end, value): running sums over matches and the gaps between them."""
    p = _quoted(pattern)
    return f"""SELECT {key}, CAST(a AS INTEGER) AS "start", CAST(a + length(value) AS INTEGER) AS "end", value FROM (
  SELECT {key}, m[i] AS value, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {table})))"""


_LUHN = """(list_sum(list_transform(range(1, length(value) + 1), lambda i:
    CASE WHEN (length(value) - i) % 2 = 0 THEN CAST(value[i] AS INTEGER)
         WHEN CAST(value[i] AS INTEGER) > 4 THEN CAST(value[i] AS INTEGER) * 2 - 9 ELSE CAST(value[i] AS INTEGER) * 2 END)) % 10 = 0)"""

_FOUND = f"""sp AS (
  SELECT *, 'EMAIL_ADDRESS' AS entity_type, 1.0 AS score, 'EMAIL' AS family FROM ({_spans_sql(R.EMAIL)})
  UNION ALL SELECT *, 'IP_ADDRESS', 0.6, 'IP' FROM ({_spans_sql(R.IPV4)})
  UNION ALL SELECT *, 'CREDIT_CARD', 1.0, 'CARD' FROM ({_spans_sql(R.CARD)}) WHERE {_LUHN}
  UNION ALL SELECT *, 'PHONE_NUMBER', 0.75, 'PHONE' FROM ({_spans_sql(R.PHONE)})
)"""
_TOKENS = (
    _FOUND
    + r""", keyed AS (
  SELECT *, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS k FROM sp
), firsts AS (
  SELECT *, min("start") OVER (PARTITION BY doc_id, family, k) AS first_at FROM keyed
), tok AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, family ORDER BY first_at, k) AS INTEGER) AS n FROM firsts
), tokens AS (
  SELECT doc_id, "start", "end", value, entity_type, family, n, '<' || family || '_' || n || '>' AS token FROM tok
)"""
)
_MASKED = (
    _TOKENS
    + """, steps AS (
  SELECT t.doc_id, t."start" AS s, token, d.text,
         coalesce(lag(t."end") OVER w, 0) AS prev, lead(t."start") OVER w IS NULL AS is_last, t."end" AS e
  FROM tokens t JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY t.doc_id ORDER BY t."start")
), built AS (
  SELECT doc_id, string_agg(substr(text, prev + 1, s - prev) || token || CASE WHEN is_last THEN substr(text, e + 1) ELSE '' END, '' ORDER BY s) AS masked_text, count(*) AS n
  FROM steps GROUP BY doc_id
), masked AS (
  SELECT d.doc_id, coalesce(masked_text, d.text) AS masked_text, CAST(coalesce(n, 0) AS INTEGER) AS n_masked, d.text FROM documents d LEFT JOIN built USING (doc_id)
)"""
)


def _found(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(_docs(spark, d), R.PLAIN)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return mask.numbered(masking.resolved_spans(_docs(spark, d), R.PLAIN))


# --- detection ---


def _pattern_query(name: str, pattern: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", F.explode(regex_spans(F.col("text"), pattern)).alias("s")).select("doc_id", "s.*")

    run.__name__ = name
    query(_spans_sql(pattern))(run)


for _name, _p in (("email_spans", R.EMAIL), ("ipv4_spans", R.IPV4), ("phone_spans", R.PHONE), ("secret_key_spans", R.HEX_KEY)):
    _pattern_query(_name, _p)


@query(f"SELECT * FROM ({_spans_sql(R.CARD)}) WHERE {_LUHN}")
def card_luhn_spans(spark, d):
    return _found(spark, d).where("entity_type = 'CREDIT_CARD'").select("doc_id", "start", "end", "value")


@query(_spans_sql(R.URL, "(SELECT page_id, 'see <' || url || '> and ' || html AS body FROM pages)", "page_id", "body"))
def page_url_spans(spark, d):
    body = F.concat(F.lit("see <"), "url", F.lit("> and "), "html")
    return _t(spark, d, "pages").select("page_id", F.explode(regex_spans(body, R.URL)).alias("s")).select("page_id", "s.*")


@query(f"""WITH {_FOUND} SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum("end" - "start") AS BIGINT) AS chars FROM sp GROUP BY 1""")
def detection_counts(spark, d):
    return _found(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(f"""WITH s AS (SELECT * FROM ({_spans_sql(R.HEX_KEY)})), c AS (
  SELECT s.*, lower(substr(text, greatest("start" - 60, 0) + 1, least("start", 60)) || ' ' || substr(text, "end" + 1, 20)) AS near FROM s JOIN documents USING (doc_id))
SELECT doc_id, "start", "end", CASE WHEN contains(near, 'token') OR contains(near, 'key') THEN 0.5 ELSE 0.15 END AS score FROM c""")
def context_uplift(spark, d):
    """A hit's base score rises by 0.35 next to a context word."""
    r = R.Recognizer("SECRET_KEY", R.HEX_KEY, 0.15, ("token", "key"))
    return detect.detect(_docs(spark, d), (r,), threshold=0.0).select("doc_id", "start", "end", "score")


@query()
def detect_all(spark, d):
    """Every recognizer, look-arounds and all, then the gates."""
    docs = _docs(spark, d)
    spans = detect.detect(docs, R.ALL, keys=("doc_id", "text"))
    return detect.gated(spans).drop("text")


@query()
def line_wrapped_spans(spark, d):
    return detect.line_wrapped(_docs(spark, d), R.PLAIN)


@query("""WITH n AS (SELECT o_orderkey, CAST(100000000 + o_orderkey * 7919 % 900000000 AS VARCHAR) AS nine FROM orders), x AS (
  SELECT o_orderkey, nine, list_transform(range(1, 10), lambda i: CAST(nine[i] AS INTEGER)) AS g FROM n), y AS (
  SELECT *, ((7 * (g[1] + g[3] + g[5] + g[7] + g[9]) - (g[2] + g[4] + g[6] + g[8])) % 10 + 10) % 10 AS t FROM x)
SELECT o_orderkey, nine || t || ((list_sum(g) + t) % 10) AS tckn, true AS valid, false AS broken FROM y""")
def tckn_checksum(spark, d):
    n = _t(spark, d, "orders").select("o_orderkey", F.expr("cast(100000000 + o_orderkey * 7919 % 900000000 as string)").alias("nine"))
    full = n.select("o_orderkey", checks.tckn_complete(F.col("nine")).alias("tckn"))
    other = F.concat(F.substring("tckn", 1, 10), ((F.substring("tckn", 11, 1).cast("int") + 1) % 10).cast("string"))
    return full.select("o_orderkey", "tckn", checks.tckn_valid(F.col("tckn")).alias("valid"), checks.tckn_valid(other).alias("broken"))


@query("""WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS account FROM customer)
SELECT c_custkey, 'TR' || lpad(CAST(98 - CAST(account || '292700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || account AS iban, true AS valid FROM a""")
def iban_checksum(spark, d):
    a = _t(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 22, "0").alias("account"))
    return a.select("c_custkey", checks.iban_complete(F.lit("TR"), F.col("account")).alias("iban")).withColumn("valid", checks.iban_valid(F.col("iban")))


@query("""WITH a AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 15, '4') AS p FROM orders), s AS (
  SELECT o_orderkey, p, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(p[i] AS INTEGER)
    WHEN CAST(p[i] AS INTEGER) > 4 THEN CAST(p[i] AS INTEGER) * 2 - 9 ELSE CAST(p[i] AS INTEGER) * 2 END)) AS t FROM a)
SELECT o_orderkey, p || ((10 - t % 10) % 10) AS card, true AS valid FROM s""")
def luhn_cards(spark, d):
    cards = _t(spark, d, "orders").select("o_orderkey", checks.luhn_complete(F.lpad(F.col("o_orderkey").cast("string"), 15, "4")).alias("card"))
    return cards.withColumn("valid", checks.card_valid(F.col("card")))


def _nested(text: str, pairs) -> str:
    for label, p in pairs:
        text = f"regexp_replace({text}, {_quoted(p)}, '{label}', 'g')"
    return text


#: The other engine's word bounds know ASCII only: the gap before a letter beyond it is taken off a card run after the fact.
_LOGGED = [x for n, p in audit.LOG_PATTERNS for x in ((f"<{n}_REDACTED>", p), *([(r"<CARD_REDACTED>\1", r"<CARD_REDACTED>[ -](\pL)")] if n == "CARD" else []))]


@query(f"SELECT doc_id, sha256({_nested('text', _LOGGED)}) AS redacted_sha FROM documents")
def log_redaction(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(audit.redacted(F.col("text")), 256).alias("redacted_sha"))


@query(f"SELECT conv_id, turn, {_nested('text', [('<EMAIL>', audit.LOG_PATTERNS[0][1]), ('<NUM>', audit.NUMBERS)])} AS text FROM conversations")
def mini_redact(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", audit.mini_redacted(F.col("text")).alias("text"))


# --- lists, gates, units ---

_DENY = {"idiot": "INSULT", "the the": None, "de la": "PLACE"}


@query(
    " UNION ALL ".join(
        f"""SELECT doc_id, "start", "end", value, '{"USER:" + f if f else "SENSITIVE"}' AS entity_type, 1.0::DOUBLE AS score, 'deny' AS source FROM ({_spans_sql("(?i)" + t.replace(" ", "[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]+"))})"""
        for t, f in _DENY.items()
    )
)
def deny_spans(spark, d):
    return lists.deny_spans(_docs(spark, d), _DENY)


@query(f"""WITH {_FOUND}, r AS (SELECT doc_id, "start" - 1 AS s, "end" + 1 AS e FROM sp WHERE length(value) % 2 = 0)
SELECT doc_id, "start", "end", entity_type FROM sp WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = sp.doc_id AND r.s <= sp."start" AND sp."end" <= r.e)""")
def allow_filter(spark, d):
    """Spans inside an allowed range drop out: an anti join on containment."""
    spans = _found(spark, d)
    ranges = spans.where(F.char_length("value") % 2 == 0).select("doc_id", (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
    return lists.not_contained(spans, ranges).select("doc_id", "start", "end", "entity_type")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: regexp_replace(x, '^[,;:()"''’]+|[,;:()"''’]+$', '', 'g')), lambda x: regexp_full_match(x, '\pL+')) AS w FROM l), c AS (
  SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS caps FROM w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE n >= 4 AND caps * 5 >= n * 4) AS n_caps FROM c GROUP BY doc_id""")
def caps_lines(spark, d):
    """The capitals-line gate on whole lines."""
    line = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(detect.caps_line(F.col("line"), F.lit(0), F.char_length("line"))).alias("n_caps"))


@query("""SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS unit_ord,
  role || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS unit_id, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)""")
def unit_explode(spark, d):
    blocks = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("block_id"), "text")
    return units.explode_units(blocks)


@query("""SELECT source, CASE WHEN coalesce(bool_or(lang = 'mixed'), false) OR (coalesce(bool_or(lang = 'fr'), false) AND coalesce(bool_or(lang = 'de'), false)) THEN 'mixed'
  WHEN coalesce(bool_or(lang = 'fr'), false) THEN 'fr' WHEN coalesce(bool_or(lang = 'de'), false) THEN 'de' ELSE 'unknown' END AS language
FROM (SELECT source || '-' || doc_id % 40 AS source, lang FROM documents) GROUP BY source""")
def language_rollup(spark, d):
    docs = _t(spark, d, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id") % 40).alias("source"), "lang")
    return units.language_rollup(docs, "source", a="fr", b="de")


_CELLS = """cells AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS row, 0 AS col, max(CAST(l_partkey AS VARCHAR)) AS text FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT l_orderkey, l_linenumber, 2, max(l_returnflag) FROM lineitem GROUP BY 1, 2)"""


def _cells(spark, d):
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"))
    one = g.agg(F.max(F.col("l_partkey").cast("string")).alias("a"), F.max("l_returnflag").alias("b"))
    cells = F.array(F.struct(F.lit(0).alias("col"), F.col("a").alias("text")), F.struct(F.lit(2).alias("col"), F.col("b").alias("text")))
    return one.select("doc_id", F.lit("t").alias("block_id"), "row", F.explode(cells).alias("c")).select("doc_id", "block_id", "row", "c.*")


@query(f"""WITH {_CELLS}, l AS (SELECT doc_id, row, string_agg(text, ' | ' ORDER BY col) AS line FROM cells GROUP BY 1, 2)
SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY 1""")
def plain_table_text(spark, d):
    return units.plain_rows(_cells(spark, d)).select("doc_id", "text")


@query(f"""WITH {_CELLS} SELECT doc_id, row, [max(text) FILTER (WHERE col = 0), '', max(text) FILTER (WHERE col = 2)] AS "values" FROM cells GROUP BY 1, 2""")
def dense_table_rows(spark, d):
    return units.dense_rows(_cells(spark, d).withColumn("ord", F.lit(0))).select("doc_id", "row", "values")


@query(r"""WITH n AS (SELECT page_id, 'Rapor <' || page_id || '> ' || url || ['.PDF', '.docx', '.xlsx', '.txt'][page_id % 4 + 1] AS name FROM pages)
SELECT page_id, nullif(regexp_extract(lower(name), '\.(pdf|docx|xlsx)$', 1), '') AS kind,
  substr(regexp_replace(regexp_replace(regexp_replace(name, '[<>]', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80) AS safe FROM n""")
def file_names(spark, d):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".docx", ".xlsx", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    n = _t(spark, d, "pages").select("page_id", F.concat(F.lit("Rapor <"), "page_id", F.lit("> "), "url", ending).alias("name"))
    return n.select("page_id", units.file_kind(F.col("name")).alias("kind"), uploads.safe_name(F.col("name")).alias("safe"))


# --- masking ---


@query(f"""WITH {_TOKENS} SELECT doc_id, "start", "end", family, n, token FROM tokens""")
def placeholder_numbering(spark, d):
    return _tokens(spark, d).select("doc_id", "start", "end", "family", "n", "token")


@query(f"WITH {_MASKED} SELECT doc_id, sha256(masked_text) AS masked_sha, n_masked FROM masked")
def masked_text_splice(spark, d):
    masked = masking.masked_rows(_docs(spark, d), R.PLAIN)
    return masked.select("doc_id", audit.digest(F.col("masked_text")).alias("masked_sha"), "n_masked")


_EDITS = (
    _TOKENS
    + """, ed AS (
  SELECT *, "start" + coalesce(sum(length(token) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ms FROM tokens)"""
)


@query(f"""WITH {_EDITS} SELECT doc_id, "start", "end", token, CAST(ms AS BIGINT) AS masked_start, CAST(ms + length(token) AS BIGINT) AS masked_end FROM ed""")
def edit_offsets(spark, d):
    return mask.edits(_tokens(spark, d)).select("doc_id", "start", "end", "token", "masked_start", "masked_end")


@query(f"""WITH {_EDITS}, p AS (SELECT doc_id, unnest([0, 50, 500, 5000]) AS pos FROM documents)
SELECT p.doc_id, CAST(p.pos AS INTEGER) AS pos, CAST(p.pos + coalesce(max_by(e."end" - e.ms - length(token), e.ms), 0) AS BIGINT) AS original_pos
FROM p LEFT JOIN ed e ON e.doc_id = p.doc_id AND e.ms + length(token) <= p.pos GROUP BY p.doc_id, p.pos""")
def original_offsets(spark, d):
    points = _docs(spark, d).select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 50, 500, 5000)])).alias("pos"))
    return mask.original_offset(points, mask.edits(_tokens(spark, d)))


@query(f"WITH {_TOKENS} SELECT doc_id, family, max(n) AS placeholders, count(*) AS edits FROM tokens GROUP BY 1, 2")
def family_counts(spark, d):
    return mask.family_counts(_tokens(spark, d))


@query(f"WITH {_TOKENS} SELECT doc_id, 'pattern' AS source, count(*) AS n FROM tokens GROUP BY 1")
def source_counts(spark, d):
    return mask.source_counts(_tokens(spark, d))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_masked, CAST(0 AS INTEGER) AS n_unmapped FROM tokens GROUP BY 1")
def reverse_mapping(spark, d):
    """Every token of a masked text is in the mapping, and putting values back leaves no token."""
    masked, tokens = masking.mask_documents(_docs(spark, d), R.PLAIN)
    back = mask.unmasked(masked.where("n_masked > 0"), mask.mapping(tokens))
    return back.select("doc_id", "n_masked", F.size("unmapped").alias("n_unmapped"))


@query()
def masked_documents(spark, d):
    """The whole plan with all recognizers: masked text, audit, status."""
    return masking.process(_docs(spark, d), recognizers=R.ALL)


@query()
def repair_round(spark, d):
    """Documents after the mask-audit-repair rounds."""
    out = masking.repaired(_docs(spark, d), R.PLAIN)
    return out.select("doc_id", audit.digest(F.col("masked_text")).alias("digest"), "n_left")


@query()
def value_variants(spark, d):
    """Masked values that stand elsewhere in their document in another spelling."""
    ship(spark)
    spans = masking.resolved_spans(_docs(spark, d), R.PLAIN).withColumn("unit_id", F.lit("b0"))
    lines = _docs(spark, d).withColumn("unit_id", F.lit("b0"))
    return propagate.variants(lines, propagate.needles(spans))


@query()
def table_run_merges(spark, d):
    """Card numbers cut over two cells of a row."""
    card = checks.luhn_complete(F.lpad(F.col("o_orderkey").cast("string"), 15, "4"))
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("t").alias("block_id"), F.lit(0).alias("row"), card.alias("c"))
    cells = F.array(F.struct(F.lit(0).alias("col"), F.substring("c", 1, 8).alias("text")), F.struct(F.lit(1).alias("col"), F.substring("c", 9, 8).alias("text")))
    cells = rows.select("doc_id", "block_id", "row", F.explode(cells).alias("c")).select("doc_id", "block_id", "row", "c.*")
    return tables.run_merges(cells).drop("value")


# --- audit and state ---


def _count_sql(p: str) -> str:
    return f"len(regexp_extract_all(bare, {_quoted(p)}))"


@query(f"""WITH b AS (SELECT doc_id, regexp_replace(text, '<[A-Z_]+_[0-9]+>', ' ', 'g') AS bare FROM documents), c AS (
  SELECT doc_id, {" + ".join(_count_sql(p) for _, p in audit.HARD_PATTERNS)} + len(list_filter(regexp_extract_all(bare, '\\b[0-9]+\\b'), lambda v: CASE WHEN length(v) = 11 THEN v[1] <> '0'
    AND CAST(v[10] AS INTEGER) = ((7 * (CAST(v[1] AS INTEGER) + CAST(v[3] AS INTEGER) + CAST(v[5] AS INTEGER) + CAST(v[7] AS INTEGER) + CAST(v[9] AS INTEGER)) - (CAST(v[2] AS INTEGER) + CAST(v[4] AS INTEGER) + CAST(v[6] AS INTEGER) + CAST(v[8] AS INTEGER))) % 10 + 10) % 10
    AND CAST(v[11] AS INTEGER) = list_sum(list_transform(range(1, 11), lambda i: CAST(v[i] AS INTEGER))) % 10 ELSE false END)) AS n FROM b)
SELECT doc_id, n = 0 AS approved, CASE WHEN n > 0 THEN 'high' ELSE 'low' END AS risk_level, CAST(n AS BIGINT) AS n_found FROM c""")
def heuristic_audit(spark, d):
    return audit.heuristic_audit(_docs(spark, d), "text").drop("codes")


_STATE = """s AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 0 AS clean, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS llm_ok,
  o_orderkey % 11 = 0 AS blocking, o_orderkey % 3 AS pending, o_orderkey % 13 <> 0 AS has_output FROM orders)"""


@query(f"""WITH {_STATE} SELECT doc_id, CASE WHEN coalesce(llm_ok, false) AND clean AND NOT blocking AND pending = 0 AND has_output THEN 'approved' ELSE 'needs_human_review' END AS status,
  concat_ws(',', CASE WHEN NOT coalesce(llm_ok, false) THEN 'auditor_unavailable' END, CASE WHEN NOT clean THEN 'residual_risk' END, CASE WHEN blocking THEN 'blocked' END,
    CASE WHEN pending > 0 THEN 'open_findings' END, CASE WHEN NOT has_output THEN 'no_output' END) AS reasons FROM s""")
def route_status(spark, d):
    k = F.col("o_orderkey")
    state = _t(spark, d, "orders").select(k.alias("doc_id"), (k % 5 != 0).alias("clean"), F.when(k % 7 == 1, False).when(k % 7 != 0, True).alias("llm_ok"), (k % 11 == 0).alias("blocking"), (k % 3).alias("pending"), (k % 13 != 0).alias("has_output"))
    return audit.route(state).select("doc_id", "status", "reasons")


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS vhash FROM documents")
def audit_digest(spark, d):
    return _docs(spark, d).select("doc_id", audit.digest(F.col("text")).alias("digest"), audit.value_hash(F.col("text")).alias("vhash"))


@query(
    "WITH s(old, new) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, to in audit.STEPS.items() for b in to)
    + "), p AS (SELECT event_id, user_id, event_type, ['queued','extracted','masking','auditing','approved','needs_human_review','rejected','failed'][event_id % 8 + 1] AS old, ['queued','extracted','masking','auditing','approved','needs_human_review','rejected','failed'][user_id % 8 + 1] AS new FROM events)"
    + " SELECT p.old AS old, p.new AS new, count(*) AS n, bool_or(s.old IS NOT NULL) AS allowed FROM p LEFT JOIN s ON s.old = p.old AND s.new = p.new GROUP BY 1, 2"
)
def status_steps(spark, d):
    names = F.array(*[F.lit(s) for s in ("queued", "extracted", "masking", "auditing", "approved", "needs_human_review", "rejected", "failed")])
    at = lambda c: F.element_at(names, (F.col(c) % 8 + 1).cast("int"))
    rows = _t(spark, d, "events").select(at("event_id").alias("old"), at("user_id").alias("new"))
    return rows.groupBy("old", "new").agg(F.count("*").alias("n"), F.bool_or(audit.step_allowed(F.col("old"), F.col("new"))).alias("allowed"))


# --- retrieval ---


_QUERY = "the of inthan scum the"


@query("""WITH q AS (SELECT unnest(['the', 'of', 'inthan', 'scum', 'the']) AS t), k AS (SELECT t, count(*) AS m FROM q GROUP BY t), d AS (
  SELECT doc_id, 1 AS part, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), f AS (
  SELECT doc_id, part, len(w) AS l, t, m, len(list_filter(w, lambda x: x = t)) AS tf FROM d CROSS JOIN k), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM f GROUP BY t), r AS (
  SELECT doc_id, part, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM f JOIN df USING (t) CROSS JOIN s GROUP BY doc_id, part)
SELECT doc_id, part, score, 'S' || row_number() OVER (ORDER BY score DESC, doc_id) AS id FROM r ORDER BY score DESC, doc_id LIMIT 8""")
def bm25_topk(spark, d):
    chunks = _docs(spark, d).withColumn("part", F.lit(1))
    return retrieval.sourced(retrieval.bm25(chunks, _QUERY, 8)).select("doc_id", "part", F.round("score", 6).alias("score"), "id")


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 400), '<[A-Z_]*[0-9]*$', '')) || '…' END AS excerpt FROM f""")
def excerpts(spark, d):
    return _docs(spark, d).select("doc_id", retrieval.excerpt(F.col("text")).alias("excerpt"))


@query(r"""WITH a AS (SELECT conv_id, turn, 'a [S' || (turn + 1) || '] b [S1, S' || (turn + 2) || '] c [S9' || CASE WHEN turn % 2 = 0 THEN ']' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(t, '(S[0-9]+), (S[0-9])', '\1][\2', 'g') AS normal, turn % 2 = 0 OR turn IN (7, 8) AS valid FROM a""")
def citation_check(spark, d):
    t = F.concat(F.lit("a [S"), F.col("turn") + 1, F.lit("] b [S1, S"), F.col("turn") + 2, F.lit("] c [S9"), F.when(F.col("turn") % 2 == 0, "]").otherwise(""))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    known = F.array(F.lit("S1"), F.concat(F.lit("S"), F.col("turn") + 1), F.concat(F.lit("S"), F.col("turn") + 2), F.lit("S9"))
    seen = F.array_contains(retrieval.citations(F.col("t")), "S9")
    return rows.select("conv_id", "turn", retrieval.normal_citations(F.col("t")).alias("normal"), (retrieval.citations_valid(F.col("t"), known) & seen).alias("valid"))


@query(f"""SELECT conv_id, turn, role, substr({_nested('text', [('<EMAIL>', audit.LOG_PATTERNS[0][1]), ('<NUM>', audit.NUMBERS)])}, 1, 4000) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 8""")
def recent_turns(spark, d):
    return retrieval.recent_turns(_t(spark, d, "conversations"))


# --- evaluation ---

_PRED = """pred AS (SELECT doc_id, "start" + (CASE WHEN "start" % 5 = 0 THEN 2 ELSE 0 END) AS "start", "end" + 1 AS "end", family FROM sp WHERE (doc_id + "start") % 4 <> 0
  UNION ALL SELECT doc_id, "start" + 100, "end" + 103, family FROM sp WHERE doc_id % 3 = 0)"""


def _pred(gold: DataFrame) -> DataFrame:
    near = gold.where((F.col("doc_id") + F.col("start")) % 4 != 0).select("doc_id", (F.col("start") + F.when(F.col("start") % 5 == 0, 2).otherwise(0)).alias("start"), (F.col("end") + 1).alias("end"))
    far = gold.where("doc_id % 3 = 0").select("doc_id", (F.col("start") + 100).alias("start"), (F.col("end") + 103).alias("end"))
    return near.unionByName(far)


@query(f"""WITH {_FOUND}, {_PRED}, c AS (
  SELECT (SELECT count(*) FROM sp) AS n_gold, (SELECT count(*) FROM sp WHERE EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = sp.doc_id AND p."start" < sp."end" AND sp."start" < p."end")) AS n_covered,
         (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM pred p WHERE EXISTS (SELECT 1 FROM sp WHERE p.doc_id = sp.doc_id AND p."start" < sp."end" AND sp."start" < p."end")) AS n_hit), r AS (
  SELECT *, CASE WHEN n_pred = 0 THEN 1.0 ELSE n_hit / n_pred END AS precision, CASE WHEN n_gold = 0 THEN 1.0 ELSE n_covered / n_gold END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, 1 - precision AS over_masking FROM r""")
def overlap_precision_recall(spark, d):
    gold = _found(spark, d)
    return metrics.span_scores(gold, _pred(gold))


@query(f"""WITH {_FOUND}, {_PRED}, o AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pred), i AS (
  SELECT *, sum(CASE WHEN before > "start" THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC) AS g FROM o), u AS (
  SELECT doc_id, g, max("end") - min("start") AS n, sum("end" - "start") AS s FROM i GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS union_chars, CAST(sum(s) AS BIGINT) AS sum_chars, count(*) AS islands FROM u GROUP BY 1""")
def char_coverage_union(spark, d):
    return metrics.char_coverage(_pred(_found(spark, d)))


@query(f"""WITH {_FOUND}, {_PRED}, x AS (
  SELECT sp.doc_id, sp."start" AS "start", sp.entity_type AS entity_type, sp."end" - sp."start" AS total, list(DISTINCT i) FILTER (WHERE i IS NOT NULL) AS hit
  FROM sp LEFT JOIN (SELECT doc_id, unnest(range("start", "end")) AS i FROM pred) c ON c.doc_id = sp.doc_id AND c.i >= sp."start" AND c.i < sp."end" GROUP BY ALL)
SELECT doc_id, "start", entity_type, CAST(coalesce(len(hit), 0) AS INTEGER) AS detected_chars, CAST(total AS INTEGER) AS total_chars, coalesce(len(hit), 0) = total AS fully_detected,
  coalesce(len(hit), 0) > 0 AND coalesce(len(hit), 0) < total AS partially_detected FROM x""")
def mention_detection(spark, d):
    gold = _found(spark, d)
    mentions = gold.select("doc_id", "start", "end", F.col("value").alias("surface"), "entity_type")
    masked = _docs(spark, d).select("doc_id", F.col("text").alias("masked_text"))
    out = metrics.mention_results(mentions, _pred(gold), masked)
    return out.select("doc_id", "start", "entity_type", "detected_chars", "total_chars", "fully_detected", "partially_detected")


_RES = """res AS (SELECT l_orderkey AS doc_id, l_orderkey % 4000 || '-' || l_suppkey % 7 AS entity_id, l_returnflag <> 'R' OR l_linenumber > 3 AS masked, l_linestatus = 'O' AS critical,
  CASE WHEN l_linenumber = 7 THEN 'NO_MASK' WHEN l_linenumber % 2 = 0 THEN 'DIRECT' ELSE 'QUASI' END AS identifier_class,
  CASE WHEN l_suppkey % 3 = 0 THEN 'MANDATORY' ELSE 'OPTIONAL' END AS necessity, ['body', 'header', 'comment'][l_partkey % 3 + 1] AS channel,
  l_suppkey % 17 <> 0 AS located, CAST(least(l_quantity, 20) AS INTEGER) AS detected_chars, CAST(least(l_quantity, 20) AS INTEGER) + CAST(l_partkey % 3 AS INTEGER) AS total_chars FROM lineitem)"""


def _results(spark, d):
    li = _t(spark, d, "lineitem")
    k = F.col("l_linenumber")
    hit = F.least(F.col("l_quantity"), F.lit(20.0)).cast("int")
    total = hit + (F.col("l_partkey") % 3).cast("int")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.col("l_orderkey") % 4000, F.lit("-"), F.col("l_suppkey") % 7).alias("entity_id"),
        ((F.col("l_returnflag") != "R") | (k > 3)).alias("masked"),
        (F.col("l_linestatus") == "O").alias("critical"),
        F.when(k == 7, "NO_MASK").when(k % 2 == 0, "DIRECT").otherwise("QUASI").alias("identifier_class"),
        F.when(F.col("l_suppkey") % 3 == 0, "MANDATORY").otherwise("OPTIONAL").alias("necessity"),
        F.element_at(F.array(F.lit("body"), F.lit("header"), F.lit("comment")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("channel"),
        (F.col("l_suppkey") % 17 != 0).alias("located"),
        hit.alias("detected_chars"),
        total.alias("total_chars"),
        ((hit > 0) & (hit < total)).alias("partially_detected"),
    )


_RATE = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"


@query(f"""WITH {_RES}, e AS (SELECT channel, entity_id, bool_and(masked) AS a, bool_or(critical) AS c, count(*) AS n, count(*) FILTER (WHERE masked) AS k FROM res GROUP BY 1, 2)
SELECT channel, CAST(sum(n) AS BIGINT) AS mentions, round({_RATE.format(a="sum(k)", b="sum(n)")}, 4) AS mention_recall, count(*) AS entities, round({_RATE.format(a="count(*) FILTER (WHERE a)", b="count(*)")}, 4) AS entity_recall,
  round({_RATE.format(a="count(*) FILTER (WHERE a AND c)", b="count(*) FILTER (WHERE c)")}, 4) AS critical_entity_recall FROM e GROUP BY 1""")
def entity_recall(spark, d):
    return metrics.entity_recall(_results(spark, d), ["channel"])


@query(f"""WITH {_RES}, g AS (
  SELECT 'identifier_class' AS dimension, identifier_class AS value, masked FROM res UNION ALL SELECT 'necessity', necessity, masked FROM res UNION ALL SELECT 'channel', channel, masked FROM res)
SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE masked) AS n_masked, round({_RATE.format(a="count(*) FILTER (WHERE masked)", b="count(*)")}, 4) AS recall FROM g GROUP BY 1, 2""")
def grouping_sets_recall(spark, d):
    return metrics.recall_by(_results(spark, d), "identifier_class", "necessity", "channel")


@query(f"""WITH {_RES}, s AS (SELECT sum(detected_chars) FILTER (WHERE identifier_class <> 'NO_MASK') AS h, sum(total_chars) FILTER (WHERE identifier_class <> 'NO_MASK') AS t, sum(detected_chars) FILTER (WHERE identifier_class = 'NO_MASK') AS w FROM res WHERE located), p AS (
  SELECT h / t AS r, h / (h + w) AS p FROM s)
SELECT round(r, 4) AS char_recall, round(p, 4) AS char_precision, round(2 * p * r / (p + r), 4) AS f1, round(5 * p * r / (4 * p + r), 4) AS f2 FROM p""")
def char_metrics(spark, d):
    return metrics.char_metrics(_results(spark, d))


@query(f"""WITH {_RES} SELECT count(*) AS no_mask_total, count(*) FILTER (WHERE masked) AS violations, round({_RATE.format(a="count(*) FILTER (WHERE masked)", b="count(*)")}, 4) AS over_masking_rate FROM res WHERE located AND identifier_class = 'NO_MASK'""")
def over_masking_rate(spark, d):
    return metrics.over_masking(_results(spark, d))


@query(f"""WITH {_RES}, m AS (SELECT sum(detected_chars) AS h, sum(total_chars) AS t, count(*) AS n, count(*) FILTER (WHERE detected_chars > 0 AND detected_chars < total_chars) AS p FROM res WHERE located AND identifier_class <> 'NO_MASK' AND necessity = 'MANDATORY'), k AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE masked) AS v FROM res WHERE located AND identifier_class = 'NO_MASK')
SELECT round(greatest(0.0, least(1.0, h / t - p / m.n * 0.5 - v / k.n * 0.5)), 4) AS score FROM m, k""")
def coverage_score(spark, d):
    return metrics.coverage_score(_results(spark, d))


@query(f"""WITH {_RES}, e AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE masked) AS k FROM res GROUP BY 1) SELECT round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro FROM e""")
def macro_micro_recall(spark, d):
    return metrics.macro_micro(_results(spark, d))


@query(f"""WITH {_MASKED}, c AS (SELECT doc_id, "start", trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v, value, masked_text FROM sp JOIN masked USING (doc_id))
SELECT doc_id, "start", doc_id % 10 = 0 OR contains(masked_text, value) OR len(list_filter(string_split(v, ' '), lambda w: length(w) >= 3 AND contains(masked_text, w))) > 0 AS escape FROM c""")
def strict_escapes(spark, d):
    masked = masking.masked_rows(_docs(spark, d), R.PLAIN)
    cases = _found(spark, d).select("doc_id", "start", F.col("value").alias("surface")).join(masked.select("doc_id", "masked_text"), "doc_id")
    return metrics.escapes(cases.withColumn("processed", F.col("doc_id") % 10 != 0)).select("doc_id", "start", "escape")


@query("""WITH r AS (SELECT l_orderkey AS marker, l_linenumber AS channel, l_returnflag <> 'A' AS extracted, l_linestatus = 'O' AS masked, l_suppkey % 5 = 0 AS residual FROM lineitem), b AS (
  SELECT r.*, coalesce(o_orderstatus = 'F', false) AS ok FROM r LEFT JOIN orders ON o_orderkey = marker AND o_orderkey % 10 <> 3)
SELECT channel, count(*) AS n, count(*) FILTER (WHERE extracted) AS n_extracted, count(*) FILTER (WHERE extracted AND masked) AS n_masked,
  round(count(*) FILTER (WHERE extracted) / count(*), 3) AS coverage, round(CASE WHEN count(*) FILTER (WHERE extracted) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE extracted AND masked) / count(*) FILTER (WHERE extracted) END, 3) AS recall,
  count(*) FILTER (WHERE residual AND ok) AS shipped, count(*) FILTER (WHERE residual AND NOT ok) AS contained FROM b GROUP BY 1""")
def canary_join_status(spark, d):
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("marker"), F.col("l_linenumber").alias("channel"), (F.col("l_returnflag") != "A").alias("extracted"), (F.col("l_linestatus") == "O").alias("masked"), (F.col("l_suppkey") % 5 == 0).alias("residual"))
    o = _t(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("marker"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("review").alias("status"))
    return metrics.canary_report(r, o, "channel")


@query("""WITH x AS (SELECT l_returnflag <> 'A' AS e, l_linestatus = 'O' AS d, l_suppkey % 2 = 0 AS m, l_partkey % 3 > 0 AS f, l_quantity > 40 AS r FROM lineitem)
SELECT CASE WHEN NOT e THEN 'S3' WHEN NOT d THEN 'S5' WHEN NOT m THEN 'S7' WHEN NOT f THEN 'S6' WHEN r THEN 'S10' END AS stage, count(*) AS n FROM x GROUP BY 1""")
def failure_stages(spark, d):
    li = _t(spark, d, "lineitem")
    stage = metrics.failure_stage(F.col("l_returnflag") != "A", F.col("l_linestatus") == "O", F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 3 > 0, F.col("l_quantity") > 40)
    return li.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TOKENS}, v AS (SELECT doc_id AS carrier, family, count(DISTINCT value) AS n_values FROM sp GROUP BY 1, 2), t AS (SELECT doc_id AS carrier, family, count(DISTINCT token) AS n_tokens FROM tokens WHERE doc_id % 9 <> 0 GROUP BY 1, 2)
SELECT carrier, family, coalesce(n_values, 0) AS n_values, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_values, 0) = coalesce(n_tokens, 0) AS deterministic FROM v FULL JOIN t USING (carrier, family)""")
def token_determinism(spark, d):
    tokens = _tokens(spark, d).withColumnRenamed("doc_id", "carrier")
    return metrics.determinism(tokens, tokens.where("carrier % 9 <> 0"))


@query(f"""WITH {_MASKED}, u AS (SELECT lang, n_masked, n_chars, CASE WHEN n_chars > 0 THEN n_masked * 1000 / n_chars END AS x FROM masked JOIN documents USING (doc_id))
SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_masked) AS BIGINT) AS placeholders, round(CASE WHEN sum(n_chars) = 0 THEN NULL ELSE sum(n_masked) * 1000 / sum(n_chars) END, 4) AS density, round(median(x), 4) AS median_density FROM u GROUP BY 1""")
def redaction_density(spark, d):
    counts = _tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("placeholders"))
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("chars")).join(counts, "doc_id", "left").na.fill(0, ["placeholders"])
    return metrics.density(rows, ["lang"])


@query("""WITH g AS (SELECT event_type, list_sort(list(value)) AS v, median(value) AS median FROM events GROUP BY 1)
SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[1 + CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER)] AS p95, round(median, 6) AS median FROM g""")
def nearest_rank_p95(spark, d):
    e = _t(spark, d, "events")
    medians = e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))
    return metrics.nearest_rank(e, "event_type", "value", 0.95).withColumnRenamed("ranked", "p95").join(medians, "event_type")


_GATE = """m AS (SELECT o_orderkey, o_orderkey % 4 AS critical_mentions, CAST(o_orderkey % 3 AS DOUBLE) AS critical_false_negatives, o_orderkey % 5 AS critical_entities, 0.9 + o_orderkey % 11 / 100 AS critical_entity_recall,
  o_orderkey % 6 AS no_mask_total, o_orderkey % 13 / 100 AS over_masking_rate, CASE WHEN o_orderkey % 8 <> 0 THEN 0.85 + o_orderkey % 9 / 50 END AS utility_retention,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS critical_false_approval, o_orderkey % 12 AS mentions_located, 0.0 AS leaked_in_export FROM orders)"""


def _gate_sql() -> str:
    parts = []
    for name, col, rule, bound, needs in metrics.CRITERIA:
        op = {"eq": "=", "ge": ">=", "le": "<="}[rule]
        missing = f"{col} IS NULL" + (f" OR {needs} = 0" if needs else "")
        parts.append(f"CASE WHEN {missing} THEN 'UNMEASURED' WHEN {col} {op} {bound} THEN 'PASS' ELSE 'FAIL' END")
    return f"""WITH {_GATE}, v AS (SELECT o_orderkey, [{", ".join(parts)}] AS v FROM m), c AS (
  SELECT o_orderkey, len(list_filter(v, lambda x: x = 'PASS')) AS passed, len(list_filter(v, lambda x: x = 'FAIL')) AS failed, len(list_filter(v, lambda x: x = 'UNMEASURED')) AS unmeasured FROM v)
SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN unmeasured > 0 THEN 'INCOMPLETE' ELSE 'OK' END AS overall FROM c"""


@query(_gate_sql())
def release_gate(spark, d):
    k = F.col("o_orderkey")
    m = _t(spark, d, "orders").select(
        k, (k % 4).alias("critical_mentions"), (k % 3).cast("double").alias("critical_false_negatives"), (k % 5).alias("critical_entities"), (0.9 + k % 11 / 100).alias("critical_entity_recall"),
        (k % 6).alias("no_mask_total"), (k % 13 / 100).alias("over_masking_rate"), F.when(k % 8 != 0, 0.85 + k % 9 / 50).alias("utility_retention"),
        F.when(k % 9 != 0, F.when(k % 17 == 0, 1.0).otherwise(0.0)).alias("critical_false_approval"), (k % 12).alias("mentions_located"), F.lit(0.0).alias("leaked_in_export"),
    )
    return metrics.release_gate(m, "o_orderkey")


@query("""WITH x AS (SELECT o_orderpriority AS scenario, CASE WHEN o_orderkey % 2 = 0 THEN 'FAIL_CLOSED' ELSE 'SAFE_OUTPUT' END AS expected, o_orderstatus <> 'P' AS approved, o_custkey % 9 = 0 AS leaked FROM orders)
SELECT scenario, CASE WHEN approved AND leaked THEN 'critical_false_approval' WHEN expected = 'FAIL_CLOSED' AND approved THEN 'not_closed' WHEN approved THEN 'safe_output' WHEN expected = 'FAIL_CLOSED' THEN 'closed' ELSE 'over_closed' END AS verdict, count(*) AS n FROM x GROUP BY 1, 2""")
def stress_summary(spark, d):
    o = _t(spark, d, "orders")
    expected = F.when(F.col("o_orderkey") % 2 == 0, "FAIL_CLOSED").otherwise("SAFE_OUTPUT")
    verdict = metrics.stress_verdict(expected, F.col("o_orderstatus") != "P", F.col("o_custkey") % 9 == 0)
    return o.groupBy(F.col("o_orderpriority").alias("scenario"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer) WHERE turn <= 40 ORDER BY turn, c_mktsegment, c_custkey LIMIT 120""")
def round_robin_sample(spark, d):
    return metrics.round_robin(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 40, 120)


@query("""WITH t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3)
SELECT p_type, p_partkey, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS nth FROM part WHERE p_type IN (SELECT p_type FROM t)) WHERE nth <= 10""")
def topn_per_group(spark, d):
    return metrics.top_groups(_t(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query(f"""WITH {_MASKED}, q AS (SELECT text, masked_text, substr(text, 1 + CAST(doc_id % 50 AS INTEGER), 60) AS e FROM masked), c AS (
  SELECT count(*) FILTER (WHERE contains(text, e)) AS before, count(*) FILTER (WHERE contains(text, e) AND contains(masked_text, e)) AS after FROM q)
SELECT before, after, round(after / before, 4) AS retention FROM c""")
def utility_retention(spark, d):
    masked = masking.masked_rows(_docs(spark, d), R.PLAIN)
    evidence = F.substr(F.col("text"), (F.lit(1) + F.col("doc_id") % 50).cast("int"), F.lit(60))
    return metrics.utility(masked.select(evidence.alias("evidence"), F.col("text").alias("original"), F.col("masked_text").alias("masked")))


@query("""WITH a AS (SELECT c_mktsegment AS truth, [CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(c_mktsegment) ELSE 'x' END, 'y', CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'z' END, c_mktsegment] AS g FROM customer)
SELECT count(*) AS n, round(count(*) FILTER (WHERE lower(trim(g[1])) = lower(truth)) / count(*), 4) AS exact, round(count(*) FILTER (WHERE list_contains(list_transform(g[1:3], lambda x: lower(trim(x))), lower(truth))) / count(*), 4) AS top3 FROM a""")
def attack_success(spark, d):
    c = _t(spark, d, "customer")
    s = F.col("c_mktsegment")
    guesses = F.array(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower(s))).otherwise("x"), F.lit("y"), F.when(F.col("c_custkey") % 5 == 0, s).otherwise("z"), s)
    return metrics.attack_success(c.select(s.alias("truth"), guesses.alias("guesses")))


@query("""WITH r AS (SELECT o_orderpriority AS format, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'failed' ELSE 'review' END AS status, o_custkey % 7 AS p, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 100 + o_custkey END AS c FROM orders)
SELECT format, count(*) AS n, round(count(*) FILTER (WHERE status = 'approved') / count(*), 4) AS approved_rate, count(*) FILTER (WHERE status = 'failed') AS failed, round(CASE WHEN sum(c) = 0 THEN NULL ELSE sum(p) * 1000 / sum(c) END, 4) AS density FROM r GROUP BY 1""")
def operational_rates(spark, d):
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "failed").otherwise("review")
    chars = F.when(F.col("o_orderstatus") == "P", 0).otherwise(100 + F.col("o_custkey"))
    return metrics.operational(o.select(F.col("o_orderpriority").alias("format"), status.alias("status"), (F.col("o_custkey") % 7).alias("placeholders"), chars.alias("chars")), "format")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, d):
    return _docs(spark, d).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- streaming ---


@query("""SELECT CAST(time_bucket(INTERVAL 10 MINUTE, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    out = streaming.windowed_counts(_t(spark, d, "events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def streamed_masking(spark, d):
    """The documents as a file stream, masked in batches; a second start finds nothing left to do."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # tests and local runs only
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    work = f"{base}/stream-{uuid.uuid4().hex}"
    schema = _t(spark, d, "documents").schema
    source = streaming.arrivals(spark, f"{d}/documents.parquet*", schema)
    for _ in range(2):
        streaming.run_batches(source.select("doc_id", "text"), f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch", "masked_text")


_FOLD = """list_reduce(list_transform(list_sort(a), lambda x: [x]), lambda acc, x: CASE
    WHEN len(list_filter(acc, lambda t: t."start" < x[1]."end" AND x[1]."start" < t."end")) = 0 THEN list_concat(acc, x)
    WHEN len(list_filter(acc, lambda t: x[1]."start" <= t."start" AND t."end" <= x[1]."end")) > 0 THEN
      list_concat(list_filter(acc, lambda t: NOT (t."start" < x[1]."end" AND x[1]."start" < t."end")),
        list_transform([list_sort(list_filter(acc, lambda t: x[1]."start" <= t."start" AND t."end" <= x[1]."end"))[1]], lambda f: {'tier': f.tier, 'rank': f.rank, 'size': f.size,
          'start': least(x[1]."start", list_min(list_transform(list_filter(acc, lambda t: t."start" < x[1]."end" AND x[1]."start" < t."end"), lambda t: t."start"))), 'entity_type': f.entity_type,
          'end': greatest(x[1]."end", list_max(list_transform(list_filter(acc, lambda t: t."start" < x[1]."end" AND x[1]."start" < t."end"), lambda t: t."end"))), 'source': f.source, 'score': f.score}))
    ELSE acc END)"""


@query(f"""WITH {_FOUND}, {_PRED}, every AS (
  SELECT doc_id, CASE WHEN entity_type = 'PHONE_NUMBER' THEN 1 ELSE 0 END AS tier, CAST(score AS DOUBLE) AS score, "start", entity_type, "end", 'pattern' AS source FROM sp
  UNION ALL SELECT doc_id, 2, 0.5, "start", 'PERSON', "end", 'model' FROM pred), g AS (
  SELECT doc_id, list({{'tier': tier, 'rank': -score, 'size': "start" - "end", 'start': "start", 'entity_type': entity_type, 'end': "end", 'source': source, 'score': score}}) AS a FROM every GROUP BY 1)
SELECT doc_id, s."start" AS "start", s."end" AS "end", s.entity_type AS entity_type, s.score AS score, s.source AS source FROM (SELECT doc_id, unnest({_FOLD}) AS s FROM g)""")
def resolved_overlaps(spark, d):
    """Overlapping predictions and gold spans of each document by the greedy rule."""
    gold = _found(spark, d)
    pred = _pred(gold).select("doc_id", "start", "end", F.lit("PERSON").alias("entity_type"), F.lit(0.5).alias("score"), F.lit("model").alias("source"))
    return mask.resolve(gold.drop("value").unionByName(pred))


@query(f"""WITH {_FOUND}, {_PRED} SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY 1""")
def prediction_counts(spark, d):
    """Sizes of the prediction sets that the overlap metrics read."""
    return _pred(_found(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))

# --- reports, generators ---


@query(f"""WITH {_MASKED}, x AS (SELECT doc_id, unnest(regexp_extract_all(masked_text, '<[A-Z_]+_[0-9]+>')) AS token FROM masked)
SELECT doc_id, regexp_extract(token, '<([A-Z_]+)_[0-9]+>', 1) AS family, count(*) AS n, count(DISTINCT token) AS n_distinct FROM x GROUP BY 1, 2""")
def placeholder_use(spark, d):
    return report.placeholder_use(masking.masked_rows(_docs(spark, d), R.PLAIN))


_SWEPT = ("idiot", "scum", "and the", "que", "zzz-none")


@query("SELECT substr(sha256(v), 1, 16) AS vhash, count(*) AS n_files FROM documents, (SELECT unnest(['idiot', 'scum', 'and the', 'que', 'zzz-none']) AS v) WHERE contains(text, v) GROUP BY 1")
def full_tree_sweep(spark, d):
    return report.sweep(_docs(spark, d), _SWEPT)


@query(r"""SELECT doc_id, '<p>' || replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;([A-Z_]+_[0-9]+)&gt;', '<mark>\1</mark>', 'g'), chr(10), '</p><p>') || '</p>' AS html FROM documents""")
def export_html(spark, d):
    return _docs(spark, d).select("doc_id", report.export_html(F.col("text")).alias("html"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def export_text(spark, d):
    return report.export_text(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def approved_sources(spark, d):
    state = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("x").alias("status"))
    return report.chat_sources(_docs(spark, d), state)


@query(f"""WITH {_EDITS}, t AS (SELECT doc_id, unnest([10, 100, 800]) AS f FROM documents)
SELECT doc_id, "start", token FROM ed WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = ed.doc_id AND ed.ms < t.f + 150 AND t.f < ed.ms + length(token))""")
def selected_edits(spark, d):
    targets = _docs(spark, d).select("doc_id", F.explode(F.array(F.lit(10), F.lit(100), F.lit(800))).alias("from")).withColumn("to", F.col("from") + 150)
    return report.target_spans(mask.edits(_tokens(spark, d)), targets).select("doc_id", "start", "token")


@query(f"""WITH {_TOKENS}, f AS (SELECT doc_id, CASE WHEN "start" % 3 = 0 THEN 'open' WHEN "start" % 3 = 1 THEN 'kept' ELSE 'masked' END AS status FROM sp), a AS (
  SELECT doc_id, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE status = 'kept') AS n_kept, count(*) FILTER (WHERE status = 'masked') AS n_masked FROM f GROUP BY 1), t AS (
  SELECT doc_id, count(*) AS n_values, count(DISTINCT token) AS n_tokens FROM tokens GROUP BY 1)
SELECT d.doc_id, coalesce(n_open, 0) AS n_open, coalesce(n_kept, 0) AS n_kept, coalesce(n_masked, 0) AS n_masked, coalesce(n_values, 0) AS n_values, coalesce(n_tokens, 0) AS n_tokens,
  d.doc_id % 2 = 0 AND coalesce(n_open, 0) = 0 AND d.doc_id % 5 <> 0 AS may_approve, d.doc_id % 2 = 0 AS may_reject, d.doc_id % 2 = 0 AND d.doc_id % 3 = 1 AS may_decide
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id)""")
def review_payload(spark, d):
    tokens = _tokens(spark, d)
    k = F.col("start") % 3
    findings = tokens.select("doc_id", F.when(k == 0, "open").when(k == 1, "kept").otherwise("masked").alias("status"))
    i = F.col("doc_id")
    state = _docs(spark, d).select("doc_id", F.when(i % 2 == 0, "needs_human_review").otherwise("approved").alias("status"), (i % 5 != 0).alias("llm_ok"), F.lit(1).alias("revision"), (i % 3).cast("int").alias("audited_revision"))
    return report.review_payload(state, findings, tokens).drop("status", "llm_ok", "revision", "audited_revision")


@query()
def generated_gold(spark, d):
    """Detection over generated documents, held against where their values stand: one row a value kind."""
    docs, mentions = synthetic.gold_documents(spark, 240)
    found = detect.detect(docs, R.ALL)
    masked = masking.masked_rows(docs, R.ALL).select("doc_id", "masked_text")
    out = metrics.mention_results(mentions, found, masked)
    return out.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if("fully_detected").alias("n_full"), F.count_if("masked").alias("n_masked"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row a document: masked text and number of masked values."""
    return masking.masked_rows(_docs(spark, d), R.GENERAL).select("doc_id", "masked_text", "n_masked")


from maskloom.plans import probes, workflow  # noqa: E402, F401 - they register more

__all__ = ["QUERIES", "SQL", "flagship"]
