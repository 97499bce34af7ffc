"""Registered queries of ingest, review, audit, retrieval, evaluation and generators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import fold, spans
from maskloom.operators import audit, detect, lists, mask, metrics, report, retrieval, review, units
from maskloom.operators import recognizers as R
from maskloom.plans import masking
from maskloom.plans.queries import _EDITS, _FOUND, _MASKED, _docs, _found, _spans_sql, _t, _tokens
from maskloom.plans.registry import query
from maskloom.session import ship
from maskloom.sources import synthetic, uploads

# --- ingest ---


@query("""WITH f AS (SELECT page_id, page_id % 8 AS c, 'F' || page_id || ['.pdf', '.PDF', '.docx', '.xlsx', '.txt', '.pdf', '.docx', '.pdf'][page_id % 8 + 1] AS name FROM pages)
SELECT page_id, CASE WHEN c = 4 THEN NULL WHEN c IN (2, 6) THEN 'docx' WHEN c = 3 THEN 'xlsx' ELSE 'pdf' END AS kind,
  CASE c WHEN 0 THEN NULL WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'empty' WHEN 6 THEN 'invalid' ELSE 'too_large' END AS error FROM f""")
def upload_checks(spark, d):
    """Uploads of all sorts: sound, wrong magic, a package that is none, unknown kind, empty, too large."""
    ship(spark)
    c = (F.col("page_id") % 8).cast("int")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".docx", ".xlsx", ".txt", ".pdf", ".docx", ".pdf")]), c + 1)
    body = F.element_at(F.array(*[F.lit(x) for x in ("%PDF-1.7 x", "PK..", "PK\x03\x04 no package", "%PDF", "text", "", "%PDF", "%PDF" + "x" * 96)]), c + 1)
    files = _t(spark, d, "pages").select("page_id", F.concat(F.lit("F"), "page_id", ending).alias("name"), F.encode(body, "utf-8").alias("content"))
    return uploads.checked(files, most=99).select("page_id", "kind", "error")


@query("""SELECT conv_id, turn, list_filter([CASE WHEN turn % 2 = 0 THEN 'blocked' END, CASE WHEN turn % 3 = 0 THEN 'ocr' END, CASE WHEN turn % 5 = 0 THEN 'no_text' END], lambda x: x IS NOT NULL) AS reasons FROM conversations""")
def blocking_reasons(spark, d):
    t = F.col("turn")
    warnings = F.array_compact(F.array(F.when(t % 2 == 0, "truncated:workbook at 9 cells"), F.when(t % 3 == 0, "ocr:page 2"), F.lit("note")))
    text = F.when(t % 5 == 0, "  ").otherwise(F.concat(F.lit("x"), "text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", units.blocking_reasons(warnings, text, {"truncated:": "blocked", "ocr:": "ocr"}).alias("reasons"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS chars, l_discount * 8 AS tr, l_tax * 6 AS en FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN chars < 12 THEN 'unknown' WHEN tr >= 0.25 AND en >= 0.25 THEN 'mixed' WHEN tr > en AND tr > 1 - tr - en THEN 'tr' WHEN en > tr AND en > 1 - tr - en THEN 'en' ELSE 'unknown' END AS lang FROM p""")
def language_rule(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", units.language_rule(F.col("l_quantity"), F.col("l_discount") * 8, F.col("l_tax") * 6).alias("lang"))


@query("""WITH r AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, 'Rapor_' || o_custkey % 50 AS out, CASE o_orderkey % 4 WHEN 0 THEN 'SKIPPED_TOO_LARGE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status FROM orders)
SELECT path, status, out || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS out_name FROM (SELECT *, row_number() OVER (PARTITION BY out ORDER BY path) AS n FROM r)""")
def batch_manifest(spark, d):
    k = F.col("o_orderkey") % 4
    rows = _t(spark, d, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"),
        F.concat(F.lit("<Rapor> "), F.col("o_custkey") % 50, F.lit(".pdf")).alias("name"),
        F.when(k == 0, "too_large").when(k == 1, "invalid").alias("error"),
        F.when(k == 2, "approved").otherwise("needs_human_review").alias("status"),
    )
    return uploads.batch_manifest(rows)


# --- detection helpers ---


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, ['PER', 'ORG', 'GPE', 'DATE', 'MISC', 'X'][l_partkey % 6 + 1] AS label, l_tax * 12 AS score FROM lineitem), t AS (
  SELECT *, CASE label WHEN 'PER' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'GPE' THEN 'LOCATION' WHEN 'MISC' THEN 'NRP' ELSE label END AS entity_type FROM s WHERE label <> 'DATE')
SELECT l_orderkey, l_linenumber, entity_type, round(score * CASE WHEN entity_type IN ('ORGANIZATION', 'NRP') THEN 0.4 ELSE 1.0 END, 6) AS score FROM t WHERE score * CASE WHEN entity_type IN ('ORGANIZATION', 'NRP') THEN 0.4 ELSE 1.0 END >= 0.4""")
def adopted_labels(spark, d):
    labels = F.array(*[F.lit(x) for x in ("PER", "ORG", "GPE", "DATE", "MISC", "X")])
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(labels, (F.col("l_partkey") % 6 + 1).cast("int")).alias("label"), (F.col("l_tax") * 12).alias("score"))
    return detect.adopt_ner(rows).select("l_orderkey", "l_linenumber", "entity_type", F.round("score", 6).alias("score"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_brand), '\s+', ' ', 'g')) AS key FROM part""")
def term_keys(spark, d):
    ship(spark)
    return _t(spark, d, "part").select("p_partkey", fold.term_key(F.concat("p_name", F.lit("  "), F.upper("p_brand"))).alias("key"))


@query(_spans_sql(r"(?i)and[ \t\n\r\f\v]+the(?:['’]\pL+)?"))
def keep_ranges(spark, d):
    """Places of a kept term, with the apostrophe suffix that belongs to it."""
    return _docs(spark, d).select("doc_id", F.explode(lists.keep_ranges(F.col("text"), ["and the"])).alias("k")).select("doc_id", "k.*")


@query("""WITH a AS (SELECT p_partkey AS ord, 0 AS l, upper(p_brand) AS term, p_type AS family FROM part), b AS (SELECT s_suppkey AS ord, 1 AS l, 'brand#' || (10 + s_suppkey % 60) AS term, 'S' AS family FROM supplier), u AS (
  SELECT *, lower(term) AS key FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT key, term, family FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l, ord) AS n FROM u) WHERE n = 1""")
def effective_terms(spark, d):
    ship(spark)
    a = _t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.upper("p_brand").alias("term"), F.col("p_type").alias("family"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("brand#"), 10 + F.col("s_suppkey") % 60).alias("term"), F.lit("S").alias("family"))
    return lists.effective_terms(a, b).drop("at")


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS INTEGER) AS a, CAST(o_orderkey % 40 + 5 + o_custkey % 7 AS INTEGER) AS b, CAST(o_orderkey % 40 + 3 + o_custkey % 9 AS INTEGER) AS c, CAST(o_orderkey % 40 + 16 AS INTEGER) AS e FROM orders), m AS (
  SELECT o_orderkey, a, unnest(CASE WHEN b > c THEN [{'s': a, 'e': greatest(b, e), 'f': CASE WHEN e - c > b - a THEN 'B' ELSE 'A' END}] ELSE [{'s': a, 'e': b, 'f': 'A'}, {'s': c, 'e': e, 'f': 'B'}] END) AS r FROM p)
SELECT o_orderkey, r.s AS "start", r.e AS "end", r.f AS family FROM m WHERE NOT (o_orderkey % 3 = 0 AND r.s >= a AND r.e <= a + 12)""")
def forced_ranges(spark, d):
    """Two masks of a reviewer, one range if they overlap, dropped inside a kept one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = (k % 40).cast("int")
    rng = lambda s, e, f: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(f).alias("family"))
    wide = F.array(rng(a, a + 5 + c % 7, "A"), rng(a + 3 + c % 9, a + 16, "B"))
    keep = F.when(k % 3 == 0, F.array(F.struct(a.alias("start"), (a + 12).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    rows = _t(spark, d, "orders").select("o_orderkey", F.explode(mask.forced_ranges(wide, keep)).alias("r"))
    return rows.select("o_orderkey", "r.*")


@query(f"""WITH {_EDITS}, k AS (SELECT doc_id, unnest([0, 40, 400, 4000]) AS s FROM documents), f AS (
  SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.doc_id = k.doc_id AND ed."start" < k.s + 30 AND k.s < ed."end"))
SELECT f.doc_id, CAST(s + coalesce(max_by(e.ms + length(e.token) - e."end", e."end"), 0) AS BIGINT) AS "start", CAST(s + 30 + coalesce(max_by(e.ms + length(e.token) - e."end", e."end"), 0) AS BIGINT) AS "end"
FROM f LEFT JOIN ed e ON e.doc_id = f.doc_id AND e."end" <= s GROUP BY f.doc_id, s""")
def kept_in_current(spark, d):
    """Kept ranges that no replacement touches, where they stand in the masked text."""
    keeps = _docs(spark, d).select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 40, 400, 4000)])).alias("start")).withColumn("end", F.col("start") + 30)
    return mask.kept_in_current(keeps, mask.edits(_tokens(spark, d)))


@query("""SELECT p_partkey, replace(lower(p_name), ' ', '') AS proj, list_filter(range(0, length(p_name)), lambda i: p_name[i + 1] <> ' ') AS at FROM part""")
def projections(spark, d):
    ship(spark)
    p = _t(spark, d, "part").select("p_partkey", fold.projected(F.upper("p_name")).alias("p"))
    return p.select("p_partkey", "p.proj", F.col("p.at").cast("array<bigint>").alias("at"))


_GREEDY = """list_reduce(list_transform(list_sort(a), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t."start" < x[1]."end" AND x[1]."start" < t."end")) = 0 THEN list_concat(acc, x) ELSE acc END)"""


@query(f"""WITH g AS (SELECT l_orderkey AS doc_id, list({{'start': s, 'size': s - e, 'end': e}}) AS a FROM (SELECT l_orderkey, CAST(l_partkey % 30 AS INTEGER) AS s, CAST(l_partkey % 30 + 1 + l_suppkey % 12 AS INTEGER) AS e FROM lineitem) GROUP BY 1)
SELECT doc_id, s."start" AS "start", s."end" AS "end" FROM (SELECT doc_id, unnest({_GREEDY}) AS s FROM g)""")
def disjoint_hits(spark, d):
    """Left to right, longer first: the hits that overlap none taken before."""
    s = (F.col("l_partkey") % 30).cast("int")
    hits = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct(s.alias("start"), (s + 1 + F.col("l_suppkey") % 12).cast("int").alias("end"))).alias("a"))
    return hits.select("doc_id", F.explode(spans.disjoint(F.col("a"))).alias("s")).select("doc_id", "s.*")


# --- audit ---


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 4 THEN true ELSE false END AS approved, CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'low' WHEN o_orderkey % 7 = 4 THEN 'medium' ELSE 'high' END AS risk_level,
  CASE o_orderkey % 7 WHEN 1 THEN 2 ELSE 0 END AS n_items, CASE o_orderkey % 7 WHEN 1 THEN 'PERSON/10/2,UNKNOWN/0/' ELSE '' END AS items, o_orderkey % 7 IN (0, 1, 4) AS ok FROM orders""")
def verdict_parsing(spark, d):
    """Answers of a model, sound and broken; what cannot be read fails closed, and items keep nothing of their content."""
    ship(spark)
    answers = (
        'x {"approved": true, "risk_level": "low", "remaining_sensitive_items": [], "recommended_next_action": "approve"} y {',
        '```json\n{"approved": true, "risk_level": "low", "ok": false, "remaining_sensitive_items": [{"type": "person", "snippet": " Ada {Love} ", "location": "Sayfa 2, top", "note": "x"}, {"type": "Ada!"}]}\n```',
        '{"approved": "yes", "risk_level": "low"}',
        '{"approved": true, "risk_level": "none"}',
        '{"approved": true, "risk_level": "medium", "summary": "a \\" } b"}',
        '{"approved": true, "risk_level": "low", "remaining_sensitive_items": ["x"]}',
        "no json",
    )
    raw = F.element_at(F.array(*[F.lit(a) for a in answers]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    v = _t(spark, d, "orders").select("o_orderkey", audit.parse_verdict(raw).alias("v"))
    items = F.array_join(F.transform("v.items", lambda i: F.concat(i["type"], F.lit("/"), i["length"], F.lit("/"), F.coalesce(i["page"].cast("string"), F.lit("")))), ",")
    return v.select("o_orderkey", "v.approved", "v.risk_level", F.size("v.items").alias("n_items"), items.alias("items"), "v.ok")


_AUDITS = """a AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AS h_ok, CASE WHEN o_orderkey % 3 <> 0 THEN 'low' ELSE 'high' END AS h_risk, CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE o_orderkey % 40 END AS n_found, o_orderkey % 4 <> 0 AS has, o_orderkey % 5 <> 0 AS ok,
  o_orderkey % 7 <> 0 AS m_app, ['low', 'medium', 'high'][o_custkey % 3 + 1] AS m_risk, o_orderkey % 2 AS m_items, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'approve' END AS act FROM orders)"""


def _audits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    fine = k % 3 != 0
    h = o.select(k.alias("doc_id"), fine.alias("approved"), F.when(fine, "low").otherwise("high").alias("risk_level"), F.when(fine, 0).otherwise(k % 40).cast("long").alias("n_found"))
    item = F.struct(F.lit("PERSON").alias("type"), F.lit(3).alias("length"), F.lit(None).cast("int").alias("page"))
    risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("o_custkey") % 3 + 1).cast("int"))
    items = F.when(k % 2 == 1, F.array(item)).otherwise(F.array().cast("array<struct<type:string,length:int,page:int>>"))
    m = o.where(k % 4 != 0).select(k.alias("doc_id"), (k % 7 != 0).alias("approved"), risk.alias("risk_level"), items.alias("items"), F.when(k % 11 == 0, "x").otherwise("approve").alias("next_action"), (k % 5 != 0).alias("ok"))
    return h, m


@query(f"""WITH {_AUDITS}, b AS (SELECT *, has AND ok AS llm FROM a)
SELECT doc_id, h_ok AND llm AND m_app AND act = 'approve' AND m_items = 0 AND m_risk = 'low' AS approved,
  CASE WHEN h_risk = 'high' OR NOT llm OR m_risk = 'high' THEN 'high' WHEN m_risk = 'medium' THEN 'medium' ELSE 'low' END AS risk_level,
  CAST(least(30, n_found + CASE WHEN llm THEN m_items ELSE 0 END) AS BIGINT) AS n_items, llm AS llm_ok FROM b""")
def combined_audits(spark, d):
    return audit.combined_audit(*_audits(spark, d))


@query(f"""WITH {_AUDITS} SELECT doc_id, m_app AND act = 'approve' AND m_items = 0 AND m_risk <> 'high' AS clean FROM a WHERE has""")
def clean_approvals(spark, d):
    _, m = _audits(spark, d)
    return m.select("doc_id", audit.clean_approval(F.col("approved"), F.col("next_action"), F.size("items"), F.col("risk_level"), "medium").alias("clean"))


@query(rf"""SELECT doc_id, 'mail <EMAIL_1> and <SENSITIVE_1>; <SENSITIVE_1>, keep Acme Corp''un ' || CASE WHEN doc_id % 2 = 0 THEN '10.0.0.1' ELSE '<IP_1>' END AS masked_text, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 4 END AS INTEGER) AS n_masked, doc_id % 3 + 1 AS revision, 'needs_human_review' AS status FROM (SELECT o_orderkey AS doc_id FROM orders)""")
def redecided(spark, d):
    """Masked anew with a reviewer's terms: denied ones in all their places, kept ones never."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("mail ada"), k, F.lit("@x.org and Project Alp; PROJECT  alp, keep Acme Corp'un 10.0.0.1"))
    keep = F.when(k % 2 == 0, F.array(F.lit("acme corp"), F.lit("10.0.0.1"))).otherwise(F.array(F.lit("acme corp")))
    rows = _t(spark, d, "orders").select(k.alias("doc_id"), text.alias("text"), (k % 3).alias("revision"), F.array(F.lit("project alp"), F.lit("Acme Corp")).alias("mask_terms"), keep.alias("keep_terms"))
    return masking.redecided(rows, R.PLAIN)


# --- review ---

_TERMS = ("the the", "idiot", "de la", "de")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term"))


_LOCATED = (
    "f0 AS ("
    + " UNION ALL ".join(f"""SELECT doc_id, "start", "end", '{t}' AS term FROM ({_spans_sql("(?i)" + t.replace(" ", "[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]+"))})""" for t in _TERMS)
    + """), f AS (SELECT doc_id, "start", "end", min(term) AS term FROM f0 GROUP BY 1, 2, 3)"""
)


@query(f"""WITH {_LOCATED} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") AS INTEGER) AS f FROM f""")
def located_terms(spark, d):
    return review.locate_terms(_docs(spark, d).withColumnRenamed("text", "masked_text"), _terms(spark, d)).select("doc_id", "start", "end", "term", "f")


@query(f"""WITH {_LOCATED} SELECT doc_id, term FROM (SELECT doc_id, unnest({list(_TERMS)}) AS term FROM documents) t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = t.doc_id AND f.term = t.term)""")
def unlocated_terms(spark, d):
    found = review.locate_terms(_docs(spark, d).withColumnRenamed("text", "masked_text"), _terms(spark, d))
    return review.unlocated(_terms(spark, d), found)


_IN_MASKED = " UNION ALL ".join(f"""SELECT doc_id, "start", "end", '{t}' AS term FROM ({_spans_sql("(?i)" + t.replace(" ", "[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]+"), "mt")})""" for t in _TERMS)


@query(f"""WITH {_MASKED}, ed AS (SELECT *, "start" + coalesce(sum(length(token) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ms FROM tokens), mt AS (
  SELECT doc_id, masked_text AS text FROM masked), f AS (SELECT doc_id, "start", "end", min(term) AS term FROM ({_IN_MASKED}) GROUP BY 1, 2, 3), p AS (
  SELECT f.doc_id AS doc_id, f."start" AS "start", any_value(f."end") AS "end", any_value(f.term) AS term, f."start" + coalesce(max_by(e."end" - e.ms - length(e.token), e.ms), 0) AS a FROM f LEFT JOIN ed e ON e.doc_id = f.doc_id AND e.ms + length(e.token) <= f."start" GROUP BY f.doc_id, f."start", f."end")
SELECT doc_id, term, CAST(a AS BIGINT) AS original_start, CAST(a + "end" - "start" AS BIGINT) AS original_end, CASE WHEN a + "end" - "start" <= 300 THEN 'kept' ELSE 'open' END AS status FROM p""")
def placed_findings(spark, d):
    """Terms found in masked text, where they stand in the original, and whether that is kept."""
    masked, tokens = masking.mask_documents(_docs(spark, d), R.PLAIN)
    found = review.locate_terms(masked.select("doc_id", "masked_text"), _terms(spark, d)).select("doc_id", "start", "end", "term")
    keeps = _docs(spark, d).select("doc_id", F.lit(0).alias("start"), F.lit(300).alias("end"))
    return review.placed(found, mask.edits(tokens), keeps).select("doc_id", "term", "original_start", "original_end", "status")


_FINDINGS = """fi AS (SELECT l_orderkey AS doc_id, l_linenumber AS f, l_returnflag AS term FROM lineitem), de AS (
  SELECT o_orderkey AS doc_id, 1 + o_custkey % 4 AS f, ['A', 'n', 'r', 'MAIL'][o_custkey % 4 + 1] AS term, ['occurrence', 'document'][o_orderkey % 2 + 1] AS scope, ['keep', 'mask', 'unmask'][o_custkey % 3 + 1] AS op, o_orderkey AS t FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT NULL, NULL, 'n', 'global', 'keep', 1), j AS (
  SELECT fi.*, max_by(op, (CASE scope WHEN 'occurrence' THEN 3 WHEN 'document' THEN 2 ELSE 1 END, t)) AS op FROM fi LEFT JOIN de ON lower(fi.term) = lower(de.term)
    AND ((scope = 'occurrence' AND de.doc_id = fi.doc_id AND de.f = fi.f) OR (scope = 'document' AND de.doc_id = fi.doc_id) OR scope = 'global') GROUP BY fi.doc_id, fi.f, fi.term), st AS (
  SELECT doc_id, f, term, CASE WHEN op IN ('keep', 'unmask') THEN 'kept' WHEN op = 'mask' THEN 'masked' ELSE 'open' END AS status FROM j)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    found = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("f"), F.col("l_returnflag").alias("term")).distinct()
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    at = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    made = _t(spark, d, "orders").where(k % 3 == 0).select(k.alias("doc_id"), (1 + c % 4).alias("f"), at(("A", "n", "r", "MAIL"), c % 4).alias("term"), at(("occurrence", "document"), k % 2).alias("scope"), at(("keep", "mask", "unmask"), c % 3).alias("op"), k.alias("at"))
    every = spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("f"), F.lit("n").alias("term"), F.lit("global").alias("scope"), F.lit("keep").alias("op"), F.lit(1).cast("long").alias("at"))
    return review.decided(found, made.unionByName(every))


@query(f"WITH {_FINDINGS} SELECT * FROM st")
def decided_findings(spark, d):
    return _decided(spark, d)


@query(f"WITH {_FINDINGS} SELECT doc_id, count(*) FILTER (WHERE status = 'open') AS pending FROM st GROUP BY 1")
def pending_findings(spark, d):
    return review.pending(_decided(spark, d))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderstatus = 'F'")
def approvable(spark, d):
    k = F.col("o_orderkey")
    state = _t(spark, d, "orders").select(k.alias("doc_id"), F.lit(3).alias("revision"), F.when(k % 3 == 0, 3).otherwise(2).alias("audited_revision"), F.lit("d").alias("digest"), F.when(k % 2 == 0, "d").otherwise("e").alias("audited_digest"), F.when(F.col("o_orderstatus") == "F", True).alias("llm_ok"))
    return review.may_approve(state).select("doc_id")


@query("""WITH a AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'approved' ELSE 'needs_human_review' END AS status, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS sound, ['approve', 'reject', 'delete', NULL][o_custkey % 4 + 1] AS action FROM orders)
SELECT doc_id, CASE WHEN status = 'approved' THEN status WHEN action = 'approve' AND sound THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE status END AS status,
  coalesce(status <> 'approved' AND action = 'approve' AND NOT sound, false) AS audit_again FROM a WHERE action IS NULL OR action <> 'delete'""")
def reviewed_states(spark, d):
    """Approvals, rejections and deletions; an approval of what was not audited waits for another audit."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    o = _t(spark, d, "orders")
    state = o.select(k.alias("doc_id"), F.when(k % 7 == 0, "approved").otherwise("needs_human_review").alias("status"), F.lit(2).alias("revision"), F.when(k % 3 == 0, 2).alias("audited_revision"), F.lit("d").alias("digest"), F.when(k % 2 == 0, "d").otherwise("e").alias("audited_digest"), F.lit(True).alias("llm_ok"))
    actions = o.where(c < 3).select(k.alias("doc_id"), F.when(c == 0, "approve").when(c == 1, "reject").otherwise("delete").alias("action"))
    return review.acted(state, actions).select("doc_id", "status", "audit_again")


@query("""WITH f AS (SELECT DISTINCT p_brand AS key, 'open' AS state FROM part WHERE p_size < 10), r AS (SELECT DISTINCT p_brand AS key, 'masked' AS state FROM part WHERE p_size > 30)
SELECT key, coalesce(f.state, r.state) AS state FROM f FULL JOIN r USING (key)""")
def term_states(spark, d):
    rows = lambda c, s: _t(spark, d, "part").where(c).select(F.col("p_brand").alias("key"), F.lit(s).alias("state"), F.col("p_brand").alias("term")).distinct()
    return review.term_life(rows("p_size < 10", "open"), rows("p_size > 30", "masked")).drop("term")


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_returnflag AS value, l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS nth, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem), s AS (
  SELECT l_orderkey AS doc_id, l_returnflag AS value, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber) AS nth, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem WHERE l_orderkey % 2 = 0 OR l_linenumber > 2)
SELECT DISTINCT w.doc_id AS doc_id, w.value AS value, ord FROM w JOIN s ON s.doc_id = w.doc_id AND s.value = w.value AND (s.n <> w.n OR s.nth = w.nth)""")
def page_marks(spark, d):
    """Words to mark: rank by rank where a block has as many spans as words, all of them where it has not."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("b").alias("block_id"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("start"))
    out = review.page_marks(li.drop("start"), li.where("doc_id % 2 = 0 or ord > 2").drop("ord"))
    return out.select("doc_id", "value", "ord")


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'The second check did not run' WHEN 1 THEN 'No text was found' ELSE 'odd:1' END AS reason,
  CASE WHEN o_orderkey % 2 = 0 THEN 'S1, ' || CASE WHEN o_custkey % 60 >= 26 THEN chr(CAST(64 + o_custkey % 60 // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + o_custkey % 60 % 26 AS INTEGER)) || (o_orderkey % 9 + 1) WHEN o_orderkey % 3 = 0 THEN 'page ' || o_custkey ELSE '' END AS place FROM orders""")
def review_labels(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = F.when(k % 3 == 0, "auditor_unavailable").when(k % 3 == 1, "no_text:scan").otherwise("odd:1")
    place = report.location_label(F.when(k % 3 == 0, c.cast("string")), F.when(k % 2 == 0, "S1"), k % 9, (c % 60).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", report.reason_label(code).alias("reason"), place.alias("place"))


@query("""WITH l AS (SELECT p_partkey AS key, 'always' AS list FROM part WHERE p_partkey % 2 = 0), c AS (SELECT l_partkey AS key, ['always', 'never', 'remove'][l_linenumber % 3 + 1] AS list, l_orderkey * 10 + l_linenumber AS t FROM lineitem WHERE l_suppkey % 5 = 0), n AS (
  SELECT key, max_by(list, t) AS list FROM c GROUP BY 1)
SELECT key, list FROM l WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, list FROM n WHERE list <> 'remove'""")
def user_lists(spark, d):
    now = _t(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit("always").alias("list"))
    to = F.element_at(F.array(F.lit("always"), F.lit("never"), F.lit("remove")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    changes = _t(spark, d, "lineitem").where("l_suppkey % 5 = 0").select(F.col("l_partkey").alias("key"), to.alias("list"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return review.always_or_never(now, changes)


# --- retrieval ---


@query("""SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type || '_' || p_brand), '[a-z0-9]+') AS tokens FROM part""")
def search_tokens(spark, d):
    ship(spark)
    return _t(spark, d, "part").select("p_partkey", fold.search_tokens(F.concat("p_name", F.lit(" "), F.upper("p_type"), F.lit("_"), "p_brand")).alias("tokens"))


_CHUNKS = """l AS (
  SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(text, '\\r\\n|[\\n\\x0B\\f\\r]'), lambda x: regexp_matches(x, '[^ \\t]')), lambda x: CASE WHEN length(x) <= 1200 THEN [x] ELSE
    list_reduce(list_transform(string_split(x, ' '), lambda w: [w]), lambda acc, w: CASE WHEN length(acc[len(acc)]) + 1 + length(w[1]) <= 1200 THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || ' ' || w[1]]) ELSE list_concat(acc, w) END) END)) AS l FROM t), c AS (
  SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[len(acc)]) + 1 + length(x[1]) <= 1200 THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS c FROM l WHERE len(l) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS part, c[i] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)"""


@query(f"WITH t AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1), {_CHUNKS}")
def chunked_conversations(spark, d):
    """Conversations as one text each, cut into chunks; over-long lines at spaces."""
    texts = report.export_text(_t(spark, d, "conversations"), "conv_id", "turn", "text")
    return retrieval.chunk_texts(texts, doc="conv_id").withColumnRenamed("conv_id", "doc_id")


@query(f"WITH t AS (SELECT doc_id, text FROM documents), {_CHUNKS}")
def chunk_lines(spark, d):
    return retrieval.chunk_texts(_docs(spark, d))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_name AS text FROM customer)
SELECT 'Answer from these sources and cite them.' || chr(10) || chr(10) || string_agg('[S' || n || '] ' || text, chr(10) || chr(10) ORDER BY n) AS prompt FROM s WHERE n <= 8""")
def system_prompt(spark, d):
    top = _t(spark, d, "customer").orderBy("c_custkey").limit(8)
    ranked = retrieval.sourced(top.select((-F.col("c_custkey")).alias("score"), F.col("c_custkey").alias("doc_id"), F.lit(1).alias("part"), F.col("c_name").alias("text")))
    return report.system_prompt(ranked)


@query("""SELECT conv_id, turn, sha256('{"model":"m","turn":' || turn || ',"role":"' || role || '"}') AS consent FROM conversations""")
def consent_hashes(spark, d):
    payload = F.struct(F.lit("m").alias("model"), "turn", "role")
    return _t(spark, d, "conversations").select("conv_id", "turn", retrieval.consent_hash(payload).alias("consent"))


# --- evaluation ---


@query("""WITH n AS (SELECT p_partkey, p_name || ' ' || p_name AS t, split_part(p_name, ' ', 1) AS s FROM part)
SELECT p_partkey, CAST(list_filter(range(1, length(t) - length(s) + 2), lambda i: substr(t, i, length(s)) = s)[2] - 1 AS INTEGER) AS second FROM n""")
def located_occurrences(spark, d):
    """Start of the second occurrence of a name's first word in the name written twice."""
    t = F.concat("p_name", F.lit(" "), "p_name")
    return _t(spark, d, "part").select("p_partkey", metrics.locate(t, F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(2)).cast("int").alias("second"))


@query(f"""WITH {_MASKED} SELECT sp.doc_id AS doc_id, "start", sp.doc_id % 2 = 0 OR contains(masked_text, value) AS leaked FROM sp JOIN masked USING (doc_id)""")
def export_leaks(spark, d):
    """Gold values that stand in what was exported: the original for every other document."""
    gold = _found(spark, d)
    rows = masking.masked_rows(_docs(spark, d), R.PLAIN)
    export = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("masked_text")).alias("export_text"))
    out = metrics.mention_results(gold.withColumnRenamed("value", "surface"), gold, rows.select("doc_id", "masked_text"), export)
    return out.select("doc_id", "start", F.col("leaked_in_export").alias("leaked"))


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS closes, o_orderkey % 2 = 0 AS shipped, o_custkey % 5 = 0 AS leaks FROM orders)
SELECT o_orderkey, CASE WHEN shipped AND leaks THEN 'critical_false_approval' WHEN closes THEN CASE WHEN shipped THEN 'fail' ELSE 'pass' END WHEN shipped THEN 'pass' ELSE 'conservative' END AS verdict FROM c""")
def strict_stress(spark, d):
    k, leaks = F.col("o_orderkey"), F.col("o_custkey") % 5 == 0
    out = F.when(leaks, "x Ada  Lovelace y short").otherwise("x short")
    v = metrics.strict_verdict(F.when(k % 3 == 0, "fail_closed").otherwise("safe_output"), k % 2 == 0, F.array(F.lit("short"), F.lit("Ada Lovelace")), out)
    return _t(spark, d, "orders").select("o_orderkey", v.alias("verdict"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS t, ['MACHINERY', 'BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE', 'HOUSEHOLD'] AS pool, c_custkey % 4 AS slot FROM customer), o AS (
  SELECT c_custkey, t, slot, list_filter(['MACHINERY', 'BUILDING', 'FURNITURE', 'AUTOMOBILE', 'HOUSEHOLD'], lambda x: x <> t)[1:3] AS o FROM c)
SELECT c_custkey, list_concat(list_concat(o[1:slot], [t]), o[slot + 1:]) AS options FROM o""")
def attack_options(spark, d):
    pool = F.array(*[F.lit(x) for x in ("MACHINERY", "BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD")])
    return _t(spark, d, "customer").select("c_custkey", metrics.attack_options(pool, F.col("c_mktsegment"), F.col("c_custkey") % 4).alias("options"))


@query(f"""WITH {_FOUND}, gold AS (SELECT doc_id, "start", "end", value, CASE WHEN entity_type IN ('CREDIT_CARD', 'EMAIL_ADDRESS') THEN 'DIRECT' ELSE 'QUASI' END AS identifier_class FROM sp), pred AS (
  SELECT doc_id, "start" + 2 AS a, "end" + 1 AS b FROM sp WHERE "start" % 3 <> 0), ch AS (
  SELECT identifier_class, doc_id, "start", unnest(range("start", "end")) AS i, value FROM gold), c2 AS (SELECT *, NOT regexp_matches(value[i - "start" + 1], '\\s') AS dense FROM ch)
SELECT identifier_class, count(*) FILTER (WHERE dense AND EXISTS (SELECT 1 FROM pred WHERE pred.doc_id = c2.doc_id AND a <= i AND i < b)) AS hit, count(*) FILTER (WHERE dense) AS total,
  round(count(*) FILTER (WHERE dense AND EXISTS (SELECT 1 FROM pred WHERE pred.doc_id = c2.doc_id AND a <= i AND i < b)) / count(*) FILTER (WHERE dense), 4) AS recall FROM c2 GROUP BY 1""")
def class_char_recall(spark, d):
    found = _found(spark, d)
    direct = F.when(F.col("entity_type").isin("CREDIT_CARD", "EMAIL_ADDRESS"), "DIRECT").otherwise("QUASI")
    pred = found.where("start % 3 <> 0").select("doc_id", (F.col("start") + 2).alias("start"), (F.col("end") + 1).alias("end"))
    return metrics.class_char_recall(found.withColumnRenamed("value", "surface").withColumn("identifier_class", direct), pred)


@query("""SELECT count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS tokens, CAST(round(sum(0.1 + o_orderkey % 10), 3) AS DOUBLE) AS seconds, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS readable, min(0.1 + o_orderkey % 10) > 0.05 AND count(*) FILTER (WHERE o_orderkey % 4 <> 0) * 2 > count(*) AS plausible FROM orders""")
def model_evidence(spark, d):
    k = F.col("o_orderkey")
    return report.model_evidence(_t(spark, d, "orders").select((0.1 + k % 10).alias("seconds"), F.col("o_custkey").alias("tokens"), (k % 4 != 0).alias("ok")))


@query("""SELECT c_custkey, c_custkey % 2 = 1 AS masked, CASE WHEN c_custkey % 2 = 1 THEN 'ok' ELSE 'S15_filename_not_anonymized' END AS stage FROM customer""")
def file_name_grades(spark, d):
    c = _t(spark, d, "customer").withColumn("safe", uploads.safe_name(F.concat(F.lit("<"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ada"), "c_custkey")).otherwise("PERSON_1"), F.lit("> report"))))
    return c.select("c_custkey", metrics.file_name_grade(F.concat(F.lit("Ada"), "c_custkey"), F.col("safe")).alias("g")).select("c_custkey", "g.*")


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 4 <> 0 AS complete, o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AS trip, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS held FROM orders)
SELECT count(*) AS documents, count(*) FILTER (WHERE complete AND trip AND held) AS passed, round(count(*) FILTER (WHERE complete) / count(*), 4) AS complete, round(count(*) FILTER (WHERE trip) / count(*), 4) AS round_trip,
  round(count(*) FILTER (WHERE held) / count(*), 4) AS contained FROM c""")
def mode_checks(spark, d):
    """Documents kept with a mapping: some without it, some with another value in it, some that share a raw value or nothing."""
    k = F.col("doc_id")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).withColumn("value", F.concat(F.lit("ada"), k, F.lit(" love")))
    mapping = rows.where("doc_id % 4 <> 0").select("doc_id", F.lit("<PERSON_1>").alias("token"), F.when(k % 7 == 0, "other").otherwise(F.regexp_replace("value", " ", "\n")).alias("value"))
    masked = rows.select("doc_id", F.lit("x <PERSON_1> y <PERSON_1>").alias("masked_text"))
    shared = rows.where("doc_id % 3 <> 0").select("doc_id", F.when(k % 5 == 0, F.concat(F.lit("it is "), "value")).otherwise("x <PERSON_1>").alias("text"))
    return metrics.check_rates(metrics.mapping_checks(masked, mapping, rows, shared))


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 2 <> 0 AS a, o_orderkey % 3 <> 0 AS b, o_orderkey % 5 <> 0 AS m FROM orders)
SELECT count(*) AS documents, count(*) FILTER (WHERE a AND b AND m) AS passed, round(count(*) FILTER (WHERE a) / count(*), 4) AS no_original, round(count(*) FILTER (WHERE b) / count(*), 4) AS no_extracted, round(count(*) FILTER (WHERE m) / count(*), 4) AS no_mapping FROM c""")
def destructive_checks(spark, d):
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    twice = docs.unionByName(docs)
    return metrics.check_rates(metrics.destructive_checks(docs, docs.where("doc_id % 2 = 0"), twice.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0")))


@query("""WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) || chr(10) || ' ' || split_part(p_name, ' ', 2) || ' x' AS t, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS s FROM part)
SELECT p_partkey, 0 AS first, CAST(NULL AS INTEGER) AS second FROM n""")
def located_across_lines(spark, d):
    """A value that a line end cut is located all the same."""
    one = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    t, s = F.concat(one(1), F.lit("\n "), one(2), F.lit(" x")), F.concat(one(1), F.lit(" "), one(2))
    return _t(spark, d, "part").select("p_partkey", metrics.locate(t, s, F.lit(1)).cast("int").alias("first"), metrics.locate(t, s, F.lit(2)).cast("int").alias("second"))


@query(f"""SELECT replace(lower(replace(replace(t, 'İ', 'i'), 'I', 'i')), 'ı', 'i') AS key, t AS term FROM (SELECT unnest({[t for terms in lists.BUSINESS_TERMS.values() for t in terms]}) AS t)""")
def built_in_terms(spark, d):
    """The built-in allow-list by its keys."""
    ship(spark)
    return lists.effective_terms(lists.business_terms(spark)).select("key", "term")


# --- generators ---

_PEOPLE = f"""q AS (SELECT i AS id, i * 7919 + 104729 AS k FROM range(240) t(i)), pe AS (
  SELECT 'S' || id AS subject_id, id, {list(synthetic.FIRST)}[k % {len(synthetic.FIRST)} + 1] || ' ' || {list(synthetic.LAST)}[k // 8 % {len(synthetic.LAST)} + 1] AS name, 'user' || id || '@example.com' AS email,
    '+1 (' || lpad(CAST(k % 800 + 200 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(k % 9000 + 1000 AS VARCHAR), 4, '0') AS phone FROM q)"""


@query(f"WITH {_PEOPLE} SELECT subject_id, name, email, phone FROM pe")
def generated_people(spark, d):
    return synthetic.people(spark, 240).select("subject_id", "name", "email", "phone")


@query(f"""WITH {_PEOPLE}, dm AS (SELECT *, {list(synthetic.DOMAINS)}[id % 6 + 1] AS domain FROM pe) SELECT 'email' AS entity_type, count(*) AS n, count(*) AS n_full, count(*) AS n_masked FROM dm
UNION ALL SELECT 'phone', count(*), count(*), count(*) FROM dm UNION ALL SELECT 'tckn', count(*), count(*), count(*) FROM dm UNION ALL SELECT 'iban', count(*), count(*), count(*) FROM dm
UNION ALL SELECT 'card', count(*), count(*), count(*) FROM dm WHERE domain <> 'legal'""")
def generated_gold(spark, d):
    """Detection over generated documents of all domains, held against where their values stand: every number is found and masked."""
    docs, mentions = synthetic.gold_documents(spark, 240)
    found = detect.detect(docs, R.ALL)
    masked = masking.masked_rows(docs, R.ALL).select("doc_id", "masked_text")
    out = metrics.mention_results(mentions.where("entity_type <> 'name'"), found, masked)
    return out.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if("fully_detected").alias("n_full"), F.count_if("masked").alias("n_masked"))


@query(f"""SELECT * FROM (VALUES {", ".join(f"('{i}', '{v}', '{f}', '{c}', {str(a).lower()}, {str(b).lower()})" for i, v, f, c, a, b in synthetic.CANARIES)}) t(canary_id, value, expected_family, context, critical, base_detectable)""")
def canary_catalogue(spark, d):
    return synthetic.canaries(spark).where("canary_id <> 'tckn'")


@query("""SELECT c_custkey, regexp_replace(c_name || ' ' || c_mktsegment, '^([^ ]+) ', '\\1' || chr(10)) AS broken, replace(upper(c_name || ' ' || c_mktsegment), ' ', '  ') AS spaced FROM customer""")
def canary_variants(spark, d):
    v = metrics.variants_of(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", v.alias("v")).select("c_custkey", F.get("v", F.lit(0)).alias("broken"), F.get("v", F.lit(1)).alias("spaced"))


_PAIRS = [(f, s) for f in ("pdf", "docx", "xlsx") for s, formats in synthetic.SCENARIOS.items() if f in formats]


@query(f"""WITH c AS (SELECT i, {[f for f, _ in _PAIRS]}[i % {len(_PAIRS)} + 1] AS fmt, {[s for _, s in _PAIRS]}[i % {len(_PAIRS)} + 1] AS scenario FROM range(72) t(i))
SELECT fmt || '-' || scenario || '-' || lpad(CAST(i AS VARCHAR), 2, '0') AS case_id, fmt, scenario, CASE WHEN scenario IN ('corrupt_ooxml', 'zip_bomb') THEN 'fail_closed' ELSE 'safe_output' END AS expected, scenario IN ('metadata', 'external_link') AS architecturally_safe FROM c""")
def stress_plan(spark, d):
    return synthetic.stress_plan(spark).drop("planted_values")


