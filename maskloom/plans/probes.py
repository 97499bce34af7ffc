"""Recognizers, gates and repairs held against values planted in texts, whose places are known by construction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.operators import detect, mask, propagate, tables
from maskloom.operators import recognizers as R
from maskloom.operators.lists import allow_minus_deny
from maskloom.plans import masking
from maskloom.plans.registry import query
from maskloom.session import ship


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("k"))


_KEYS = "SELECT o_orderkey AS doc_id, o_orderkey AS k FROM orders"


def pad(n: int, times: int = 7919) -> str:
    """n digits that follow from k, in the SQL of both engines."""
    return f"lpad(CAST(k * {times} % {10**n} AS STRING), {n}, '0')"


def _probe(name: str, recognizers: tuple[R.Recognizer, ...], before: str, value: str, after: str = "' son'", where: str = "true", made: Callable[[], Column] | None = None, with_value: str | None = None) -> None:
    """Texts ``before || value || after``; found are the values of rows for which ``where`` holds, and nothing else."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        text = F.concat(F.expr(before), made() if made is not None else F.expr(value), F.expr(after))
        rows = _orders(spark, d).withColumn("text", text)
        return detect.detect(rows, recognizers).select("doc_id", "start", "end", "value", "entity_type")

    sql = f"""WITH p AS ({with_value or f"SELECT *, {value} AS value FROM ({_KEYS})"})
SELECT doc_id, CAST(length({before}) AS INTEGER) AS "start", CAST(length({before}) + length(value) AS INTEGER) AS "end", value, '{recognizers[0].entity_type}' AS entity_type FROM p WHERE {where}"""
    query(sql, name)(run)


def _when_even(yes: str, no: str = "kalem ") -> str:
    return f"CASE WHEN k % 2 = 0 THEN '{yes}' ELSE '{no}' END"


def _pick(words: tuple[str, ...]) -> str:
    return f"split_part('{'|'.join(words)}', '|', CAST(k % {len(words)} AS INT) + 1)"


_NINE = "CAST(100000000 + k * 7919 % 900000000 AS STRING)"
_TCKN = f"""SELECT doc_id, k, nine || t || CASE WHEN k % 5 = 0 THEN (l + 1) % 10 ELSE l END AS value FROM (SELECT *, (list_sum(g) + t) % 10 AS l FROM (
  SELECT *, ((7 * (g[1] + g[3] + g[5] + g[7] + g[9]) - (g[2] + g[4] + g[6] + g[8])) % 10 + 10) % 10 AS t FROM (
    SELECT *, list_transform(range(1, 10), lambda i: CAST(nine[i] AS INTEGER)) AS g FROM (SELECT *, {_NINE} AS nine FROM ({_KEYS})))))"""


def _tckn() -> Column:
    """A valid number; every fifth has its last digit changed."""
    whole = checks.tckn_complete(F.expr(_NINE))
    broken = F.concat(F.substring(whole, 1, 10), ((F.substring(whole, 11, 1).cast("int") + 1) % 10).cast("string"))
    return F.when(F.col("k") % 5 == 0, broken).otherwise(whole)


def _card() -> Column:
    return checks.luhn_complete(F.lpad(F.col("k").cast("string"), 15, "4"))


_probe("probe_tckn", R.only("TR_TCKN"), _when_even("kimlik no "), "", where="k % 5 <> 0", made=_tckn, with_value=_TCKN)
_probe("probe_vkn", R.only("TR_VKN"), _when_even("vergi no "), pad(10), where="k % 2 = 0")
_probe("probe_gsm", R.only("TR_GSM"), "'ara '", f"CASE k % 3 WHEN 0 THEN '+90 532 ' WHEN 1 THEN '0532-' ELSE '532 ' END || {pad(3)} || ' ' || {pad(2)} || ' ' || {pad(2, 31)}")
_probe("probe_landline", R.only("TR_PHONE"), _when_even("tel "), f"'0212 ' || {pad(3)} || ' ' || {pad(2)} || ' ' || {pad(2, 31)}", where="k % 2 = 0")
_probe("probe_tr_iban", R.only("TR_IBAN"), "'x '", f"CASE WHEN k % 2 = 0 THEN 'TR' ELSE 'tr' END || {pad(2)} || ' 0006 1005 1978 ' || {pad(4)} || ' ' || {pad(4, 31)} || ' ' || {pad(2, 13)}")
_probe("probe_plate", R.only("TR_PLATE"), "'plaka '", f"'34 ' || CASE WHEN k % 2 = 0 THEN 'ŞB' ELSE 'KVR' END || ' ' || {pad(3)}", "' var'")
_probe("probe_passport_tr", R.only("TR_PASSPORT"), "'belge '", f"'U' || {pad(8)}")
_probe("probe_account_grouped", R.only("TR_ACCOUNT"), "'no: '", f"{pad(4)} || '-' || {pad(6)} || '-' || {pad(2)}")
_probe("probe_account_bare", R.only("TR_ACCOUNT"), _when_even("abone no "), pad(8), where="k % 2 = 0")
_probe(
    "probe_secret_kinds", R.only("SECRET_KEY"), "'deger '",
    f"""CASE k % 6 WHEN 0 THEN 'sk_live_a' || {pad(8)} WHEN 1 THEN 'AKIAABCDEFGH' || {pad(8)} WHEN 2 THEN 'gho_abcdefghijkl' || {pad(10)} WHEN 3 THEN 'AIzaabcd-efgh_ij' || {pad(10)}
  WHEN 4 THEN 'eyJabcdef' || {pad(5)} || '.eyJzdWIi' || {pad(5)} || '.sig_nat-' || {pad(5)} ELSE 'Bearer abcdef.' || {pad(12)} END""",
)
_probe("probe_secret_split", R.only("SECRET_KEY"), "'deger '", f"'rk_test_9Qm2 XbT' || {pad(6)}")
_probe("probe_secret_bare", R.only("SECRET_KEY"), _when_even("parola: ", "uzun: "), f"'a1-b2_c3d4e5f6g7h8i9j0k1' || {pad(10)}", where="k % 2 = 0")
_probe("probe_salary_range", R.only("TR_SALARY_BAND"), _when_even("bordro ", "tutar "), f"{pad(2, 1)} || '.000-' || {pad(3, 31)} || '.000 TL'", where="k % 2 = 0")
_probe("probe_salary_floor", R.only("TR_SALARY_BAND"), _when_even("gelir ", "tutar "), f"{pad(3, 31)} || '.000 TL üzeri'", where="k % 2 = 0")
_probe("probe_company", R.only("TR_COMPANY"), "'alan '", _pick(("Deniz Gıda A.Ş.", "ABC Metal Ltd. Şti.", "Öz Ulaşım Yolları A.O.", "Işık Koll. Şti.")))
_probe("probe_address_spelled", R.only("TR_ADDRESS")[:1], "'adres '", f"'Uzun Yol ' || {_pick(R.STREETS)} || ' No ' || {pad(2, 1)} || ' Çankaya Ankara'", "' olan'")
_probe("probe_address_official", R.only("TR_ADDRESS")[1:], "'yeri '", f"'DENEME ' || {_pick(R.MARKERS)} || ' NO: ' || {pad(3)} || ' / NO: 4 ÖRNEK / İL'", "chr(10) || 'son'")
_probe("probe_disability", R.only("TR_DISABILITY"), "'rapor '", f"CASE WHEN k % 2 = 0 THEN '%' || {pad(2)} || ' ' || {_pick(R.SENSES)} || ' kaybı' ELSE {_pick(R.SENSES)} || ' engel (%' || {pad(2)} || ')' END")
_probe("probe_health", R.only("TR_HEALTH"), "'tanı: '", _pick(R.HEALTH_TERMS), "', x'")
_probe("probe_person_label", R.only("TR_PERSON_CTX")[:1], f"'x ' || {_pick(R.PERSON_LABELS)} || CASE WHEN k % 2 = 0 THEN ': ' ELSE ' ' END", _pick(("Ayşe Yılmaz", "Ömer Faruk Işık", "Çağla Ünlü")), "' geldi'")
_probe("probe_person_field", R.only("TR_PERSON_CTX")[1:], f"'x' || chr(10) || ' ' || {_pick(R.NAME_LABELS)} || ' : '", _pick(("AYŞE NUR", "Ömer Işık", "Çağla")), "chr(10) || 'y'")
_probe("probe_ssn", R.only("US_SSN"), "'no '", f"{pad(3)} || '-' || {pad(2)} || '-' || {pad(4)}")
_probe("probe_uk_phone", R.only("UK_PHONE"), "'ring '", f"CASE k % 3 WHEN 0 THEN '+44 7911 ' WHEN 1 THEN '07911 ' ELSE '020 7946 ' END || CASE WHEN k % 3 = 2 THEN {pad(4)} ELSE {pad(6)} END")
_probe("probe_passport_en", R.only("PASSPORT"), _when_even("passport "), f"'AB' || {pad(7)}", where="k % 2 = 0")
_probe("probe_licence", R.only("DRIVER_LICENSE"), _when_even("driver id "), f"'D' || {pad(6)}", where="k % 2 = 0")
_probe("probe_us_licence", R.only("US_DRIVER_LICENSE"), _when_even("permit "), f"'D' || {pad(7)}", where="k % 2 = 0")
_probe("probe_email", R.only("EMAIL_ADDRESS"), "'mail '", f"'a.b+' || {pad(5)} || '@x-y.example.org'")
_probe("probe_url", R.only("URL"), "'see '", f"'https://x.example.org/a?id=' || {pad(5)} || '#z'")
_CARD = """SELECT doc_id, k, p || ((10 - t % 10) % 10) AS value FROM (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(p[i] AS INTEGER)
    WHEN CAST(p[i] AS INTEGER) > 4 THEN CAST(p[i] AS INTEGER) * 2 - 9 ELSE CAST(p[i] AS INTEGER) * 2 END)) AS t FROM (SELECT *, lpad(CAST(k AS VARCHAR), 15, '4') AS p FROM (""" + _KEYS + ")))"  # fmt: skip
_probe("probe_card", R.only("CREDIT_CARD"), "'nr '", "", made=_card, with_value=_CARD)
_probe("probe_iban", R.only("IBAN_CODE"), "'to '", "", made=lambda: checks.iban_complete(F.lit("TR"), F.lpad(F.col("k").cast("string"), 22, "0")), with_value=f"""SELECT doc_id, k, 'TR' || lpad(CAST(98 - CAST(a || '292700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || a AS value
  FROM (SELECT *, lpad(CAST(k AS VARCHAR), 22, '0') AS a FROM ({_KEYS}))""")  # fmt: skip


# --- gates ---

_CASES = (
    # entity_type, value, text, source, kept
    ("PERSON", "hükümleri saklıdır", "hükümleri saklıdır", "ner", False),
    ("PERSON", "Ada Lovelace", "by Ada Lovelace", "ner", True),
    ("PERSON", "Konsolide", "Konsolide", "ner", False),
    ("PERSON", "Konsolide", "Konsolide", "deny", True),
    ("PERSON", "Tedarik Sözleşmesi", "Tedarik Sözleşmesi", "tr", False),
    ("PERSON", "Faaliyet Raporları'nın Özeti", "Faaliyet Raporları'nın Özeti", "en", False),
    ("PERSON", "Supply Agreement", "Supply Agreement", "en", False),
    ("PERSON", "Supply Agreement", "Supply Agreement", "deny", True),
    ("PERSON", "Abone Kazanımı\nMobilde", "Abone Kazanımı\nMobilde", "ner", False),
    ("PERSON", "Ayşe\nDemir", "Ayşe\nDemir", "ner", True),
    ("PERSON", "Ayşe ile Demir", "Ayşe ile Demir", "ner", False),
    ("TR_PHONE", "03.01.2026", "03.01.2026", "pattern", False),
    ("TR_PHONE", "212 555 44 33", "212 555 44 33", "pattern", True),
    ("LOCATION", "Yerleşim  Yeri", "Yerleşim  Yeri", "ner", False),
    ("LOCATION", "Yerleşim Yeri", "Yerleşim Yeri", "deny", True),
    ("LOCATION", "KADIKÖY", "BU BELGE KADIKÖY ADLİYESİ İÇİN", "ner", False),
    ("LOCATION", "KADIKÖY", "www.x.org 03.01.2026 KADIKÖY ADLİYESİ İÇİN", "ner", True),
    ("LOCATION", "KADIKÖY", "BU BELGE KADIKÖY ADLİYESİ İÇİN", "user", True),
    ("TR_IBAN", "tr33 0006", "tr33 0006", "pattern", True),
)


@query(f"SELECT o_orderkey AS doc_id, [{', '.join(str(c[4]).lower() for c in _CASES)}][o_orderkey % {len(_CASES)} + 1] AS kept FROM orders")
def probe_gates(spark, d):
    """The gates on guesses of statistical detectors and on spans of other sources."""
    cases = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("entity_type", "value", "text", "source"), c, strict=False)]) for c in _CASES])
    rows = _orders(spark, d).withColumn("c", F.element_at(cases, (F.col("k") % len(_CASES) + 1).cast("int"))).select("doc_id", "c.*")
    rows = rows.withColumn("start", F.instr("text", F.col("value")) - 1).withColumn("end", F.col("start") + F.char_length("value"))
    kept = detect.gated(rows).select("doc_id", F.lit(True).alias("kept"))
    return rows.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"""WITH p AS (SELECT doc_id, CAST(k AS VARCHAR) AS n FROM ({_KEYS}))
SELECT doc_id, 4 AS "start", CAST(26 + length(n) AS INTEGER) - 1 AS "end", 'https://exam' || chr(10) || 'ple.com/' || n AS value, 'URL' AS entity_type FROM p
UNION ALL SELECT doc_id, CAST(36 + length(n) AS INTEGER), CAST(36 + 2 * length(n) + 16 AS INTEGER), 'ada' || n || '@exa' || chr(10) || 'mple.com', 'EMAIL_ADDRESS' FROM p""")
def line_wrapped_spans(spark, d):
    """A URL and an address that line ends cut in two."""
    n = F.col("k").cast("string")
    text = F.concat(F.lit("see https://exam\nple.com/"), n, F.lit(" now. mail ada"), n, F.lit("@exa\nmple.com"))
    out = detect.line_wrapped(_orders(spark, d).withColumn("text", text), R.GENERAL)
    return out.select("doc_id", "start", "end", "value", "entity_type")


@query(f"""WITH p AS ({_KEYS}) SELECT doc_id, col, 'CREDIT_CARD' AS entity_type, 0 AS "start", 8 AS "end", col = 0 AS first FROM p, (SELECT unnest([0, 1]) AS col)""")
def table_run_merges(spark, d):
    """Card numbers cut over two cells of a row."""
    card = F.col("c")
    rows = _orders(spark, d).withColumn("c", _card()).withColumn("block_id", F.lit("t")).withColumn("row", F.lit(0))
    cells = F.array(F.struct(F.lit(0).alias("col"), F.substring(card, 1, 8).alias("text")), F.struct(F.lit(1).alias("col"), F.substring(card, 9, 8).alias("text")))
    cells = rows.select("doc_id", "block_id", "row", F.explode(cells).alias("c")).select("doc_id", "block_id", "row", "c.*")
    return tables.run_merges(cells).select("doc_id", "col", "entity_type", "start", "end", "first")


@query(f"""SELECT doc_id, 0 AS col, 2 AS next_col, 'EMAIL_ADDRESS' AS entity_type, 'ada' || k || '@x.org.uk' AS value, 5 AS "start", 4 AS next_end FROM ({_KEYS}) WHERE k % 2 = 0""")
def edge_extensions(spark, d):
    """An address that stops at a cell's edge and goes on in the next clean cell; a blank before the edge ends it."""
    k = F.col("k").cast("string")
    first = F.concat(F.lit("mail ada"), k, F.when(F.col("k") % 2 == 0, "@x.or").otherwise("@x.or "))
    cells = F.array(F.struct(F.lit(0).alias("col"), first.alias("text")), F.struct(F.lit(2).alias("col"), F.lit("g.uk").alias("text")), F.struct(F.lit(3).alias("col"), F.lit("z").alias("text")))
    rows = _orders(spark, d).select("doc_id", F.lit("t").alias("block_id"), F.lit(0).alias("row"), F.explode(cells).alias("c")).select("doc_id", "block_id", "row", "c.*")
    return tables.edge_extensions(rows).drop("block_id", "row")


# --- repair, propagation ---


@query(f"""WITH p AS (SELECT doc_id, k, 'k' || {pad(6)} || 'xyz' || {pad(5)} AS s FROM ({_KEYS}))
SELECT doc_id, CASE k % 3 WHEN 0 THEN 'a <SENSITIVE_1> x <SENSITIVE_1> end' WHEN 1 THEN 'a <SENSITIVE_1> x <SENSITIVE_1> and <SENSITIVE_2> end' ELSE 'a clean text' END AS masked_text,
  CAST(CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS n_masked, 0 AS n_left FROM p""")
def probe_repair(spark, d):
    """Secrets that only the audit finds, repeated in other spellings: every place is masked in the second round."""
    s = F.expr(f"'k' || {pad(6)} || 'xyz' || {pad(5)}")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a secret: "), s, F.lit(" x SECRET:  "), F.upper(s), F.lit(" end")))
    text = text.when(F.col("k") % 3 == 1, F.concat(F.lit("a secret: "), s, F.lit(" x secret: "), s, F.lit(" and token=abcdefghijkl end"))).otherwise("a clean text")
    out = masking.audited_rows(_orders(spark, d).withColumn("text", text), R.PLAIN)
    return out.select("doc_id", "masked_text", "n_masked", F.size("residuals").alias("n_left"))


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units u2 of planted spellings, the resolved spans of u1, their tokens."""
    k = F.col("k").cast("string")
    units = _orders(spark, d).select("doc_id", F.lit("u2").alias("unit_id"), F.concat(F.lit("x AyşeYılmaz ile YILMAZ; Deniz Gıda ve ADA"), k, F.lit(" @X.ORG son")).alias("text"))
    spans = F.array(*[F.struct(F.lit(at).alias("start"), v.alias("value"), F.lit(t).alias("entity_type")) for at, v, t in ((0, F.lit("Ayşe Yılmaz"), "PERSON"), (20, F.lit("Deniz Gıda A.Ş."), "TR_COMPANY"), (40, F.concat(F.lit("ada"), k, F.lit("@x.org")), "EMAIL_ADDRESS"))])
    spans = _orders(spark, d).select("doc_id", F.lit("u1").alias("unit_id"), F.explode(spans).alias("s")).select("doc_id", "unit_id", "s.*")
    return units, spans, mask.numbered(spans, ("doc_id", "unit_id"))


@query(f"""WITH p AS (SELECT doc_id, CAST(k AS VARCHAR) AS n FROM ({_KEYS}))
SELECT doc_id, 2 AS "start", 12 AS "end", 'AyşeYılmaz' AS value, 'PERSON' AS family, 'glued' AS mode FROM p UNION ALL SELECT doc_id, 17, 23, 'YILMAZ', 'PERSON', 'surname' FROM p
UNION ALL SELECT doc_id, 25, 35, 'Deniz Gıda', 'ORG', 'company' FROM p UNION ALL SELECT doc_id, 39, CAST(42 + length(n) + 7 AS INTEGER), 'ADA' || n || ' @X.ORG', 'EMAIL', 'any' FROM p""")
def planted_variants(spark, d):
    """Other spellings of masked values: run together, the surname alone, a short company name, spaced and in capitals."""
    ship(spark)
    units, spans, _ = _people(spark, d)
    return propagate.variants(units, propagate.needles(spans)).drop("unit_id")


@query(f"""SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'x <PERSON_2> ile <PERSON_3>; Deniz Gıda ve <EMAIL_2> son' ELSE 'x <PERSON_2> ile <PERSON_3>; <ORG_2> ve <EMAIL_2> son' END AS masked_text,
  CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE 4 END AS INTEGER) AS n_masked FROM ({_KEYS})""")
def variants_masked(spark, d):
    """The same masked too, but for what lies in a kept range."""
    ship(spark)
    units, spans, tokens = _people(spark, d)
    keeps = units.where("doc_id % 2 = 0").select("doc_id", "unit_id", F.lit(25).alias("start"), F.lit(35).alias("end"))
    out = propagate.applied(units.withColumnRenamed("text", "masked_text"), propagate.variants(units, propagate.needles(spans)), tokens, keeps)
    return out.select("doc_id", "masked_text", "n_masked")


@query(f"""WITH p AS (SELECT doc_id, lpad(CAST(k AS VARCHAR), 8, '0') AS n FROM ({_KEYS}))
SELECT doc_id, 'any' AS mode, 'ada' || n || '@x.org' AS needle, 'EMAIL' AS family FROM p
UNION ALL SELECT doc_id, 'glued', 'ayseyilmaz', 'PERSON' FROM p UNION ALL SELECT doc_id, 'surname', 'yilmaz', 'PERSON' FROM p
UNION ALL SELECT doc_id, 'company', x, 'ORG' FROM p, (SELECT unnest(['denizgid', 'denizgida', 'denizgidaa', 'denizgidaa.', 'denizgidaa.s', 'denizgidaa.s.', 'gidaa.s.']) AS x)""")
def variant_needles(spark, d):
    """What is searched for, of each kind of value."""
    ship(spark)
    n = F.lpad(F.col("k").cast("string"), 8, "0")
    spans = F.array(*[F.struct(F.lit(at).alias("start"), v.alias("value"), F.lit(t).alias("entity_type")) for at, v, t in ((0, F.lit("Ayşe Yılmaz"), "PERSON"), (20, F.lit("Deniz Gıda A.Ş."), "TR_COMPANY"), (40, F.concat(F.lit("ada"), n, F.lit("@x.org")), "EMAIL_ADDRESS"))])
    spans = _orders(spark, d).select("doc_id", F.lit("u1").alias("unit_id"), F.explode(spans).alias("s")).select("doc_id", "unit_id", "s.*")
    return propagate.needles(spans).drop("first_at")


@query("""WITH d AS (SELECT DISTINCT p_brand AS key FROM part WHERE p_size > 40), a AS (SELECT DISTINCT p_brand AS key FROM part WHERE p_size < 5), k AS (SELECT DISTINCT p_brand AS key FROM part WHERE p_size = 7)
(SELECT key FROM a EXCEPT SELECT key FROM d) UNION SELECT key FROM k""")
def allowed_terms(spark, d):
    """Allowed, less what is denied, and what a document keeps."""
    part = spark.read.parquet(f"{d}/part.parquet")
    keys = lambda c: part.where(c).select(F.col("p_brand").alias("key")).distinct()
    return allow_minus_deny(keys("p_size < 5"), keys("p_size > 40"), keys("p_size = 7"))


@query(f"""WITH p AS (SELECT doc_id, CAST(k AS VARCHAR) AS n FROM ({_KEYS}))
SELECT doc_id, 'call <PHONE_1> or <X> now' AS text, 2 AS n_edits FROM p""")
def absorbed_edits(spark, d):
    """A later pass that hits across an earlier replacement: both become one edit with the text that stands there."""
    k = F.col("k").cast("string")
    rows = _orders(spark, d).withColumn("text", F.concat(F.lit("call 0532 or ada"), k, F.lit("@x.org, bob@y.org now")))
    size = F.char_length(k)
    first = F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit(5).alias("masked_start"), F.lit(14).alias("masked_end"), F.lit("<PHONE_1>").alias("token"))
    a = F.struct(F.lit(13).alias("start"), (size + 22).alias("end"), F.lit(18).alias("masked_start"), F.lit(27).alias("masked_end"), F.lit("<EMAIL_1>").alias("token"))
    current = F.concat(F.lit("call <PHONE_1> or <EMAIL_1>, bob@y.org now"))
    rows = rows.withColumn("e", mask.absorbed(current, F.array(first, a), F.lit(18), F.lit(38), F.lit("<X>")))
    return rows.select("doc_id", mask.spliced(F.col("text"), F.col("e")).alias("text"), F.size("e").alias("n_edits"))
