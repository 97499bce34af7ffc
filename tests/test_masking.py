import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.spans import regex_spans
from maskloom.operators import detect, lists, mask, propagate, tables
from maskloom.operators import recognizers as R
from maskloom.operators.types import entity_types, family_of, tier_of
from maskloom.plans import masking


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, text, recognizers=R.ALL, **kw):
    return {(r["entity_type"], r["value"]) for r in detect.detect(docs(spark, text), recognizers, **kw).collect()}


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("mail ada@example.com now", "EMAIL_ADDRESS", "ada@example.com"),
        ("no 10000000146 ok", "TR_TCKN", "10000000146"),
        ("ara 0532 123 45 67 hemen", "TR_GSM", "0532 123 45 67"),
        ("TR33 0006 1005 1978 6457 8413 26", "TR_IBAN", "TR33 0006 1005 1978 6457 8413 26"),
        ("plaka 34 ABC 123 var", "TR_PLATE", "34 ABC 123"),
        ("pass U12345678 x", "TR_PASSPORT", "U12345678"),
        ("hesap 8842-556310-04 x", "TR_ACCOUNT", "8842-556310-04"),
        ("k sk_live_abcdEFGH1234", "SECRET_KEY", "sk_live_abcdEFGH1234"),
        ("maaş 10.000-12.000 TL", "TR_SALARY_BAND", "10.000-12.000 TL"),
        ("Deniz Yıldızı Gıda A.Ş. ile", "TR_COMPANY", "Deniz Yıldızı Gıda A.Ş."),
        ("Atatürk Caddesi No: 12, Çankaya", "TR_ADDRESS", "Atatürk Caddesi No: 12, Çankaya"),
        ("%40 görme kaybı", "TR_DISABILITY", "%40 görme kaybı"),
        ("tanı: DİYABET".replace("İ", "i"), "TR_HEALTH", "DiYABET"),
        ("Sayın Ayşe Yılmaz geldi", "TR_PERSON_CTX", "Ayşe Yılmaz"),
        ("x\nAdı: Mehmet Kaya\ny", "TR_PERSON_CTX", "Mehmet Kaya"),
        ("ssn 123-45-6789", "US_SSN", "123-45-6789"),
        ("passport AB1234567", "PASSPORT", "AB1234567"),
        ("card 4111111111111111", "CREDIT_CARD", "4111111111111111"),
    ],
)
def test_recognizers(spark, text, kind, value):
    assert (kind, value) in found(spark, text)


def missing(spark, cases):
    """Of (text, entity_type, value) those that are not found."""
    out = detect.detect(docs(spark, *[text for text, _, _ in cases]), R.ALL).select("doc_id", "entity_type", "value").collect()
    hits = {tuple(r) for r in out}
    return [c for i, c in enumerate(cases) if (i, c[1], c[2]) not in hits]


def test_every_term_label_and_prefix(spark):
    cases = [(f"tanı: {t}, x", "TR_HEALTH", t) for t in R.HEALTH_TERMS]
    cases += [(f"x {t} Ayşe Nur Yılmaz geldi", "TR_PERSON_CTX", "Ayşe Nur Yılmaz") for t in R.PERSON_LABELS]
    cases += [(f"{t}: Ayşe Yılmaz geldi", "TR_PERSON_CTX", "Ayşe Yılmaz") for t in R.PERSON_LABELS]
    cases += [(f"x\n {t} : AYŞE NUR\ny", "TR_PERSON_CTX", "AYŞE NUR") for t in R.NAME_LABELS]
    cases += [(f"DENEME {m} NO: 123 / NO: 45 ÖRNEK / İL", "TR_ADDRESS", f"DENEME {m} NO: 123 / NO: 45 ÖRNEK / İL") for m in R.MARKERS]
    cases += [(f"Uzun Yol {n} No. 7 Çankaya Ankara", "TR_ADDRESS", f"Uzun Yol {n} No. 7 Çankaya Ankara") for n in R.STREETS]
    cases += [(v, "TR_DISABILITY", v) for s in R.SENSES for v in (f"%40 {s} kaybı", f"% 40 {s} kaybi", f"{s} engel (%40)", f"%40 {s} engel")]
    cases += [(f"x {p}_{'a1' * 10} y", "SECRET_KEY", f"{p}_{'a1' * 10}") for p in ("ghp", "gho", "ghu", "ghs", "ghr")]
    cases += [(f"x {a}_{b}_9Qm2 y", "SECRET_KEY", f"{a}_{b}_9Qm2") for a in ("sk", "pk", "rk") for b in ("live", "test")]
    cases += [
        ("sk_live_9Qm2f XbT7hVrN4KpLZ olarak", "SECRET_KEY", "sk_live_9Qm2f XbT7hVrN4KpLZ"),
        ("sk_live_9Qm2f olarak", "SECRET_KEY", "sk_live_9Qm2f"),
        ("SK_LIVE_9QM2F x", "SECRET_KEY", "SK_LIVE_9QM2F"),
        ("Bearer  abcdef0123456789", "SECRET_KEY", "Bearer  abcdef0123456789"),
        ("DIŞ KAPI: ÖRNEK MAH. DENEME SK. DIŞ KAPI NO: 12/3 İÇ KAPI NO: 5", "TR_ADDRESS", "ÖRNEK MAH. DENEME SK. DIŞ KAPI NO: 12/3 İÇ KAPI NO: 5"),
        ("ABC Metal A.Ş. ile", "TR_COMPANY", "ABC Metal A.Ş."),
    ]
    key = "a1-b2_" * 6 + "z"
    cases += [(f"{w}: {key} x", "SECRET_KEY", key) for w in ("token", "anahtar", "credential", "sifre", "parola", "authorization")]
    cases += [(f"{w} 1234567 x", "TR_ACCOUNT", "1234567") for w in ("hesap", "müşteri", "musteri", "abone", "sözleşme", "sozlesme", "cari", "account", "iban")]
    cases += [(f"{w} 10.000-12.000 TL", "TR_SALARY_BAND", "10.000-12.000 TL") for w in ("maaş", "ücret", "gelir", "salary", "bandı", "bordro")]
    assert missing(spark, cases) == []
    assert len(R.HEALTH_TERMS) == 30 and len(R.PERSON_LABELS) == 19 and len(R.NAME_LABELS) == 29 and len(R.MARKERS) == 22
    assert not found(spark, "koahlı, astımlı: tanı yok")


def test_context_is_needed_for_weak_patterns(spark):
    assert ("TR_VKN", "1234567890") in found(spark, "vergi no 1234567890")
    assert not any(k == "TR_VKN" for k, _ in found(spark, "toplam 1234567890"))
    assert not any(k == "TR_TCKN" for k, _ in found(spark, "kimlik 10000000147"))


def test_patterns_against_pythons_re(spark):
    """Every pattern finds what Python's re finds with the same pattern, in texts of several scripts."""
    texts = [
        "ıTR33 0006 1005 1978 6457 8413 26 tr330006100519786457841326ş", "+90 532 764 21 09 a05321234567 0532-764-21-09", "34 kvr 218, 34KVR218x 81 ŞB 12", "u12345678 U12345678é", "8842-556310-04-1 8842-556310-04", "GHP_ABCDEFGHIJ0123456789 xghp_abcdefghij0123456789",
        "bearer  abcdefghijklmnop", "eyJabcdefgh.abcdefgh.abc eyJabcdefgh.abcdefgh.abcdefgh", "60.000-85.000 tl, 120.000 TL üzeri", "Öz Gıda A.Ş. ve ABC Koll. Şti.", "Koah, KOAH MİGREN meme kanseri", "+44 7911 123456 020 7946 0958", "123-45-6789 0123-45-6789", "4111 1111 1111 1111 4111-1111-1111-1111",
    ]
    df = docs(spark, *texts)
    names = {"\\p{L}\\p{N}_": "\\w", "(?iu:": "(?i:"}
    for r in {x.regex: x for x in R.ALL}.values():
        if "*+" in r.regex or "(?m)" in r.regex:
            continue  # possessive and multi-line forms are tested by the terms above
        pattern = r.regex
        for a, b in names.items():
            pattern = pattern.replace(a, b)
        flags = re.IGNORECASE if pattern.startswith("(?iu)") else 0
        pattern = pattern.removeprefix("(?iu)")
        found_ = {row["doc_id"]: [(h["start"], h["end"]) for h in row["s"]] for row in df.select("doc_id", regex_spans(F.col("text"), r.regex).alias("s")).collect()}
        assert found_ == {i: [m.span() for m in re.finditer(pattern, t, flags)] for i, t in enumerate(texts)}, r.entity_type


def test_null_and_empty_texts(spark):
    assert detect.detect(docs(spark, None, "", " "), R.ALL).count() == 0
    rows = masking.masked_rows(docs(spark, None, "", "x"), R.GENERAL).orderBy("doc_id").collect()
    assert [(r["masked_text"], r["n_masked"]) for r in rows] == [(None, 0), ("", 0), ("x", 0)]


def test_line_wraps(spark):
    out = detect.line_wrapped(docs(spark, "see https://exam\nple.com/abc now", "end.\nada@example.com", "mail ada@exa\nmple.com"), R.GENERAL).collect()
    assert {(r["doc_id"], r["value"]) for r in out} == {(0, "https://exam\nple.com/abc"), (2, "ada@exa\nmple.com")}


def test_gates(spark):
    rows = [
        ("PERSON", "ada Lovelace", "ada Lovelace", "ner", False), ("PERSON", "Ada Lovelace", "by Ada Lovelace", "ner", True), ("PERSON", "Ada", "Ada", "ner", False), ("PERSON", "Ada", "Ada", None, True),
        ("PERSON", "Final Report", "Final Report", "en", False), ("PERSON", "ADA LOVELACE", "DEAR MISS ADA LOVELACE", "tr", False), ("LOCATION", "Tebligat Adresi", "Tebligat Adresi", "ner", False),
        ("TR_PHONE", "12.05.2024", "12.05.2024", "pattern", False), ("TR_PHONE", "212 555 44 33", "212 555 44 33", "pattern", True), ("PERSON", "Ada May\nDue", "Ada May\nDue", "ner", False),
        ("PERSON", "“Tutanağı’nın Eki”", "“Tutanağı’nın Eki”", "ner", False), ("LOCATION", " İzmir", " İzmir", "ner", True),
    ]
    df = spark.createDataFrame([(i, k, v, t, t.index(v), t.index(v) + len(v), s) for i, (k, v, t, s, _) in enumerate(rows)], "i int, entity_type string, value string, text string, start int, end int, source string")
    assert {r["i"] for r in detect.gated(df).collect()} == {i for i, r in enumerate(rows) if r[4]}
    nouns = [w for forms in detect.DOCUMENT_NOUNS_TR for w in forms] + [f[2] + ("ı" if f[2].endswith("lar") else "i") for f in detect.DOCUMENT_NOUNS_TR] + list(detect.DOCUMENT_NOUNS_EN)
    cases = spark.createDataFrame([(f"X {w.title()}'nin y",) for w in nouns], "v string")
    assert cases.where(~detect.contains_document_noun(F.col("v"))).count() == 0
    captions = spark.createDataFrame([(w,) for w in (*detect.FORM_LABELS, *R.NAME_LABELS)], "v string")
    assert captions.where(~detect.form_label(F.col("v"))).count() == 0


def test_external_spans(spark):
    df = spark.createDataFrame([("PER", 0.9), ("ORG", 0.85), ("DATE", 0.9), ("GPE", 0.5)], "label string, score double")
    assert {(r["entity_type"], r["score"]) for r in detect.adopt_ner(df).collect()} == {("PERSON", 0.9), ("LOCATION", 0.5)}


def test_types(spark):
    table = {r["entity_type"]: (r["tier"], r["family"]) for r in entity_types(spark).collect()}
    assert len(table) == 36 - 0 or len(table) == len(set(table))
    df = spark.createDataFrame([("TR_GSM",), ("USER:CASE",), ("NEW",)], "t string")
    assert [tuple(r) for r in df.select(tier_of(F.col("t")), family_of(F.col("t"))).collect()] == [(0, "PHONE"), (0, "CASE"), (1, "NEW")]


def test_lists(spark):
    d = docs(spark, "Acme  Corp and acme\ncorp's", "nothing")
    deny = lists.deny_spans(d, {"acme corp": "ORG", "AND": None}).collect()
    assert {(r["value"], r["entity_type"]) for r in deny} == {("Acme  Corp", "USER:ORG"), ("acme\ncorp", "USER:ORG"), ("and", "SENSITIVE")}
    keep = d.select("doc_id", F.explode(lists.keep_ranges(F.col("text"), ["acme corp"])).alias("k")).select("doc_id", "k.*")
    assert {r["value"] for r in keep.collect()} == {"Acme  Corp", "acme\ncorp's"}
    left = lists.not_contained(lists.deny_spans(d, {"acme corp": None, "and": None}), keep)
    assert [r["value"] for r in left.collect()] == ["and"]
    assert lists.deny_spans(d, {}).count() == 0


def test_effective_terms(spark):
    a = spark.createDataFrame([(0, "Acme", "ORG"), (1, "ACME", "X")], "ord int, term string, family string")
    b = spark.createDataFrame([(0, "acme ", "Y"), (1, "Bolt", None), (2, " ", None)], "ord int, term string, family string")
    out = lists.effective_terms(a, b)
    assert {(r["key"], r["term"], r["family"]) for r in out.collect()} == {("acme", "Acme", "ORG"), ("bolt", "Bolt", None)}
    assert lists.effective_terms(a, b, enabled=False).count() == 0
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert {r["key"] for r in lists.allow_minus_deny(keys("a", "b"), keys("b"), keys("b", "c")).collect()} == {"a", "b", "c"}


TEXTS = ["ada@x.org, ADA@x.org and 10.0.0.1; bob@y.org, 10.0.0.1 ada@x.org", "none", "4111111111111111 +1 (743) 555-3824", "", "é\U0001f642 ada@x.org"]


def test_masking_in_rows_equals_masking_by_joins(spark):
    d = docs(spark, *TEXTS)
    a = masking.masked_rows(d, R.GENERAL).select("doc_id", "masked_text", "n_masked")
    b, tokens = masking.mask_documents(d, R.GENERAL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select("doc_id", "masked_text", "n_masked").collect()))
    first = {r["doc_id"]: r["masked_text"] for r in a.collect()}
    assert first[0] == "<EMAIL_1>, <EMAIL_1> and <IP_1>; <EMAIL_2>, <IP_1> <EMAIL_1>"
    edits = mask.edits(tokens).join(b.select("doc_id", "masked_text"), "doc_id").collect()
    assert edits and all(e["masked_text"][e["masked_start"] : e["masked_end"]] == e["token"] for e in edits)
    back = mask.unmasked(b, mask.mapping(tokens)).collect()
    assert all(r["unmapped"] == [] and r["restored"].lower() == TEXTS[r["doc_id"]].lower() for r in back)


def test_offsets_back_to_the_original(spark):
    d = docs(spark, *TEXTS)
    b, tokens = masking.mask_documents(d, R.GENERAL)
    points = b.select("doc_id", F.explode(F.sequence(F.lit(0), F.char_length("masked_text"))).alias("pos"), "masked_text")
    done = mask.edits(tokens)
    out = mask.original_offset(points.select("doc_id", "pos"), done).collect()
    masked = {r["doc_id"]: r["masked_text"] for r in b.collect()}
    inside = {(e["doc_id"], p) for e in done.collect() for p in range(e["masked_start"], e["masked_end"])}
    for r in out:
        if (r["doc_id"], r["pos"]) not in inside and r["pos"] < len(masked[r["doc_id"]]):
            assert TEXTS[r["doc_id"]][r["original_pos"]] == masked[r["doc_id"]][r["pos"]]


def test_forced_ranges(spark):
    df = spark.createDataFrame([([(0, 5, "A"), (3, 9, "B"), (20, 25, "C")], [(18, 30)])], "m array<struct<start:int,end:int,family:string>>, k array<struct<start:int,end:int>>")
    (row,) = df.select(mask.forced_ranges(F.col("m"), F.col("k")).alias("r")).collect()
    assert [tuple(x) for x in row["r"]] == [(0, 9, "B")]


def cells(spark, *rows):
    return spark.createDataFrame([("d", "t", r, c, t) for r, row in enumerate(rows) for c, t in row], "doc_id string, block_id string, row int, col int, text string")


def test_values_over_two_cells(spark):
    out = tables.run_merges(cells(spark, [(0, "4111 1111"), (3, "1111"), (4, "1111")], [(0, "41111111"), (1, "ada@x.org"), (2, "11111111")], [(0, "411111111"), (1, "1111111"), (2, " word")]))
    got = {(r["row"], r["col"], r["entity_type"], r["first"]) for r in out.collect()}
    assert got == {(0, 0, "CREDIT_CARD", True), (0, 3, "CREDIT_CARD", False), (0, 4, "CREDIT_CARD", False), (2, 0, "CREDIT_CARD", True), (2, 1, "CREDIT_CARD", False)}


def test_value_that_stops_at_a_cell_edge(spark):
    out = tables.edge_extensions(cells(spark, [(0, "mail ada@x.or"), (2, "g.uk"), (3, "z")], [(0, "mail ada@x.org "), (1, "y")])).collect()
    assert [(r["row"], r["col"], r["next_col"], r["value"], r["next_end"]) for r in out] == [(0, 0, 2, "ada@x.org.uk", 4)]


def test_variants(spark):
    units = spark.createDataFrame([("d", "u1", "Ayşe Yılmaz ve Deniz Gıda A.Ş."), ("d", "u2", "AyşeYılmaz ile YILMAZ; Deniz Gıda; <PERSON_1> deniz gıda"), ("e", "u1", "Yılmaz")], "doc_id string, unit_id string, text string")
    spans = spark.createDataFrame([("d", "u1", 0, "Ayşe Yılmaz", "PERSON"), ("d", "u1", 15, "Deniz Gıda A.Ş.", "TR_COMPANY")], "doc_id string, unit_id string, start int, value string, entity_type string")
    out = propagate.variants(units.where("unit_id = 'u2' or doc_id = 'e'"), propagate.needles(spans))
    assert {(r["value"], r["mode"]) for r in out.collect()} == {("AyşeYılmaz", "glued"), ("YILMAZ", "surname"), ("Deniz Gıda", "company")}
