import io
import json
import os
import random
import re
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from maskloom.operators import audit, detect, metrics, retrieval, review, units
from maskloom.operators import recognizers as R
from maskloom.plans import masking
from maskloom.sources import layers, office, uploads
from maskloom.streaming import pipeline as streaming

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- audit ---


def test_residuals(spark):
    texts = {"<EMAIL_1> ok": [], "a@b.co": ["EMAIL"], "kimlik 10000000146": ["TCKN"], "10000000147": [], "sk_live_abcdefgh1": ["SECRET"], "0532 123 45 67": ["TR_PHONE"], "api_key: abcdefghijkl": ["SECRET"]}
    df = table(spark, list(enumerate(texts)), "doc_id long, masked_text string")
    out = {r["doc_id"]: r for r in audit.heuristic_audit(df).collect()}
    for i, want in enumerate(texts.values()):
        assert out[i]["codes"] == want and out[i]["approved"] == (not want) and out[i]["risk_level"] == ("high" if want else "low")


def test_verdicts_fail_closed(spark):
    good = json.dumps({"approved": True, "risk_level": "low", "remaining_sensitive_items": [{"type": "EMAIL", "snippet": "abcd"}, {"type": "ODD", "snippet": "x"}], "recommended_next_action": "approve", "ok": False})
    raw = [good, f"text {{}} {good}", f"```json\n{good}\n```", '{"approved": true', "no json", None, '{"approved": "yes", "risk_level": "low"}', '{"approved": true, "risk_level": "tiny"}', '{"a": "}"} ' + good, "{bad} " + good]
    out = [r["v"] for r in table(spark, list(enumerate(raw)), "i int, raw string").orderBy("i").select(audit.parse_verdict(F.col("raw")).alias("v")).collect()]
    assert [v["ok"] for v in out] == [True, False, True, False, False, False, False, False, False, False]
    assert [tuple(i) for i in out[0]["items"]] == [("EMAIL", 4, None), ("UNKNOWN", 1, None)]
    assert all(not v["approved"] and v["risk_level"] == "high" for v in out if not v["ok"])


def test_combined_audit(spark):
    h = table(spark, [(i, i != 3, "low" if i != 3 else "high", 0 if i != 3 else 2, []) for i in range(5)], "doc_id long, approved boolean, risk_level string, n_found long, codes array<string>")
    item = [("EMAIL", 3, None)]
    m = table(spark, [(0, True, "low", [], "approve", True), (1, True, "low", item, "approve", True), (2, True, "low", [], "approve", False), (3, True, "low", [], "approve", True)], f"doc_id long, {audit.VERDICT}")
    out = {r["doc_id"]: tuple(r)[1:] for r in audit.combined_audit(h, m).collect()}
    assert out == {0: (True, "low", 0, True), 1: (False, "low", 1, True), 2: (False, "high", 0, False), 3: (False, "high", 2, True), 4: (False, "high", 0, False)}
    loose = {r["doc_id"]: r["approved"] for r in audit.combined_audit(h, m, required=False).collect()}
    assert loose == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_null_never_approves(spark):
    row = table(spark, [(1, True, None, False, 0, True), (2, True, True, None, 0, True), (3, True, True, False, None, True), (4, True, True, False, 0, True)], "doc_id int, clean boolean, llm_ok boolean, blocking boolean, pending int, has_output boolean")
    assert {r["doc_id"]: r["status"] for r in audit.route(row).collect()} == {1: "needs_human_review", 2: "needs_human_review", 3: "needs_human_review", 4: "approved"}


def test_whole_plan_and_repair(spark):
    docs = table(spark, [(0, "ada@x.org"), (1, "clean"), (2, "secret: abcdefghijklmn and ada@x.org")], "doc_id long, text string")
    verdict = json.dumps({"approved": True, "risk_level": "low", "remaining_sensitive_items": [], "recommended_next_action": "approve"})
    out = {r["doc_id"]: r["status"] for r in masking.process(docs, table(spark, [(0, verdict), (2, verdict)], "doc_id long, raw string"), R.PLAIN).collect()}
    assert out == {0: "approved", 1: "needs_human_review", 2: "approved"}  # the second was repaired
    again = {r["doc_id"]: r["masked_text"] for r in masking.repaired(docs, R.PLAIN).collect()}
    assert again[0] == "<EMAIL_1>" and again[1] == "clean" and "abcdef" not in again[2] and "ada@" not in again[2]
    twice = table(spark, [(5, "x"), (5, "ada@x.org"), (None, None)], "doc_id long, text string")
    assert sorted(str(r["masked_text"]) for r in masking.process(twice, recognizers=R.PLAIN).collect()) == ["<EMAIL_1>", "None", "x"]
    plan = masking.process(docs, recognizers=R.PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def rounds_by_hand(text, rounds):
    """Mask, audit, deny what was found and mask again, in plain Python, with e-mail addresses as the only detector."""
    terms, out = [], text
    for n in range(rounds):
        spans = [(m.start(), m.end(), "EMAIL") for m in re.finditer(R.EMAIL, text)]
        for t in terms:
            spans += [(m.start(), m.end(), "SENSITIVE") for m in re.finditer(r"\s+".join(map(re.escape, t.split())), text, re.IGNORECASE)]
        kept = []
        for x in sorted(spans, key=lambda x: (x[2] != "EMAIL", x[0] - x[1], x[0])):
            if not any(x[0] < k[1] and k[0] < x[1] for k in kept):
                kept.append(x)
        numbers, out, at = {}, "", 0
        for a, b, family in sorted(kept):
            known = numbers.setdefault(family, {})
            token = known.setdefault(" ".join(text[a:b].lower().split()), f"<{family}_{len(known) + 1}>")
            out, at = out + text[at:a] + token, b
        out += text[at:]
        left = [m.group().strip() for c, p in audit.HARD_PATTERNS if c != "EMAIL" for m in re.finditer(p, re.sub(r"<[A-Z_]+_\d+>", " ", out))]
        if not left:
            break
        terms += left
    return out, len(left)


def test_repair_rounds_against_plain_python(spark):
    texts = [
        "secret: abcdefghijklmn x secret: abcdefghijklmn y", "SECRET: ABCDEFGHIJKLMN and secret:  abcdefghijklmn, ada@x.org, token=zyxwvutsrqpo", "clean", "",
        "sk_live_abcdefgh12 sk_live_abcdefgh12. ghp_abcdefghij0123456789 0532 123 45 67 / 0532 123 45 67", "4111 1111 1111 1111; 4111 1111 1111 1111",
    ]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string")
    for rounds in (1, 2, 3):
        out = {r["doc_id"]: (r["masked_text"], r["n_left"]) for r in masking.repaired(df, (R.PLAIN[0],), rounds=rounds).collect()}
        assert out == {i: rounds_by_hand(t, rounds) for i, t in enumerate(texts)}


#: Texts in which word bounds, digits and case of other scripts matter.
SCRIPTS = [
    "ş.öz@örnek.com ve 34 ŞB 123; tr33 0006 1005 1978 6457 8413 26 x", "é4111 1111 1111 1111é 4111-1111-1111-1111 é", "tel +90 (532) 123-45-67, 0212 555 34 76.", "123-45-6789 10000000146 1234567890 U12345678",
    "ıTR330006100519786457841326ş TR330006100519786457841326", "05321234567 ğ05321234567 +90 532 123 45 67", "Secret:\u00a0abcdefghijklmnop API-KEY = abcdefghijkl password abcdefghijklm", "sk_live_abcdefgh1 xsk_live_abcdefgh1 AKIAABCDEFGHIJ12 ghp_abcdefghij0123456789 AIza0123456789abcdefgh",
    "٠١٢٣٤٥٦٧٨٩ 34 abc 123", "", "99 ÖÇŞ 9999 99ÖÇŞ99",
]


def test_audit_and_log_patterns_against_pythons_re(spark):
    df = table(spark, list(enumerate(SCRIPTS)), "i int, t string")
    rows = df.select("i", audit.redacted(F.col("t")).alias("r"), audit.mini_redacted(F.col("t")).alias("m"), audit.residuals(F.col("t")).alias("h")).collect()
    for r in rows:
        want = SCRIPTS[r["i"]]
        mini = re.sub(audit.NUMBERS, "<NUM>", re.sub(audit.LOG_PATTERNS[0][1], "<EMAIL>", want))
        hard = [(c, m.start(), m.end(), m.group()) for c, p in audit.HARD_PATTERNS for m in re.finditer(p, want)]
        for label, pattern in audit.LOG_PATTERNS:
            want = re.sub(pattern, f"<{label}_REDACTED>", want)
        assert r["r"] == want and r["m"] == mini
        assert [tuple(x) for x in r["h"] if x["code"] != "TCKN"] == hard


def test_log_redaction_order(spark):
    df = table(spark, [("ada@x.org 123-45-6789 4111111111111111 10000000146 34 ABC 12",)], "t string")
    assert df.select(audit.redacted(F.col("t")).alias("r")).first()["r"] == "<EMAIL_REDACTED> <SSN_REDACTED> <CARD_REDACTED> <TCKN_REDACTED> <PLATE_REDACTED>"


# --- review ---


def test_locating_terms(spark):
    u = table(spark, [("d", "u1", "Ada  Love and <ADA_1> ADA\nlove"), ("d", "u2", "ada love. x"), ("e", "u1", "ada love")], "doc_id string, unit_id string, masked_text string")
    terms = table(spark, [("d", "ada love"), ("d", "a.c"), ("d", " ")], "doc_id string, term string")
    out = review.locate_terms(u, terms, ("doc_id", "unit_id"))
    assert sorted((r["unit_id"], r["start"], r["end"], r["f"]) for r in out.collect()) == [("u1", 0, 9, 1), ("u1", 22, 30, 2), ("u2", 0, 8, 3)]
    assert [r["term"] for r in review.unlocated(terms.where("trim(term) <> ''"), out).collect()] == ["a.c"]


def test_terms_with_quotes_of_patterns(spark):
    u = table(spark, [("d", "a\\E( B and <AB_1> A\\e(\n b")], "doc_id string, masked_text string")
    terms = table(spark, [("d", r"a\E( b"), ("d", "\t"), ("d", "b")], "doc_id string, term string")
    out = review.locate_terms(u, terms).orderBy("f").collect()
    assert [(r["start"], r["end"], r["term"]) for r in out] == [(0, 6, r"a\E( b"), (5, 6, "b"), (18, 25, r"a\E( b"), (24, 25, "b")]


def test_placed_findings_against_plain_python(spark):
    rng = random.Random(5)
    found, done, keeps = [], [], []
    for doc in range(30):
        at, moved = 0, 0
        for _ in range(rng.randrange(6)):
            at += rng.randrange(4, 30)
            size, token = rng.randrange(1, 12), rng.randrange(5, 9)
            done.append((doc, at, at + size, at + moved, at + moved + token))
            at, moved = at + size, moved + token - size
        keeps += [(doc, s, s + rng.randrange(60)) for s in rng.sample(range(150), 3)]
        found += [(doc, s, s + rng.randrange(1, 9), t) for s in rng.sample(range(200), 20) for t in ("x", "y")]
    found.append(found[0])  # rows of one place stay as many as they are
    back = lambda doc, p: p + max([(m, e - m) for d, _, e, _, m in done if d == doc and m <= p], default=(0, 0))[1]
    want = []
    for doc, s, e, term in found:
        a, b = back(doc, s), back(doc, e)
        want.append((doc, s, e, term, a, b, "kept" if any(d == doc and x <= a and b <= y for d, x, y in keeps) else "open"))
    f = table(spark, found, "doc_id long, start int, end int, term string")
    edits = table(spark, done, "doc_id long, start int, end int, masked_start long, masked_end long")
    out = review.placed(f, edits, table(spark, keeps, "doc_id long, start int, end int"))
    assert sorted(map(tuple, out.select("doc_id", "start", "end", "term", "original_start", "original_end", "status").collect())) == sorted(want)
    assert "Join " not in out._jdf.queryExecution().optimizedPlan().toString()


def test_decisions(spark):
    f = table(spark, [("d", 1, "Ada"), ("d", 2, "ada"), ("e", 1, "Ada"), ("e", 2, "Bob")], "doc_id string, f int, term string")
    d = table(spark, [("d", 2, "ada", "occurrence", "mask", 1), (None, None, "ADA", "global", "keep", 2), ("e", None, "bob", "document", "mask", 3)], "doc_id string, f int, term string, scope string, op string, at int")
    out = {(r["doc_id"], r["f"]): r["status"] for r in review.decided(f, d).collect()}
    assert out == {("d", 1): "kept", ("d", 2): "masked", ("e", 1): "kept", ("e", 2): "masked"}
    stale = table(spark, [("d", 1), ("e", 2)], "doc_id string, expected_revision int")
    state = table(spark, [("d", 1, 1, "x", "x", True), ("e", 3, 3, "x", "y", True)], "doc_id string, revision int, audited_revision int, digest string, audited_digest string, llm_ok boolean")
    assert [r["doc_id"] for r in review.fresh(stale, state).collect()] == ["d"] == [r["doc_id"] for r in review.may_approve(state).collect()]


def test_decisions_on_one_term_are_not_paired_with_all_its_findings(spark):
    n = 4000
    f = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("f"), F.lit("Ada").alias("term"))
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("f"), F.lit("ADA").alias("term"), F.lit("document").alias("scope"), F.when(F.col("id") % 2 == 0, "mask").alias("op"), F.col("id").alias("at"))
    every = d.where("doc_id < 2").withColumn("scope", F.lit("global")).withColumn("op", F.lit("keep"))
    out = review.decided(f.union(f), d.where("doc_id < 3000").unionByName(every))
    assert {(r["status"], r["count"]) for r in out.groupBy("status").count().collect()} == {("masked", 1500), ("open", 1500), ("kept", 1000)}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any(" OR " in line for line in joins)  # equalities only: a hot term makes no pairs


def test_pending_of_decided_findings(spark):
    f = spark.range(3000).select((F.col("id") % 1000).alias("doc_id"), (F.col("id") / 1000).cast("int").alias("f"), F.lit("Ada").alias("term"))
    d = f.where("f = 1 and doc_id < 400").select("doc_id", "f", F.lit("ada").alias("term"), F.lit("occurrence").alias("scope"), F.lit("mask").alias("op"), F.lit(1).alias("at"))
    whole = d.where("doc_id < 100").withColumn("scope", F.lit("document"))
    out = review.pending(review.decided(f, d.union(whole)))
    assert {(r["pending"], r["count"]) for r in out.groupBy("pending").count().collect()} == {(0, 100), (2, 300), (3, 600)}
    assert not any(" OR " in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)


def test_lists_and_pages(spark):
    final = table(spark, [("a", "masked", "A")], "key string, state string, term string")
    repairs = table(spark, [("a", "open", "a"), ("b", "open", "b")], "key string, state string, term string")
    assert {(r["key"], r["state"]) for r in review.term_life(final, repairs).collect()} == {("a", "masked"), ("b", "open")}
    lists_ = table(spark, [("a", "always"), ("b", "never")], "key string, list string")
    changes = table(spark, [("a", "never", 1), ("c", "always", 2), ("b", "remove", 3)], "key string, list string, at int")
    assert {tuple(r) for r in review.always_or_never(lists_, changes).collect()} == {("a", "never"), ("c", "always")}
    words = table(spark, [("d", "b", "x", i) for i in range(3)] + [("d", "b", "y", 9)], "doc_id string, block_id string, value string, ord int")
    spans = table(spark, [("d", "b", "x", 0), ("d", "b", "y", 5)], "doc_id string, block_id string, value string, start int")
    assert {(r["value"], r["ord"]) for r in review.page_marks(words, spans).collect()} == {("x", 0), ("x", 1), ("x", 2), ("y", 9)}


def test_status_steps(spark):
    df = table(spark, [("queued", "extracted"), ("queued", "approved"), ("odd", "queued"), ("rejected", "queued")], "a string, b string")
    assert [r[0] for r in df.select(audit.step_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


# --- retrieval ---


def chunks_by_hand(text, size):
    """The packing rule, character by character."""
    inside = lambda t, at: any(m.start() < at < m.end() for m in re.finditer(r"<[A-Z_]+_[0-9]+>", t))
    pieces = []
    for line in (text or "").splitlines():
        rest = line if line.strip() else ""
        while len(rest) > size:
            at = max((i for i in range(size // 2, size + 1) if rest[i] == " "), default=0)
            at = at or max(i for i in range(1, size + 1) if not inside(rest, i))
            pieces.append(rest[:at].rstrip())
            rest = rest[at:].lstrip()
        pieces.append(rest)
    out = []
    for p in filter(str.strip, pieces):
        if out and len(out[-1]) + 1 + len(p) <= size:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["a b\n\n c\n" + "x" * 20, "word " * 40, "y" * 70, "p <PERSON_12> " * 10, None, "", "\n \n", "z" * 25 + "<PERSON_1>" * 6, "\U0001f642 é" * 30, "a\r\nb\x0bc\x85d  e", " " * 40 + "x " * 30]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", "<ORG_7>", "longerword", "é"]) for _ in range(rng.randrange(120))) for _ in range(40)]
    df = table(spark, list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in retrieval.chunk_texts(df, 30).orderBy("doc_id", "part").collect():
        found.setdefault(r["doc_id"], []).append((r["part"], r["text"]))
    for i, t in enumerate(texts):
        assert found.get(i, []) == list(enumerate(chunks_by_hand(t, 30), 1)), t


def test_bm25_against_plain_python(spark):
    import math
    import re

    texts = ["the cat sat", "the dog", "a cat and a cat", "", "bird"]
    df = table(spark, [(i, 1, t) for i, t in enumerate(texts)], "doc_id long, part int, text string")
    out = [(r["doc_id"], r["score"], r["id"]) for r in retrieval.sourced(retrieval.bm25(df, "Cat the cat", None)).collect()]
    toks = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    avg, n = sum(map(len, toks)) / len(toks), len(toks)

    def score(t):
        s = 0
        for q in ["cat", "the", "cat"]:
            df_ = sum(q in x for x in toks)
            f = t.count(q)
            s += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        return s

    want = sorted(((-score(t), i) for i, t in enumerate(toks)))
    assert [i for i, _, _ in sorted(out, key=lambda r: int(r[2][1:]))] == [i for _, i in want]
    assert all(s == pytest.approx(score(toks[i]), abs=1e-8) for i, s, _ in out)


def test_citations_and_excerpts(spark):
    df = table(spark, [("a [S1, S2] b [S3]", True), ("none", False), ("[S1] [S9]", False), ("[S1,S2]", False)], "t string, ok boolean")
    known = F.array(*[F.lit(f"S{i}") for i in (1, 2, 3)])
    rows = df.select("ok", retrieval.citations_valid(F.col("t"), known).alias("v"), retrieval.normal_citations(F.col("t")).alias("n")).collect()
    assert rows[0]["n"] == "a [S1][S2] b [S3]" and [r["v"] for r in rows][:3] == [True, False, False]
    long = table(spark, [("w " * 300 + "end",), ("short  text",), ("x" * 395 + " <PERSON_1> y",)], "t string")
    out = [r["e"] for r in long.select(retrieval.excerpt(F.col("t")).alias("e")).collect()]
    assert out[1] == "short text" and out[0].endswith("…") and "<" not in out[2]


# --- units ---


def test_units_and_tables(spark):
    blocks = table(spark, [("d", 0, "b", "x", None), ("d", 1, "b", "y", None), ("d", 2, "t", "", [(0, 0, "p"), (1, 2, "q")])], "doc_id string, ord int, block_id string, text string, cells array<struct<row:int,col:int,text:string>>")
    assert [(r["unit_ord"], r["unit_id"], r["text"]) for r in units.explode_units(blocks).orderBy("unit_ord").collect()] == [(1, "b", "x"), (2, "b#2", "y"), (3, "t:r0c0", "p"), (4, "t:r1c2", "q")]
    c = table(spark, [("d", "t", 0, 2, "c", 0), ("d", "t", 0, 0, "a", 1), ("d", "t", 1, 1, "old", 2), ("d", "t", 1, 1, "new", 3)], "doc_id string, block_id string, row int, col int, text string, ord int")
    assert units.plain_rows(c.where("ord <> 2")).first()["text"] == "a | c\nnew"
    assert sorted((r["row"], r["values"]) for r in units.dense_rows(c).collect()) == [(0, ["a", "", "c"]), (1, ["", "new", ""])]


def test_language_rules(spark):
    df = table(spark, [(5, 0.9, 0.1), (50, 0.4, 0.3), (50, 0.8, 0.1), (50, 0.1, 0.7), (50, 0.2, 0.1)], "n int, tr double, en double")
    assert [r[0] for r in df.select(units.language_rule(F.col("n"), F.col("tr"), F.col("en"))).collect()] == ["unknown", "mixed", "tr", "en", "unknown"]
    w = table(spark, [(["ocr:low", "x"], "t"), ([], " ")], "w array<string>, t string")
    assert [r[0] for r in w.select(units.blocking_reasons(F.col("w"), F.col("t"), {"ocr": "scan"})).collect()] == [["scan"], ["no_text"]]


# --- evaluation ---


def test_span_scores_and_empty_conventions(spark):
    s = "doc_id int, start int, end int"
    g, p = table(spark, [(1, 0, 5), (1, 10, 12), (2, 0, 1)], s), table(spark, [(1, 4, 11), (2, 1, 2)], s)
    r = metrics.span_scores(g, p).first()
    assert (r["precision"], r["recall"]) == (0.5, pytest.approx(2 / 3))
    e = metrics.span_scores(g.limit(0), p.limit(0)).first()
    assert (e["precision"], e["recall"], e["over_masking"]) == (1.0, 1.0, 0.0)


def test_mentions(spark):
    m = table(spark, [(1, "a", 0, 8, "Ada Love"), (1, "b", 20, 23, "Bob"), (1, "c", None, None, "Gone")], "doc_id int, mention_id string, start int, end int, surface string")
    d = table(spark, [(1, 0, 3), (1, 1, 5), (1, 20, 30)], "doc_id int, start int, end int")
    k = table(spark, [(1, "<P_1> Love x Bob")], "doc_id int, masked_text string")
    out = {r["mention_id"]: r for r in metrics.mention_results(m, d, k).collect()}
    assert (out["a"]["detected_chars"], out["a"]["partially_detected"], out["a"]["masked"], out["a"]["residual_chars"]) == (5, True, True, 4)
    assert out["b"]["fully_detected"] and not out["b"]["masked"]
    assert not out["c"]["located"] and not out["c"]["masked"] and out["c"]["detected_chars"] == 0


def test_small_metrics(spark):
    df = table(spark, [("aXaXa", "aXa", 2), ("abc", "z", 1), ("abc", "b", 1)], "t string, s string, n int")
    assert [r[0] for r in df.select(metrics.locate(F.col("t"), F.col("s"), F.col("n"))).collect()] == [2, None, 1]
    values = {"a": [float(i) for i in range(1, 21)], "b": [7.0], "c": [1.0] * 90 + [2.0] * 9 + [1e9], "d": [None], "e": [0.0, None, -5.0]}
    v = table(spark, [(g, x) for g, xs in values.items() for x in xs], "g string, v double")
    for q, want in ((0.95, {"a": 19.0, "b": 7.0, "c": 2.0, "e": 0.0}), (1.0, {"a": 20.0, "b": 7.0, "c": 1e9, "e": 0.0}), (0.0, {"a": 1.0, "b": 7.0, "c": 1.0, "e": -5.0})):
        assert {r["g"]: r["ranked"] for r in metrics.nearest_rank(v, "g", "v", q, buckets=4).collect()} == want
    c = table(spark, [("Ada Love", "x Love y", True), ("Ada", "x", True), ("Ada", "x", False)], "surface string, masked_text string, processed boolean")
    assert [r["escape"] for r in metrics.escapes(c).collect()] == [True, False, True]
    o = table(spark, [(["a", "b", "a", "t", "c", "d"], "t", 1)], "d array<string>, t string, s int")
    assert o.select(metrics.attack_options(F.col("d"), F.col("t"), F.col("s")).alias("o")).first()["o"] == ["a", "t", "b", "c"]
    a = table(spark, [("Ada May Love",)], "v string").select(metrics.variants_of(F.col("v")).alias("v")).first()["v"]
    assert a == ["Ada\nMay Love", "ADA  MAY  LOVE"]
    r = table(spark, [(1, "x", True, True, 3, "DIRECT", "MANDATORY", True, 3, False)], "doc_id int, entity_id string, masked boolean, critical boolean, detected_chars int, identifier_class string, necessity string, located boolean, total_chars int, partially_detected boolean")
    assert metrics.coverage_score(r).first()["score"] == 1.0 and metrics.coverage_score(r.limit(0)).first()["score"] == 0.0
    assert metrics.over_masking(r).first()["over_masking_rate"] == 0.0


# --- sources ---


def package(**parts):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return body.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
DOCX = package(**{
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>{P.format("One")}<w:tbl><w:tr><w:tc>{P.format("a")}</w:tc><w:tc>{P.format("b")}</w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/header1.xml": f"<w:hdr {W}>{P.format('Head')}</w:hdr>",
    "word/header2.xml": f"<w:hdr {W}>{P.format('Head')}</w:hdr>",
})
XLSX = package(**{
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="People"/></sheets></workbook>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Ada</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>12.5</v></c></row></sheetData></worksheet>',
})


def test_pdf_text():
    import zlib

    from maskloom.sources.pdf import pdf_blocks

    def stream(head, data):
        return b"<<" + head + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"

    cmap = b"1 beginbfchar <01> <015E> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange"
    one = b"BT /F1 12 Tf 72 700 Td (Ada \\(L\\)) Tj 0 -14 Td [(Lov) 20 (e) -300 (ace)] TJ ET BT /F1 10 Tf 1 0 0 1 72 500 Tm (Far) Tj 200 0 Td (\\311t\\351) Tj T* (next) Tj ET"
    two = b"BT /F2 12 Tf 10 10 Td <01020304> Tj ET"
    inner = [b"<</Type/Page/Parent 2 0 R/Contents[6 0 R 8 0 R]>>"]
    packed = zlib.compress(b"4 0 " + inner[0])
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R 10 0 R]/Resources<</Font<</F1 5 0 R/F2 7 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 9 0 R>>",
        5: b"<</Type/Font/Subtype/Type1>>", 6: stream(b"", two), 7: b"<</Type/Font/ToUnicode 11 0 R>>", 8: stream(b"", b""), 9: stream(b"/Filter/FlateDecode", zlib.compress(one)),
        10: b"<</Type/Page/Parent 2 0 R/Resources<</XObject<</I 12 0 R>>>>>>", 11: stream(b"", cmap), 12: b"<</Subtype/Image>>", 13: stream(b"/Type/ObjStm/N 1/First 4/Filter/FlateDecode", packed),
    }
    body = b"%PDF-1.7\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items())
    assert list(pdf_blocks(body)) == [
        ("paragraph", "Ada (L)\nLove ace", [], "p1-b0"), ("paragraph", "Far Été\nnext", [], "p1-b1"), ("paragraph", "Şabc", [], "p2-b0"), ("warning", "ocr:page 3", []),
    ]


def test_workbooks(monkeypatch):
    book = f"""<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Second" r:id="rId9"/><sheet name="Bare" r:id="rId7"/><sheet name="First" r:id="rId1"/></sheets></workbook>"""
    relation = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("rId1", "worksheets/sheet1.xml"), ("rId9", "/xl/worksheets/sheet2.xml"), ("rId7", "worksheets/sheet3.xml")))
    sheet = f'<worksheet {S}><sheetData><row><c r="A1"><v>{{}}</v></c><c r="B1"><v>x</v></c></row></sheetData></worksheet>'
    comments = f'<comments {S}><commentList><comment ref="B2"><text><r><t>see </t></r><r><t>Ada</t></r></text></comment><comment><text><t> </t></text></comment></commentList></comments>'
    body = package(**{
        "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": f"<Relationships>{relation}</Relationships>", "xl/worksheets/sheet1.xml": sheet.format(1), "xl/worksheets/sheet2.xml": sheet.format(2),
        "xl/worksheets/sheet3.xml": f"<worksheet {S}/>", "xl/comments1.xml": comments, "xl/threadedComments/comments2.xml": "<broken",
    })
    a, b = [(0, 0, "2"), (0, 1, "x")], [(0, 0, "1"), (0, 1, "x")]
    assert list(office.xlsx_blocks(body)) == [("heading", "Second", []), ("table", "", a), ("heading", "First", []), ("table", "", b), ("paragraph", "B2: see Ada", [])]
    monkeypatch.setattr(office, "MOST_CELLS", 3)
    assert list(office.xlsx_blocks(body))[2:] == [("heading", "First", []), ("table", "", b[:1]), ("paragraph", "B2: see Ada", []), ("warning", "truncated:workbook at 3 cells", [])]


def test_uploads(spark, tmp_path):
    files = {"a.docx": DOCX, "b.XLSX": XLSX, "sub/c.pdf": b"%PDF-1.4", "d.txt": b"x", "e.pdf": b"zz", "f.docx": b"PK\x03\x04junk", ".hidden.pdf": b"%PDF", "~$a.docx": b"PK", "h.docx": package(x="y"), "big.pdf": b"%PDF" + b"0" * 5000}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    checked = uploads.checked(uploads.read_uploads(spark, str(tmp_path)), most=4000)
    assert {r["name"]: r["error"] for r in checked.collect()} == {"a.docx": None, "b.XLSX": None, "c.pdf": None, "d.txt": "unsupported", "e.pdf": "invalid", "f.docx": "invalid", "h.docx": "invalid", "big.pdf": "too_large"}
    empty = table(spark, [("p", "g.pdf", 0, bytearray())], "path string, name string, length long, content binary")  # a file scan leaves empty files out
    assert uploads.checked(empty).first()["error"] == "empty"
    sound = checked.where("error is null").select(F.col("name").alias("path"), "kind", "content")
    rows = office.extract_blocks(sound).orderBy("path", "ord").collect()
    assert [(r["type"], r["text"]) for r in rows if r["path"] == "a.docx"] == [("heading", "Top"), ("paragraph", "One"), ("table", ""), ("paragraph", "Head")]
    sheet = [r for r in rows if r["path"] == "b.XLSX"]
    assert sheet[0]["text"] == "People" and [tuple(c) for c in sheet[1]["cells"]] == [(0, 0, "Ada"), (1, 27, "12.5")]
    assert [r for r in rows if r["path"] == "c.pdf"] == []  # a PDF without pages
    broken = spark.createDataFrame([("x.pdf", "pdf", bytearray(b"%PDF /Encrypt 3 0 R"))], "path string, kind string, content binary")
    assert [r["warning"] for r in office.extract_blocks(broken).collect()] == ["extract_failed:PdfError"]
    manifest = uploads.batch_manifest(table(spark, [("1/a.pdf", "a.pdf", None, "approved"), ("2/a.pdf", "a.pdf", None, "x"), ("3", "<b>.pdf", "too_large", None)], "path string, name string, error string, status string"))
    assert [tuple(r) for r in manifest.orderBy("path").collect()] == [("1/a.pdf", "OK", "a"), ("2/a.pdf", "NEEDS_REVIEW", "a_2"), ("3", "SKIPPED_TOO_LARGE", "b")]


def test_layers(spark, tmp_path):
    df = table(spark, [(1, "m")], "doc_id int, masked_text string")
    raw = df.withColumn("value", F.lit("secret"))
    layers.write_layer(df, str(tmp_path), "5_chat_context")
    layers.write_layer(raw, str(tmp_path), "2_extracted")
    layers.write_layer(raw, str(tmp_path), "1_original", mode="destructive")
    assert not (tmp_path / "1_original").exists()
    assert layers.read_shareable(spark, str(tmp_path), "5_chat_context").count() == 1
    for layer in ("3_anonymized", "4_validation", "5_chat_context"):
        with pytest.raises(layers.LayerError):
            layers.write_layer(raw, str(tmp_path), layer)
    with pytest.raises(layers.LayerError):
        layers.read_shareable(spark, str(tmp_path), "2_extracted")


def test_stream_of_documents(spark, tmp_path):
    schema = "doc_id long, text string"
    docs = table(spark, [(i, f"mail a{i}@x.org") for i in range(6)], schema)
    docs.where("doc_id < 4").write.parquet(f"{tmp_path}/in")
    work = lambda b: masking.masked_rows(b, R.PLAIN).select("doc_id", "masked_text")
    run = lambda: streaming.run_batches(streaming.arrivals(spark, f"{tmp_path}/in", docs.schema), f"{tmp_path}/out", f"{tmp_path}/state", work).awaitTermination()
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    docs.where("doc_id >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "masked_text").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(6)) and {r["masked_text"] for r in out} == {"mail <EMAIL_1>"}


# --- registration ---


def test_the_rest_works_without_the_llm_folder(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_nothing_outside_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "maskloom")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "maskloom.llm" not in open(os.path.join(folder, n)).read()


# --- reports and generators ---


def test_reports(spark):
    from maskloom.operators import report

    df = table(spark, [("residual_risk", 3, None, 0, 0), ("ocr:x", None, "S", 0, 27), ("blocked:y", None, None, 0, 0)], "c string, page int, sheet string, row int, col int")
    rows = df.select(report.reason_label(F.col("c")).alias("r"), report.location_label(F.col("page"), F.col("sheet"), F.col("row"), F.col("col")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("Personal data may be left", "page 3"), ("ocr:x", "S, AB1"), ("The document could not be read whole", "")]
    html = table(spark, [("a <EMAIL_1> & <b>\nc",)], "t string").select(report.export_html(F.col("t")).alias("h")).first()["h"]
    assert html == "<p>a <mark>EMAIL_1</mark> &amp; &lt;b&gt;</p><p>c</p>"
    prompt = report.system_prompt(table(spark, [("S10", "ten"), ("S2", "two")], "id string, text string")).first()["prompt"]
    assert prompt.endswith("[S2] two\n\n[S10] ten")
    assert report.raw_field_guard(["a", "value"], ["a"]) == (["value"], ["value"])
    edits = table(spark, [("d", 5, 9)], "doc_id string, masked_start int, masked_end int")
    picks = lambda a, b: report.target_spans(edits, table(spark, [("d", a, b)], "doc_id string, `from` int, `to` int")).count()
    assert [picks(8, 12), picks(9, 12), picks(3, 3), picks(-1, 20), picks(0, 900)] == [1, 0, 0, 0, 0]
    calls = table(spark, [(1.5, 10, True), (2.0, 20, True)], "seconds double, tokens long, ok boolean")
    assert report.model_evidence(calls).first()["plausible"] and not report.model_evidence(calls.limit(0)).first()["plausible"]
    left = report.not_done(table(spark, [(1,), (2,)], "k int"), table(spark, [(2,), (2,)], "k int"), "k")
    assert [r["k"] for r in left.collect()] == [1]


def test_generated_documents(spark):
    from maskloom.sources import synthetic

    docs, mentions = synthetic.gold_documents(spark, 12)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[m["doc_id"]][m["start"] : m["end"]] == m["surface"] for m in mentions.collect())
    assert {r["canary_id"] for r in synthetic.canaries(spark).collect()} == {c[0] for c in synthetic.CANARIES} | {"tckn"}
    found = {r["marker"]: r["n"] for r in synthetic.placements(spark).select("marker", F.size(detect.found_in(F.col("text"))).alias("n")).collect()}
    assert all(found[f"{c[0]}-contextual"] for c in synthetic.CANARIES if c[0] not in ("prs_en",))
    assert synthetic.stress_plan(spark).count() == 72
    again, _ = synthetic.gold_documents(spark, 12)
    assert {r["doc_id"]: r["text"] for r in again.collect()} == texts
