import random

import corpus_pipeline as cp
from brute import components, leaks, repeats
from conftest import words

from maskloom.llm import pieces, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("grumpf" in (t or ""))) for i, t in texts]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def sample():
    rng = random.Random(11)
    texts = [" ".join(words(rng, 120, 3000)) for _ in range(60)]
    passage = " ".join(words(rng, 60, 3000))
    for k in range(12):
        texts[k] += " . grumpf " + " ".join(words(rng, 5, 3000))
    for k in range(20, 26):
        texts.append(texts[k])
        texts.append(texts[k].replace(" ", "  ", 3) + " tail")
    for k in range(30, 36):
        texts[k] = texts[k] + " " + passage
    for k in range(40, 44):
        texts[k] += " alpha beta gamma delta epsilon zeta eta theta iota kappa"
    return list(enumerate([*texts, "", None, "short one"]))


def test_stages_against_brute_force(spark, tmp_path):
    texts = sample()
    sf, items = folder(spark, tmp_path, texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(cp.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    assert rows == sorted((i, t) for i, t in texts if "grumpf" not in (t or "")) and clean.columns == docs.columns
    one = stages["near_duplicates"](spark, clean, sf)
    keep = {i for i, _, c in components(rows, 5, 80, 100) if c == i}
    assert {r["doc_id"] for r in one.collect()} == keep and one.columns == docs.columns
    rows = [(i, t) for i, t in rows if i in keep]
    cut = stages["substring_dedup"](spark, one, sf)
    got = sorted((r["doc_id"], r["text"], r["n_chars"], r["lang"]) for r in cut.collect())
    assert got == sorted((i, k, len(k), "en") for i, _, _, k in repeats(rows, 50)) and cut.schema == docs.schema
    rows = [(i, t) for i, t, _, _ in got]
    safe = stages["decontamination"](spark, cut, sf)
    bad = {d for d, _ in leaks(rows, items, 5, 80, 100)}
    assert bad and {r["doc_id"] for r in safe.collect()} == {i for i, _ in rows} - bad and safe.columns == docs.columns
    out = stages["sentencepiece"](spark, safe, sf)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(out).collect()}
    assert back == {i: t for i, t in rows if i not in bad}
    whole = {r["doc_id"]: r["pieces"] for r in cp.run(spark, sf).collect()}
    assert whole == {r["doc_id"]: r["pieces"] for r in out.collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    sf, _ = folder(spark, tmp_path, [])
    assert cp.run(spark, sf).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
