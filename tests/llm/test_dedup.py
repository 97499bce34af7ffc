import random

import numpy as np
import pytest
from brute import components, leaks, repeats, shingles
from conftest import words

from maskloom.llm import copies, decontaminate, jaccard, substring
from maskloom.llm.components import components as closed
from maskloom.llm.sketch import SCHEMA, listed, repeated_bits
from maskloom.llm.store import prepare


def rows_of(texts):
    return [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]


def check_components(make_docs, texts, k=4, num=85, den=100, **kw):
    out = jaccard.near_duplicates(make_docs(texts, extra=True), shingle=k, num=num, den=den, **kw)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == sorted(components(rows_of(texts), k, num, den))


def test_join_against_brute_force(make_docs, corpus):
    check_components(make_docs, corpus)


def test_join_by_five_words_and_four_fifths(make_docs, corpus):
    check_components(make_docs, corpus, 5, 80, 100)


@pytest.mark.parametrize("threshold", [50, 70, 95, 100])
def test_join_at_other_thresholds(make_docs, corpus, threshold):
    check_components(make_docs, corpus, 3, threshold, 100)


def near_copies(seed, groups, each, edits, size=(20, 120)):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randrange(*size), 60)
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_large_groups_with_frequent_shingles(make_docs, seed, monkeypatch):
    # a low cut makes most shingles frequent, so pairs of them are what is indexed
    real = jaccard.Prefixes.__init__
    monkeypatch.setattr(jaccard.Prefixes, "__init__", lambda self, num, den, cut: real(self, num, den, 3))
    check_components(make_docs, near_copies(seed, 4, 25, 3))


def test_join_when_the_sketch_is_full(make_docs):
    check_components(make_docs, near_copies(3, 5, 8, 3), most_cells=1 << 4)


def test_join_without_hub_rounds_and_with_many(make_docs):
    texts = near_copies(4, 4, 10, 4)
    for rounds in (0, 3):
        check_components(make_docs, texts, hub_rounds=rounds)


def linked(rows, k, num, den):
    """[(doc_id, n_shingles, component_id, n_links)] by brute force."""
    sets = [shingles(t, k) for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)
    n_links = [sum(near(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    return [(*c, n) for c, n in zip(components(rows, k, num, den), n_links, strict=True)]


def test_join_counts_every_link(make_docs, corpus):
    near = near_copies(6, 3, 12, 5)
    chain = [" ".join(f"c{i}" if i % 12 or i >= 12 * j else f"d{i}" for i in range(100)) for j in range(5)]
    texts = corpus + near + near[:5] + near[:2] + chain
    out = jaccard.near_duplicates(make_docs(texts, extra=True), 4, 85, 100, count_links=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    expected = linked(rows_of(texts), 4, 85, 100)
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    sizes = {c: sum(r[2] == c for r in expected) for _, _, c, _ in expected}
    assert any(0 < n < sizes[c] - 1 for _, _, c, n in expected)  # some members of a component do not link


@pytest.mark.parametrize("texts,shingles", [(4, 1 << 16), (256, 400)])
def test_links_of_components_in_blocks(make_docs, monkeypatch, texts, shingles):
    monkeypatch.setattr(jaccard, "TEXTS", texts)
    monkeypatch.setattr(jaccard, "SHINGLES", shingles)
    near = near_copies(8, 3, 14, 6)
    rows = rows_of(near + near[:6] + ["a b c d e f"])
    out = jaccard.near_duplicates(make_docs(rows), 4, 85, 100, count_links=True)
    assert sorted(map(tuple, out.collect())) == sorted(linked(rows, 4, 85, 100))


def test_links_of_null_and_repeated_ids(make_docs):
    out = jaccard.near_duplicates(make_docs([(1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (4, "")]), 4, 85, 100, count_links=True).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 2, 1, 1), (2, 2, 1, 1), (None, 2, None, None), (4, 0, 4, 0)], key=str)
    x, y = (" ".join(words(random.Random(i), 80)) for i in (1, 2))
    rows = [(3, x), (5, x), (5, y), (7, y + " more"), (5, y), (9, x + " more"), (8, "a b"), (8, "c d")]
    out = jaccard.near_duplicates(make_docs(rows), 4, 85, 100, count_links=True).collect()
    assert sorted(map(tuple, out)) == sorted(linked(rows, 4, 85, 100))


def test_join_of_very_long_texts(make_docs):
    w = words(random.Random(4), 30000, 3000)
    near = list(w)
    near[::400] = ["changed"] * len(near[::400])
    rows = rows_of([" ".join(w), " ".join(near), " ".join(w[:20000]), "x" * 300000, "x" * 300000 + " y"])
    out = jaccard.near_duplicates(make_docs(rows), 4, 85, 100, count_links=True).collect()
    assert sorted(map(tuple, out)) == sorted(linked(rows, 4, 85, 100))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    p = jaccard.Prefixes(85, 100, 10)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        pool = rng.integers(0, 2**63, n + 60, dtype=np.uint64)
        estimate = {h: int(e) for h, e in zip(pool, rng.choice([1, 5, 50, 200], len(pool)))}
        a = list(pool[:n])
        b = list(a)
        for _ in range(int(rng.integers(0, max(1, n // 8) + 1))):
            b[int(rng.integers(len(b)))] = pool[n + int(rng.integers(60))]
        b = list(dict.fromkeys(b))
        if 100 * len(set(a) & set(b)) < 85 * len(set(a) | set(b)):
            continue
        h = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
        keys, doc, room = p.sign(h, np.array([0, len(a), len(a) + len(b)]), np.array([estimate[x] for x in h], np.uint16))
        shared = set(keys[doc == 0]) & set(keys[doc == 1])
        need = -(-85 * (len(a) + len(b)) // 185)
        assert any(min(room[(doc == 0) & (keys == s)].max(), room[(doc == 1) & (keys == s)].max()) >= need for s in shared)


def test_join_of_nothing(make_docs):
    check_components(make_docs, [])
    check_components(make_docs, [None, "", "  "])


def test_join_with_null_and_repeated_ids(make_docs):
    t = " ".join(words(random.Random(1), 50))
    out = jaccard.near_duplicates(make_docs([(5, t), (5, "a b c d e"), (5, t), (7, "a b c d e"), (None, t)]), 4, 85, 100).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(5, 47, 5), (5, 2, 5), (5, 47, 5), (7, 2, 5), (None, 47, None)], key=str)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (61, 60)], "a long, b long")
    out = {r["id"]: r["label"] for r in closed(links).collect()}
    assert out == {**{i: 0 for i in range(62)}, 100: 100, 101: 100}


def check_repeats(make_docs, texts, window=50, **kw):
    out = substring.remove_repeats(make_docs(texts, extra=True), window=window, **kw)
    assert sorted(map(tuple, out.collect())) == sorted(repeats(rows_of(texts), window))


def test_repeats_against_brute_force(make_docs, corpus):
    check_repeats(make_docs, corpus)


@pytest.mark.parametrize("window,gram", [(9, 8), (12, 3)])
def test_repeats_of_other_lengths(make_docs, corpus, window, gram):
    check_repeats(make_docs, corpus, window, gram=gram)


def test_repeats_with_a_full_sketch(make_docs, corpus):
    check_repeats(make_docs, corpus, most_cells=1 << 3)


@pytest.mark.parametrize("cells", [16, 1 << 13])
def test_bits_of_every_cell_that_repeats(spark, cells):
    prepare(spark)
    every = spark.range(0, 4, 1, 2).mapInArrow(listed(cells, lambda batch: iter([np.arange(cells)])), SCHEMA)
    assert np.unpackbits(repeated_bits(every, cells), bitorder="little").sum() == cells


def test_repeats_inside_one_document_stay(make_docs):
    check_repeats(make_docs, ["q " * 300, "r " * 10])


def test_a_window_that_the_smaller_document_has_at_its_edges(make_docs):
    w = words(random.Random(3), 140, 10**6)
    check_repeats(make_docs, [" ".join(w[:50]), " ".join(w), " ".join(w[90:]), " ".join(w[49:99])])
    check_repeats(make_docs, [(9, " ".join(w)), (3, " ".join(w[20:110])), (5, " ".join(w))])


def test_repeats_carry_other_columns(make_docs, corpus):
    docs = make_docs(corpus)
    out = {r["doc_id"]: r for r in substring.remove_repeats(docs, carry=True).collect()}
    assert all(r["rest"]["lang"] == "en" for r in out.values()) and len(out) == len(corpus)


def test_repeats_of_very_long_texts_and_repeated_ids(make_docs):
    w = words(random.Random(9), 40000, 10**6)
    rows = [(4, " ".join(w)), (2, " ".join(w[30000:30070])), (6, " ".join(w[100:20000])), (6, " ".join(w[100:20000])), (6, " ".join(w[50:400])), (2, " ".join(w[30000:30070])), (7, "y" * 200000)]
    check_repeats(make_docs, rows)


def test_repeats_of_nothing_and_null_ids(make_docs):
    check_repeats(make_docs, [])
    t = " ".join(words(random.Random(2), 60))
    out = substring.remove_repeats(make_docs([(1, t), (None, t), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in out) == [(-1, 0, 0), (-1, 60, 0), (1, 60, 0)]


def check_leaks(spark, make_docs, texts, items, **kw):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = decontaminate.find_leaks(make_docs(texts, extra=True), bench, **kw)
    found = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in out.collect()}
    assert found == leaks(rows_of(texts), items, 5, 80, 100)
    return found


def planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 10**5))) for i, n in enumerate([1, 3, 5, 6, 12, 30, 60, 61, 200])]
    texts = []
    for i, t in items:
        w = t.split()
        hurt = list(w)
        hurt[len(hurt) // 2] = "other"
        for body in (w, hurt, [x.upper() for x in w], w[: len(w) // 2]):
            texts.append(" ".join(words(rng, 300, 10**5) + body + words(rng, 2000 if i == 4 else 200, 10**5)))
    return texts + ["", None, "x"], items + [(90, None), (91, ""), (92, items[5][1]), (5, "again " + items[5][1])]


def test_leaks_against_brute_force(spark, make_docs):
    texts, items = planted(1)
    assert len(check_leaks(spark, make_docs, texts, items)) > 15


def test_leaks_of_a_document_that_holds_many_items(spark, make_docs):
    _, items = planted(2)
    whole = " ".join(t or "" for _, t in items)
    check_leaks(spark, make_docs, [whole, "clean text of no item at all"], items)
    check_leaks(spark, make_docs, [whole], items, most_hashes=4)  # all shingles are looked up instead


def test_leaks_in_very_long_texts_and_repeated_rows(spark, make_docs):
    _, items = planted(3)
    w = words(random.Random(5), 60000, 10**5)
    w[41000:41000] = items[6][1].split()
    rows = [(1, " ".join(w)), (1, " ".join(w)), (1, "short"), (2, "z" * 200000 + " " + items[4][1]), (None, items[4][1])]
    bench = items + [(None, items[3][1]), items[6], items[6]]
    found = check_leaks(spark, make_docs, rows[:4], [x for x in bench if x[0] is not None])
    assert (1, 6) in found and (2, 4) in found


def test_leaks_of_nothing(spark, make_docs):
    check_leaks(spark, make_docs, [], [(1, "a b c d e f")])
    check_leaks(spark, make_docs, ["a b c d e f"], [])


def test_enough_hashes():
    for u, q in ((7, 4), (63, 32), (4095, 64)):
        least = 0.8 / (0.2 + u / q)
        assert (1 - least) ** decontaminate.hashes_needed(u, q, 0.8, 1e-9) <= 1.0001e-9


def test_without_keeps_all_else(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, None)], extra=True)
    bad = spark.createDataFrame([(2,), (9,)], "doc_id long")
    out = decontaminate.without(docs, bad)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"]) == [(0, "d"), (1, "a")]
    clash = docs.withColumn("__maskloom_steer", docs.text)
    again = decontaminate.without(clash, bad)
    assert again.columns == clash.columns and sorted(r["__maskloom_steer"] for r in again.collect() if r["text"]) == ["a", "d"]


def test_distinct_texts(spark, make_docs):
    docs = make_docs([(4, "a"), (2, "a"), (3, "b"), (2, "a"), (1, None), (5, "")]).selectExpr("doc_id as id", "text")
    d = copies.Distinct(docs)
    kept = d.map(lambda it: it, "id long, text string, key long").collect()
    assert sorted((r["id"], r["text"]) for r in kept) == [(1, ""), (2, "a"), (2, "a"), (3, "b")]
    assert sorted((r["id"], r["first_id"]) for r in d.later().collect()) == [(4, 2), (5, 1)]
