import random
import zlib

import pytest
from brute import top_k
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.llm import shards, topk, urls

# --- exact top-k ---


def check_top_k(spark, vectors, queries, k=5, **kw):
    schema = "id long, vec array<long>, score string, rank int"
    v = spark.createDataFrame([(i, x, "a", 0) for i, x in vectors], schema)
    q = spark.createDataFrame([(i, x, "a", 0) for i, x in queries], schema)
    out = topk.top_k(v, q, k, **kw)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = {i: x for i, x in queries if i is not None and x is not None}
    want = top_k([(i, x) for i, x in vectors if i is not None and x is not None], list(asked.items()), k)
    assert got == {q: w for q, w in want.items() if w}


def made(seed, n, d, low=-120, high=120, lengths=False):
    rng = random.Random(seed)
    scale = [1 + 20 * rng.random() ** 6 for _ in range(n)]
    return [(i, [int(rng.randrange(low, high) * (scale[i] if lengths else 1)) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("lengths", [False, True])
def test_top_k_against_brute_force(spark, lengths):
    v = made(1, 700, 24, lengths=lengths)
    check_top_k(spark, v, v[::50], head=6, seed_rows=40, query_rows=5, block_rows=64)


def test_top_k_with_ties_copies_and_zeros(spark):
    v = made(2, 60, 4, -2, 3) + [(100 + i, [1, 1, 1, 1]) for i in range(80)] + [(300, [0, 0, 0, 0])]
    check_top_k(spark, v, v[::20] + [v[20], (301, [0, 0, 0, 0])], head=1, seed_rows=8, query_rows=2, block_rows=16)


def test_top_k_of_few_rows_nulls_and_short_vectors(spark):
    v = [(1, [3, 4]), (2, [1]), (3, []), (None, [9, 9]), (4, None)]
    check_top_k(spark, v, v[:3])
    check_top_k(spark, v[:1], v[:1])


def test_top_k_of_large_components(spark):
    v = made(3, 50, 6, -(2**29), 2**29)
    check_top_k(spark, v, v[:5], head=2, seed_rows=4, block_rows=8)


def test_top_k_of_repeated_ids(spark):
    rng = random.Random(6)
    v = [(i % 7, [rng.randrange(-9, 9) for _ in range(5)]) for i in range(40)]
    rows = [(i, x) for i, x in v]
    schema = "id long, vec array<long>"
    df = spark.createDataFrame(rows, schema)
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_k(df, df.where("id = 3"), 4).collect()}
    scores = sorted((sum(a * b for a, b in zip(x, y)) for q, x in {(q, tuple(x)) for q, x in rows if q == 3} for i, y in rows if i != 3), reverse=True)
    assert [got[3, r] for r in range(1, 5)] == scores[:4]
    assert topk.top_k(df.union(df.limit(2)), df.where("id = 2"), 3).count() == 3


def test_blocks_out_of_reach_do_not_matter(spark):
    """Long vectors first: short ones cannot reach the floor, and ties at the floor still count."""
    v = [(i, [100, i % 3]) for i in range(30)] + [(100 + i, [1, 1]) for i in range(200)] + [(500, [100, 0]), (501, [0, 0])]
    check_top_k(spark, v, [(900, [1, 0]), (901, [-1, 0]), (902, [0, 0]), v[0]], head=1, seed_rows=12, query_rows=1, block_rows=16)


def test_top_k_of_nothing(spark):
    check_top_k(spark, [], [])
    check_top_k(spark, made(1, 5, 3), [])
    check_top_k(spark, [], made(1, 5, 3))


def test_which_vectors_take_part(spark):
    rows = [(1, [0.5, -0.001]), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: r["s"] for r in df.where(topk.finite(F.col("v"))).select("id", topk.scaled(F.col("v")).alias("s")).collect()}
    assert got == {1: [128, -1], 6: []}


# --- shards ---


def check_shards(make_docs, texts, n):
    out = shards.shard_by_bytes(make_docs(texts, extra=True), n).collect()
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    sized = sorted(((-1 if i is None else i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, before, want = sum(s for _, s, _ in sized), 0, []
    slots = {}
    for i, s, c in sized:
        shard = min(n - 1, (2 * before + s) * n // (2 * total))
        want.append((i, s, c, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += s
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out) == sorted(want)
    assert {(r["law"], r["grown_shard"]) for r in out} <= {("bytes", None)}
    return out


def test_shards_against_brute_force(make_docs, corpus):
    out = check_shards(make_docs, corpus, 4)
    sums = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in out)


def test_shards_with_null_and_repeated_ids(make_docs):
    check_shards(make_docs, [(None, "a"), (3, "bb"), (3, "bb"), (3, "a"), (1, None), (2, "é" * 50)], 3)


def test_more_shards_than_documents_and_nothing(make_docs):
    check_shards(make_docs, ["a", "b"], 16)
    check_shards(make_docs, [], 16)
    with pytest.raises(ValueError):
        shards.shard_by_bytes(make_docs(["a"]), 0)


# --- url rules ---


def judged(url, rules=urls.RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
        path = tail[:end]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, default))
    return host, path, rule, verdict


def check_urls(spark, all_urls, rules=urls.RULES):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(all_urls)], "page_id long, url string, host string, keys string")
    got = [tuple(r)[1:] for r in urls.judge_urls(df, rules).orderBy("page_id").collect()]
    assert got == [judged(u, rules) for u in all_urls]


URLS = [
    None, "", "no scheme", "http://", "https://a.com", "https://a.com/", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "http://m.www.example.com/en/x",
    "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/1", "http://net/fr/", "http://x.net/de/", "a://b://c.com/", "http://x.org/en/", "http://example.com?/en/",
    "http://.com/", "http://com./", "http://İ.com/x", "http://example.com#/en/", "http://a.b.c.d.e.f.example.com/en/z", "http://x.net:80/es/",
]


def test_urls_against_brute_force(spark):
    check_urls(spark, URLS)
    check_urls(spark, [])
    check_urls(spark, URLS, [])
    check_urls(spark, URLS, [("example.com", "", "block"), ("com", "/", "allow"), ("x.net", "/es", "block")])


def test_null_and_repeated_page_ids(spark):
    df = spark.createDataFrame([(None, "http://x.net/es/1"), (3, "http://x.com/"), (3, "http://x.com/"), (None, None)], "page_id long, url string")
    assert sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect() if r["rule"]) == [("3", "com/", "allow"), ("3", "com/", "allow"), ("None", "net/es/", "block")]
    assert urls.judge_urls(df).count() == 4


def test_many_rules(spark):
    rules = [(f"h{i}.org", f"/p{i % 7}/", "block" if i % 3 else "allow") for i in range(3000)]
    found = [f"http://www.h{i}.org/p{i % 7 if i % 2 else 9}/x" for i in range(0, 4000, 3)]
    check_urls(spark, found, rules)


@given(st.lists(st.text(alphabet="ac.:/en?#xX", max_size=20).map(lambda s: "http://" + s), max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_urls(spark, found):
    rules = [("a", "/", "allow"), ("c.a", "/e", "block"), ("x", "/en", "allow"), ("c", "/", "block")]
    check_urls(spark, found, rules)


def test_a_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(0, 6000).selectExpr("concat('k', id) as key")
    listed = [f"k{i}" for i in range(0, 6000, 37)] + ["outside"]
    cascade = urls.build_cascade(universe, listed)
    wrong = universe.withColumn("has", cascade.holds(F.col("key"))).withColumn("should", F.col("key").isin(listed)).where("has <> should")
    assert len(cascade.levels) > 1 and wrong.count() == 0
    assert spark.createDataFrame([("outside",)], "key string").where(cascade.holds(F.col("key"))).count() == 1


def test_rules_that_contradict(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    with pytest.raises(ValueError):
        urls.judge_urls(df, [("com", "/", "allow"), ("com", "/", "block")])
