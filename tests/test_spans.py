import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.functions import checks, fold
from maskloom.functions.spans import covered, disjoint, merged, regex_spans, resolved, spliced

TEXT = st.text(alphabet="a1 é\U0001f642@.\n", max_size=30)
SLOW = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SPANS = "array<struct<tier:int,rank:double,size:int,start:int,end:int,name:string>>"


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {schema}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@given(st.lists(TEXT, min_size=1, max_size=20))
@settings(**SLOW)
def test_regex_spans(spark, texts):
    for pattern in (r"[0-9]+", r"a.", r"\S+@\S+"):
        got = values(spark, texts, "string", _finder(pattern))
        want = [[(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for t in texts]
        assert [[tuple(s) for s in g] for g in got] == want


def _finder(pattern):
    return lambda x: regex_spans(x, pattern)


def test_regex_spans_of_null(spark):
    assert values(spark, [None, ""], "string", _finder("a")) == [None, []]


def random_spans(seed, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        row = []
        for k in range(rng.randrange(7)):
            a = rng.randrange(20)
            b = a + rng.randrange(1, 9)
            row.append((rng.randrange(3), -rng.choice([0.4, 0.5, 1.0]), a - b, a, b, f"n{k}"))
        out.append(row)
    return out


def resolve_by_hand(spans):
    taken = []
    for x in sorted(spans):
        hit = [t for t in taken if t[3] < x[4] and x[3] < t[4]]
        inside = [t for t in hit if x[3] <= t[3] and t[4] <= x[4]]
        if not hit:
            taken.append(x)
        elif inside:
            low, high = min([x[3], *[t[3] for t in hit]]), max([x[4], *[t[4] for t in hit]])
            first = min(inside)
            taken = [t for t in taken if t not in hit] + [(*first[:3], low, high, first[5])]
    return sorted(taken, key=lambda t: t[3])


def test_resolution_against_plain_python(spark):
    rows = random_spans(1)
    got = [[tuple(s) for s in r] for r in values(spark, rows, SPANS, resolved)]
    assert got == [resolve_by_hand(r) for r in rows]


def test_resolution_is_disjoint_and_covers_what_wins(spark):
    rows = random_spans(2)
    for given_spans, kept in zip(rows, values(spark, rows, SPANS, resolved)):
        for a, b in zip(kept, kept[1:]):
            assert a["end"] <= b["start"]
        if given_spans:
            top = min(given_spans)
            assert any(s["start"] <= top[3] and top[4] <= s["end"] for s in kept)


def test_more_detections_never_uncover(spark):
    rng = random.Random(5)
    small = [r for r in random_spans(3) if r]
    large = [r + [(2, -0.4, a - b, a, b, "z")] for r in small for a in [rng.randrange(20)] for b in [a + rng.randrange(1, 12)]]
    chars = lambda kept: {i for s in kept for i in range(s["start"], s["end"])}
    for a, b in zip(values(spark, small, SPANS, resolved), values(spark, large, SPANS, resolved)):
        assert chars(a) <= chars(b)


def test_islands_and_cover(spark):
    rows = random_spans(4)
    for given_spans, islands, n in zip(rows, values(spark, rows, SPANS, merged), values(spark, rows, SPANS, covered)):
        chars = {i for s in given_spans for i in range(s[3], s[4])}
        assert n == len(chars) == sum(s["end"] - s["start"] for s in islands)
        for a, b in zip(islands, islands[1:]):
            assert a["end"] <= b["start"]


def test_island_takes_the_longest_member(spark):
    rows = [[(0, 0.0, 0, 0, 4, "short"), (0, 0.0, 0, 3, 12, "long"), (0, 0.0, 0, 12, 13, "apart")]]
    (out,) = values(spark, rows, SPANS, merged)
    assert [(s["start"], s["end"], s["name"]) for s in out] == [(0, 12, "long"), (12, 13, "apart")]


def test_greedy_left_to_right(spark):
    rows = [[(0, 0.0, 0, 2, 6, "b"), (0, 0.0, 0, 0, 3, "a"), (0, 0.0, 0, 0, 5, "c"), (0, 0.0, 0, 5, 7, "d")]]
    (out,) = values(spark, rows, SPANS, disjoint)
    assert [s["name"] for s in out] == ["c", "d"]


def test_splice(spark):
    df = spark.createDataFrame([("aé\U0001f642bc", [(1, 3, "<X_1>"), (4, 5, "")]), ("abc", [])], "t string, e array<struct<start:int,end:int,token:string>>")
    assert [r["y"] for r in df.select(spliced(F.col("t"), F.col("e")).alias("y")).collect()] == ["a<X_1>b", "abc"]


def test_checksums(spark):
    good = {"10000000146": True, "10000000147": False, "01234567890": False, "1": False, "": False}
    assert values(spark, list(good), "string", checks.tckn_valid) == list(good.values())
    ibans = {"TR330006100519786457841326": True, "TR33 0006 1005 1978 6457 8413 26": True, "GB82WEST12345698765432": True, "GB82WEST12345698765433": False, "TR00": False}
    assert values(spark, list(ibans), "string", checks.iban_valid) == list(ibans.values())
    cards = {"4111 1111 1111 1111": True, "4111111111111112": False, "4111-1111-1111-1111": True, "411111": False}
    assert values(spark, list(cards), "string", checks.card_valid) == list(cards.values())
    assert values(spark, [None], "string", checks.tckn_valid) == [False]


def test_completed_numbers_are_valid(spark):
    df = spark.range(100).select(F.format_string("%09d", F.col("id") * 9_876_543 % 899_999_999 + 100_000_000).alias("d"))
    out = df.select(checks.tckn_valid(checks.tckn_complete(F.col("d"))).alias("a"), checks.card_valid(checks.luhn_complete(F.concat(F.lit("453211"), "d"))).alias("b"), checks.iban_valid(checks.iban_complete(F.lit("DE"), F.concat("d", "d"))).alias("c"))
    assert all(r["a"] and r["b"] and r["c"] for r in out.collect())


def test_projections_against_plain_python():
    import random
    import unicodedata

    def by_hand(text):
        out = [(c, i) for i, ch in enumerate(text) for c in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(c) and not c.isspace()]
        return "".join("i" if c == "ı" else c for c, _ in out), [i for _, i in out]

    rng = random.Random(2)
    texts = ["", "İI ıi ŞÇ", "ﬁ ß \U0001f642 é", " \t\n", "가각 ①"] + ["".join(rng.choice("aİışß é\u0301ﬃ\U0001f600 \n") for _ in range(rng.randrange(30))) for _ in range(50)]
    proj, at = fold.projections(texts)
    assert [(p, a.tolist()) for p, a in zip(proj, at)] == [by_hand(t) for t in texts]
    assert fold.projections([]) == ([], [])


def test_folding(spark):
    assert values(spark, ["  İSTANBUL ", "ıssız\tİ", "ﬁn", None], "string", fold.term_key) == ["istanbul", "issiz i", "fin", None]
    (p, q) = values(spark, ["Şe kİ", ""], "string", fold.projected)
    assert (p["proj"], p["at"], q["proj"]) == ("seki", [0, 1, 3, 4], "")
    assert values(spark, ["Şirket_X 2ı", ""], "string", fold.search_tokens) == [["sirket", "x", "2i"], []]
