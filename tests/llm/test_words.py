import re

import numpy as np
import pyarrow as pa
from brute import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.llm import sketch
from maskloom.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé日\U0001f642 \t\n\x0b\x0c\r. ", max_size=40)), max_size=12)


def split(texts, lower=False):
    return W.split(*W.text_bytes(pa.array(texts, pa.string())), lower)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_joined(texts):
    w = split(texts, lower=True)
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [words_of(t, lower=True) for t in texts]
    keep = np.arange(len(w.starts)) % 3 != 1
    flat = [x for g in got for x in g]
    text = W.string_array(*W.joined(w, keep)).to_pylist()
    want = [" ".join(flat[n] for n in range(i, j) if keep[n]) for i, j in zip(w.first[:-1], w.first[1:])]
    assert text == want


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_equal_shingles_and_windows_have_equal_hashes(texts):
    w = split(texts)
    h = w.hashes()
    lists = [words_of(t) for t in texts]
    for k in (2, 4):
        s, first = W.shingles(h, w.first, k)
        seen, back = {}, {}
        for d, ws in enumerate(lists):
            grams = [tuple(ws)] if 0 < len(ws) < k else [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
            assert len(grams) == first[d + 1] - first[d]
            for g, x in zip(grams, s[first[d] : first[d + 1]]):
                assert seen.setdefault(g, x) == x and back.setdefault(x, g) == g
        at, a, b = W.windows(h, w.first, k)
        flat = [(x, d) for d, ws in enumerate(lists) for x in ws]
        seen = {}
        for i, x, y in zip(at, a, b):
            assert len({d for _, d in flat[i : i + k]}) == 1
            assert seen.setdefault(tuple(t for t, _ in flat[i : i + k]), (x, y)) == (x, y)
        assert len(at) == sum(max(0, len(ws) - k + 1) for ws in lists)


def test_pieces_cover_all_rows():
    batch = pa.record_batch([pa.array(["abc" * n if n else None for n in range(50)]), pa.array(range(50))], ["text", "id"])
    got = [(i, bytes(d[a:b]).decode()) for rows, d, at in W.pieces(batch.slice(3), size=64) for i, a, b in zip(rows.column("id").to_pylist(), at[:-1], at[1:])]
    assert got == [(n, "abc" * n) for n in range(3, 50)]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 500, dtype=np.uint64)
    for k in (1, 7, 43, 500, 501):
        assert W.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


def test_sketches_add_up_in_any_tree(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FAN_IN", 2)
    df = spark.range(0, 5000, 1, 9).selectExpr("id % 97 as k")
    cells = 1 << 8

    def fill(table, batch):
        sketch.add(table, sketch.slots(batch.column(0).to_numpy().astype(np.uint64), cells))

    got = sketch.merged(df.mapInArrow(sketch.counted(cells, fill), sketch.SCHEMA), cells)
    want = np.zeros(cells, np.int64)
    np.add.at(want, sketch.slots(np.arange(5000, dtype=np.uint64) % 97, cells), 1)
    assert got.tolist() == np.minimum(want, 255).tolist()


def test_bitmap_has_every_key(spark):
    bits = sketch.bitmap(spark.range(-50, 50), "id", 100)
    assert sketch.flagged(bits.value, pa.array(range(-50, 50))).all()
    assert sketch.flagged(bits.value, pa.array(range(10**6, 10**6 + 1000))).mean() < 0.3


def test_separators_are_those_of_the_contract():
    text = "".join(map(chr, range(1, 0x3000)))
    w = split([text])
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == re.findall(r"[^\x20\x09-\x0D]+", text)
