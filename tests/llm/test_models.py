import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.llm import langid, lm, pieces, toxicity
from maskloom.llm import words as W
from maskloom.llm.automaton import marginals

VOCAB = pieces.read_vocabulary()
ODD = ["Hello  world \n x\ty  ", "", "  a", "日本語 𓀀 ▁x▁ y", "été où", "\n", "a\r\n\x0b", "x" * 300, " ", "<0x41> </s> <unk>", "\u0000z", "ab" * 2000]


def encode(texts, vocab=VOCAB):
    ids, at = pieces.Encoder(vocab).encode(*W.text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


def decode(lists, vocab=VOCAB):
    at = np.cumsum([0, *map(len, lists)])
    data, to = pieces.decode(vocab, np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), at)
    return [bytes(data[a:b]).decode() for a, b in zip(to[:-1], to[1:])]


def best_by_hand(vocab, text):
    """Plain Viterbi over the whole text, all starts in turn."""
    if not text:
        return []
    table = {b: i for i, b in enumerate(vocab.body) if vocab.normal[i]}
    data = b" " + text.encode()
    best, back = [0.0] + [-math.inf] * len(data), [None] * (len(data) + 1)
    longest = max(map(len, table))
    for s in range(len(data)):
        if best[s] == -math.inf:
            continue
        size = next(n for n in (1, 2, 3, 4) if s + n == len(data) or (data[s + n] & 0xC0) != 0x80)
        single = False
        for e in range(s + 1, min(len(data), s + longest) + 1):
            i = table.get(data[s:e])
            if i is not None:
                single |= e - s == size
                if best[s] + vocab.score[i] > best[e]:
                    best[e], back[e] = best[s] + vocab.score[i], (s, [i])
        if not single and best[s] + vocab.unknown > best[s + size]:
            best[s + size], back[s + size] = best[s] + vocab.unknown, (s, [int(vocab.bytes_at[b]) for b in data[s : s + size]])
    out, e = [], len(data)
    while e:
        s, ids = back[e]
        out, e = ids + out, s
    return out


def score(vocab, ids):
    return sum(vocab.score[i] for i in ids)


def test_pieces_against_plain_viterbi():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("the anding of ñ\né,7") for _ in range(rng.randrange(60))) for _ in range(60)]
    for text, got in zip(texts, encode(texts)):
        want = best_by_hand(VOCAB, text)
        assert list(got) == want or score(VOCAB, got) == score(VOCAB, want), text


def test_long_unbroken_runs(monkeypatch):
    """Walked byte by byte they give what they give in step, and a run of a megabyte takes seconds."""
    from time import perf_counter

    from maskloom.llm import automaton

    rng = random.Random(5)
    runs = ["".join(rng.choice("etaoinshrdlu") for _ in range(3000)), "é日" * 700, "=" * 1500, "".join(map(chr, range(33, 1200)))]
    alone = encode(runs)
    weight, byte_weight = lm.piece_weights(VOCAB, "ranks")
    data = "".join(" " + r for r in runs).encode()
    sizes = np.array([len(r.encode()) + 1 for r in runs])
    sums = lambda: marginals(VOCAB.automaton, weight, byte_weight, np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes)
    one = sums()
    monkeypatch.setattr(automaton, "LONG", 1 << 30)
    VOCAB._memory = None
    assert [list(x) for x in encode(runs)] == [list(x) for x in alone] == [best_by_hand(VOCAB, r) for r in runs]
    assert one == pytest.approx(sums())
    monkeypatch.undo()
    VOCAB._memory = None
    began = perf_counter()
    whole = "".join(rng.choices("etaoinshrdlu", k=1 << 20))
    assert decode(encode([whole])) == [whole]
    assert perf_counter() - began < 60


def test_what_is_remembered_changes_nothing(monkeypatch):
    from maskloom.llm import automaton

    texts = ["the other and the", "other ñ x", "", "the"] * 3
    VOCAB._memory = None
    first = [list(x) for x in encode(texts)]
    monkeypatch.setattr(automaton, "REMEMBERED", 2)
    assert [list(x) for t in texts for x in encode([t])] == first


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_round_trip(texts):
    assert decode(encode(texts)) == texts


def test_pieces_against_the_library(tmp_path):
    """The library's own lattice (its best of several) on the same pieces and scores, on words that need no far-end piece."""
    import sentencepiece

    raw = bytearray(open(pieces.MODEL, "rb").read())

    def fields(a, b):
        def number(i):
            n = shift = 0
            while True:
                n |= (raw[i] & 127) << shift
                shift, i = shift + 7, i + 1
                if raw[i - 1] < 128:
                    return n, i

        while a < b:
            key, i = number(a)
            if key & 7 == 2:
                n, i = number(i)
                yield key >> 3, i, i + n
                a = i + n
            else:
                a = number(i)[1] if key & 7 == 0 else i + (4 if key & 7 == 5 else 8)
                yield key >> 3, i, a

    trainer = next((a, b) for f, a, b in fields(0, len(raw)) if f == 2)
    at = next(a for f, a, _ in fields(*trainer) if f == 3)
    assert raw[at] == 2
    raw[at] = 1  # the model type: unigram, so that it looks for the best path
    library = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the", "ing", "er", "on", "at", "s", "re"]) for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    mine = encode(texts)
    checked = 0
    for text, got in zip(texts, mine):
        want = library.nbest_encode_as_ids(text, 3)[0]
        if min(VOCAB.score[want]) > -1e6:
            checked += 1
            assert score(VOCAB, got) >= score(VOCAB, want) - 1e-3 and (list(got) == want or score(VOCAB, got) == score(VOCAB, want))
    assert checked > 400


def test_encoding_query(spark, make_docs):
    texts = [*ODD, None]
    out = pieces.encode_texts(make_docs(texts, extra=True))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in rows.values()) and len(rows) == len(texts)
    odd = make_docs([(None, "a b"), (7, "x"), (7, "x"), (7, "y")])
    assert sorted((r["doc_id"] or 0, r["round_trip"]) for r in pieces.encode_texts(odd).collect()) == [(0, True), (7, True), (7, True), (7, True)]
    lists = spark.createDataFrame([(1, None, "z"), (None, [], "z")], "doc_id long, pieces array<int>, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode_pieces(lists).collect()) == [(0, ""), (1, "")]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_texts(make_docs([])).count() == 0


# --- lattice language model ---


def sum_by_hand(weight, byte_weight, word):
    table = {b: i for i, b in enumerate(VOCAB.body) if VOCAB.normal[i]}
    data = b" " + word.encode()
    alpha = [0.0] * (len(data) + 1)
    alpha[0] = 1.0
    for e in range(1, len(data) + 1):
        if e < len(data) and (data[e] & 0xC0) == 0x80:
            continue
        for s in range(max(0, e - 48), e):
            i = table.get(data[s:e])
            if i is not None and alpha[s]:
                alpha[e] += alpha[s] * math.exp(weight[i])
        s = e - 1
        while (data[s] & 0xC0) == 0x80:
            s -= 1
        if data[s:e] not in table:
            alpha[e] += alpha[s] * math.exp(sum(byte_weight[b] for b in data[s:e]))
    return math.log10(alpha[len(data)])


def test_weights_are_a_distribution():
    log, _ = lm.piece_weights(VOCAB, "ranks")
    usable = VOCAB.normal.copy()
    usable[VOCAB.bytes_at] = True
    assert np.exp(log[usable]).sum() == pytest.approx(1)


def test_marginals_against_plain_recursion():
    weight, byte_weight = lm.piece_weights(VOCAB, "ranks")
    texts = ["the", "other", "ñandú", "日本", "a", "x7,!", "𓀀é"]
    data = b"".join(b" " + t.encode() for t in texts)
    sizes = np.array([len(t.encode()) + 1 for t in texts])
    got = marginals(VOCAB.automaton, weight, byte_weight, np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes) / math.log(10)
    assert got == pytest.approx([sum_by_hand(weight, byte_weight, t) for t in texts])


def check_lm(make_docs, texts, **kw):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in words_of(t, lower=True))
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    weight, byte_weight = lm.piece_weights(VOCAB, "ranks")
    p = (ends + 1) / (n + v + 2)
    want = []
    for (i, t), h in zip(rows, held):
        ws = words_of(t, lower=True)
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws) + math.log10((ends + 1) / (n + 1 * (v + 1)))
        score = sum(sum_by_hand(weight, byte_weight, w) + math.log10(1 - p) for w in ws) + math.log10(p)
        want.append((i, h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, base, score))
    out = lm.score_texts(make_docs(texts, extra=True), **kw).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(map(tuple, out), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


@pytest.mark.parametrize("frequent", [0, 8, 1 << 18])
def test_lm_against_plain_python(make_docs, corpus, frequent):
    texts = [t if t is None else t[:400] for t in corpus]
    check_lm(make_docs, texts, frequent=frequent)


def test_lm_with_repeated_and_null_ids(make_docs):
    check_lm(make_docs, [(1, "a b a"), (1, "a b a"), (1, "c"), (None, "a d"), (None, None)], frequent=1)


def test_lm_of_very_long_texts(make_docs):
    rng = random.Random(3)
    check_lm(make_docs, [" ".join(f"w{rng.randrange(900)}" for _ in range(30000)), "xy" * 40, "short"])


def test_lm_of_nothing(make_docs):
    assert lm.score_texts(make_docs([])).count() == 0
    check_lm(make_docs, [""])


# --- language ---

STEMS = {"en": "the and ing tion wh sh th", "de": "der und ung sch heit lich ei", "fr": "le que eau oi ment eux ai", "es": "el que ción ado ll os mente"}


def spoken(rng, lang, n):
    s = STEMS[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def lang_docs(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = [(i, spoken(rng, lang, rng.randrange(5, 60)), lang) for i in range(n) for lang in [rng.choice(list(STEMS))]]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, id string, score string")


def test_language_of_held_out_texts(spark):
    rows, df = lang_docs(spark)
    out = {r["doc_id"]: r for r in langid.identify(df, rows_per_lang=40).collect()}
    held = [(lang, out[i]["lang_pred"]) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in out.values())


def test_language_ignores_everything_but_the_text(spark):
    rows, df = lang_docs(spark, 80)
    more = df.unionByName(spark.createDataFrame([(1000 + 4 * k, rows[k][1], lang, "x", "y") for k in range(5) for lang in ("zz", None) if zlib.crc32(str(1000 + 4 * k).encode()) % 4 == 2], df.schema))
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(more).collect()}
    for k in range(5):
        if 1000 + 4 * k in out:
            assert out[1000 + 4 * k] == out[k]


def test_language_edge_cases(spark):
    _, df = lang_docs(spark, 60)
    odd = [(900, None), (901, ""), (902, "12 34 !"), (903, "日本"), (904, "“”…"), (None, "the and"), (905, "a"), (905, "a")]
    more = df.unionByName(spark.createDataFrame([(i, t, None, "x", "y") for i, t in odd], df.schema))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(more).where("doc_id is null or doc_id >= 900").collect()]
    und = {i for i, p, s in out if p == "und" and s == 0}
    assert und == {900, 901, 902, 904} and len(out) == len(odd)
    one = spark.createDataFrame([(0, "abc", "xx"), (1, "de", "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"xx"}
    assert langid.identify(one.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(one.withColumn("lang", one.lang.substr(9, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def shares_by_hand(text):
    """Shares of hashed byte 1- to 3-grams, gram by gram."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    data, out, offset = [fold(b) for b in text.encode()], np.zeros(langid.WIDTH), 0
    for n, size in enumerate(langid.SIZES, 1):
        grams = [data[i : i + n] for i in range(len(data) - n + 1)]
        for g in grams:
            value = 0
            for b in g:
                value = (value << 8 | b) % 2**32
            out[offset + (value * 2654435761 % 2**32 >> 32 - (size.bit_length() - 1))] += 1 / len(grams)
        offset += size
    return out


def choose_by_hand(model, text):
    """The family by its largest margin, then votes of the pairs inside it; (language, score)."""
    m = [float(shares_by_hand(text) @ w + b) for w, b in zip(model.weights.T, model.bias)]
    p = [1 / (1 + math.exp(-x * s)) for x, s in zip(m, model.slope)]
    nf = len(model.families)
    f = max(range(nf), key=lambda i: m[i])
    sure = p[f] / sum(p[:nf]) if nf > 1 else 1.0
    langs = model.langs[model.families[f]]
    votes, belief = Counter(), Counter()
    for j, (a, b) in enumerate(model.pairs):
        if a in langs:
            chance = p[nf + j]
            votes[a if chance > 0.5 else b] += 1
            belief[a] += chance
            belief[b] += 1 - chance
    best = max(langs, key=lambda x: (votes[x], belief[x]))
    return best, sure * (belief[best] / (len(langs) - 1) if len(langs) > 1 else 1)


def test_language_against_both_levels_by_hand(spark):
    rows, df = lang_docs(spark, 160, 4)
    rows += [(1000, "THE and ñ é. " * 2000, None), (1001, "x", None), (1002, "日本 der", None), (1003, "", None)]
    df = df.unionByName(spark.createDataFrame([(i, t, None, "x", "y") for i, t, _ in rows[-4:]], df.schema))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    train = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]  # fewer than a language's quota: all of them
    x = np.array([shares_by_hand(t) for _, t, _ in train]).astype(np.float32)
    model = langid.fit(x, np.array([lang for *_, lang in train], object))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    for i, text, _ in rows:
        want = choose_by_hand(model, text) if text else ("und", 0.0)
        assert out[i][0] == want[0] and out[i][1] == pytest.approx(want[1], abs=1e-3), i


def test_every_language_is_learnt(spark):
    """Many languages share the budget of rows; none is left out, and a common one is cut to its share."""
    letters = [chr(a) + chr(b) for a in range(97, 110) for b in range(97, 103)]
    rows = [(i, f"{s} {s}{s} " * 4, f"x{s}") for i, s in enumerate(letters * 6)] + [(1000 + i, "zz zq " * 5, "common") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, rows_per_lang=30, most_rows=800).collect()}
    assert set(out.values()) == {f"x{s}" for s in letters} | {"common"}
    assert sum(out[i] == lang for i, _, lang in rows) > 0.95 * len(rows)


# --- toxicity ---

BAD = ["grumpf", "zorkel", "blixt"]


def toxic_docs(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 9))]
        bad = rng.random() < 0.25
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(BAD) + " w1"
        rows.append((i, ". ".join(sentences) + ".", "x", "y"))
        marks.append((i, int(bad)))
    return rows, marks, spark.createDataFrame(rows, "doc_id long, text string, score string, id string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(spark):
    rows, marks, docs, labels = toxic_docs(spark)
    out = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(m, out[i]["predicted"]) for i, m in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 60
    for i, text, *_ in rows:
        r = out[i]
        if r["predicted"]:
            where = text[r["worst_start"] : r["worst_end"]]
            assert any(b in where for b in BAD) and where.count(".") <= 1
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_held_out_labels_are_not_read(spark):
    rows, marks, docs, labels = toxic_docs(spark, 120)
    flipped = spark.createDataFrame([(i, 1 - m if zlib.crc32(str(i).encode()) % 3 == 1 else m) for i, m in marks], labels.schema)
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_is_a_noisy_or_of_sentences():
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.WIDTH), -2.0)
    texts = ["One two. Three! four?", "five\nsix seven", "", "...", None]
    s = toxicity.sentences(*W.text_bytes(pa.array(texts, pa.string())))
    each, whole = model.score(s)
    for d in range(len(texts)):
        p = [each[k] for k in range(s.first[d], s.first[d + 1]) if s.first_word[k] < s.first_word[k + 1]] or [1 / (1 + math.exp(2))]
        assert whole[d] == pytest.approx(1 - np.prod([1 - x for x in p]))


def test_toxicity_edge_cases(spark):
    _, _, docs, labels = toxic_docs(spark, 120)
    more = docs.unionByName(spark.createDataFrame([(900, None, "", ""), (901, "", "", ""), (None, "a grumpf b", "", ""), (902, "x", "", ""), (902, "x", "", "")], docs.schema))
    out = toxicity.score(more, labels).where("doc_id is null or doc_id >= 900").collect()
    assert len(out) == 5 and all(r["score"] is not None for r in out)
    assert [r["predicted"] for r in out if r["doc_id"] is None] == [1]
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    odd = labels.selectExpr("doc_id", "case when doc_id % 2 = 0 then null else toxic end as toxic").union(spark.createDataFrame([(None, 1), (1, 0), (1, 1)], labels.schema))
    assert toxicity.score(docs, odd).count() == docs.count()


def features_by_hand(sentence):
    """Cells of a sentence's words and of their first four and six bytes."""
    plain = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or 48 <= b <= 57 else " " if b < 128 else chr(b) for b in sentence.encode())
    out = []
    for w in plain.split(" "):
        if w:
            raw = w.encode("latin-1")
            h = lambda x: W.Words(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), np.array([0, 1])).hashes()
            top = np.uint64(64 - (toxicity.WIDTH.bit_length() - 1))
            out += [int(h(raw)[0] >> top)] + [int(W.mix(h(raw[:n]) + np.uint64(n))[0] >> top) for n in toxicity.STEMS]
    return out


def test_toxicity_against_training_and_scores_by_hand(spark):
    """The query's scores are those of a model trained on the same documents, with every sentence scored by itself."""
    rows, marks, docs, labels = toxic_docs(spark, 160, 5)
    long = ". ".join(["w1 w2 w3"] * 20000) + ". a grumpf b"
    more = docs.unionByName(spark.createDataFrame([(900, long, "", ""), (901, "É grumpf! w5", "", "")], docs.schema))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(more, labels).collect()}
    train = [(t, m) for (i, t, *_), (_, m) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 3 != 1]
    split = [[s for s in __import__("re").split(r"[!.?\n\r]", t)] for t, _ in train]
    per = [[features_by_hand(s) for s in text] for text in split]
    flat = [f for text in per for f in text]
    cells = np.array([c for f in flat for c in f]).reshape(-1, 3).T
    first_word = np.cumsum([0] + [len(f) // 3 for f in flat])
    model = toxicity.fit(cells.astype(np.int32), first_word, np.cumsum([0] + [len(t) for t in per]), np.array([m for _, m in train]))
    for i, text in [(i, t) for i, t, *_ in rows[:60]] + [(901, "É grumpf! w5")]:
        none = 1.0
        for s in __import__("re").split(r"[!.?\n\r]", text):
            if f := features_by_hand(s):
                none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights[c] for c in f))))
        assert out[i] == pytest.approx(1 - none, abs=1e-4), i
    assert out[900] > 0.7


def test_rejecting_keeps_columns_and_clean_rows(spark):
    _, marks, docs, labels = toxic_docs(spark, 150)
    kept = toxicity.reject(docs, labels)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in scored.items() if not p)
