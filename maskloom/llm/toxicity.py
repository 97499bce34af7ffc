"""Toxicity by multiple-instance learning: sentence scores, a noisy-or, labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.linear import sigmoid
from maskloom.llm.lm import bucket_of
from maskloom.llm.store import prepare

WIDTH = 1 << 18
#: Bytes of a word's start that are features beside the whole word.
STEMS = (4, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[0x21, 0x2E, 0x3F, 0x0A, 0x0D]] = True  # ! . ? and line ends
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 0x20
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


@dataclass
class Sentences:
    """Sentences of some texts: byte bounds, the words' cells, the first word of each sentence
    and the first sentence of each text."""

    bounds: np.ndarray
    cells: np.ndarray  # (3, words): whole word, stems
    first_word: np.ndarray
    first: np.ndarray


def sentences(data: np.ndarray, at: np.ndarray) -> Sentences:
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = _ENDS[data]
    cut[at] = True
    bounds = np.flatnonzero(cut)
    words = W.split(_PLAIN[data], bounds)
    whole = words.hashes()
    top = np.uint64(64 - (WIDTH.bit_length() - 1))
    cells = [whole >> top]
    for n in STEMS:
        stems = W.Words(words.data, words.starts, np.minimum(words.ends, words.starts + n), words.first).hashes()
        cells.append(W.mix(stems + np.uint64(n)) >> top)
    cells = np.stack(cells).astype(np.int64)
    return Sentences(bounds, cells, words.first, np.searchsorted(bounds, at))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    """Sentence chance: sigmoid(bias + weights of its words); text chance: 1 - product of (1 - sentence's)."""

    weights: np.ndarray
    bias: float

    def score(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each sentence, chance of each text). A text without words has that of one empty sentence."""
        logit = self.bias + _sums(self.weights[s.cells].sum(0), s.first_word)
        none = np.where(np.diff(s.first_word) > 0, -np.logaddexp(0, logit), 0)  # log of (1 - chance)
        texts = _sums(none, s.first)
        texts = np.where(_sums(np.diff(s.first_word), s.first) > 0, texts, -np.logaddexp(0, self.bias))
        return sigmoid(logit), np.clip(-np.expm1(texts), 0, 1)


def telling(used: int, cell: np.ndarray, text: np.ndarray, label: np.ndarray, sure: float = 1.645) -> np.ndarray:
    """For each feature the lower confidence bound of its log odds ratio of being in a document of label 1."""
    pairs = cell.astype(np.int64) * len(label) + text
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    feature, doc = pairs // len(label), pairs % len(label)
    yes = np.bincount(feature, label[doc] == 1, minlength=used)
    no = np.bincount(feature, label[doc] == 0, minlength=used)
    n_yes, n_no = (label == 1).sum(), (label == 0).sum()
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    return odds - sure * np.sqrt(1 / (yes + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (no + 0.5) + 1 / (n_no - no + 0.5))


def fit(cells: np.ndarray, first_word: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 300, decay: float = 2e-5, least: float = 1.0) -> Model:
    """Adam on the noisy-or likelihood of document labels, both labels weighted alike.

    Only features whose odds for label 1 are raised beyond doubt (``telling`` over ``least``) get a
    weight, so that words of a single document are not learnt by heart.
    """
    used, cell = np.unique(cells, return_inverse=True)
    cell = cell.reshape(cells.shape).astype(np.int32)
    n_sentences, alive = len(first_word) - 1, np.diff(first_word) > 0
    sentence = np.repeat(np.arange(n_sentences, dtype=np.int32), np.diff(first_word))
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    tells = telling(len(used), cell.ravel(), np.tile(text[sentence], len(cell)), label)
    kept = np.flatnonzero(tells > least)
    place = np.full(len(used), -1, np.int32)
    place[kept] = np.arange(len(kept))
    where = [np.flatnonzero(place[c] >= 0) for c in cell]  # the other features weigh nothing and are left out
    at = np.concatenate([sentence[k] for k in where])
    feature = np.concatenate([place[c[k]] for c, k in zip(cell, where, strict=True)])
    del cell, sentence
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    w, b = tells[kept], -5.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for t in range(1, rounds + 1):
        logit = b + np.bincount(at, w[feature], minlength=n_sentences)
        p = np.where(alive, sigmoid(logit), 0)
        none = np.bincount(text, np.where(alive, -np.logaddexp(0, logit), 0), minlength=len(label))
        none = np.minimum(none, -1e-9)
        # d loss / d log(1 - P): 1 for label 0; -(1 - P) / P for label 1
        slope = share * np.where(label == 1, np.exp(none) / -np.expm1(none), -1.0)
        push = -slope[text] * p  # to the sentence's logit
        grad = np.bincount(feature, push[at], minlength=len(kept)) + decay * w
        grad_b = float(push.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        rate = 0.1 / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(WIDTH)
    weights[used[kept]] = w
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int = 3, held_out_rest: int = 1, rows_per_label: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled documents whose bucket is not held out.

    Of each label, the ``rows_per_label`` documents of smallest id hash, whole texts. Ids whose
    labels contradict each other, null ids and null labels do not train. None if a label is missing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    marks = marks.where(bucket_of(F.col("id"), held_out_mod) != held_out_rest)
    present = marks.join(rows.select("id").where("id is not null").distinct(), "id", "left_semi")
    chosen: dict[int, int] = {}
    for label in (0, 1):
        some = present.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows_per_label).collect()
        if not some:
            return None
        chosen |= {r["id"]: label for r in some}
    ids = spark.sparkContext.broadcast(np.array(sorted(chosen), np.int64))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("id").to_numpy(zero_copy_only=False), ids.value)))
            for part, data, at in W.pieces(batch):
                s = sentences(data, at)
                for k in range(part.num_rows):
                    first = s.first_word[s.first[k] : s.first[k + 1] + 1]
                    cells = s.cells[:, first[0] : first[-1]].astype(np.int32)
                    yield pa.record_batch([part.column("id").slice(k, 1), pa.array([cells.tobytes()], pa.binary()), pa.array([(first - first[0]).astype(np.int32).tobytes()], pa.binary())], ["id", "cells", "first"])

    sample = rows.where(F.col("id").isNotNull()).mapInArrow(words_of, "id long, cells binary, first binary").dropDuplicates(["id"]).orderBy("id").toArrow()
    cells = [np.frombuffer(c, np.int32).reshape(1 + len(STEMS), -1) for c in sample["cells"].to_pylist()]
    starts = [np.frombuffer(f, np.int32).astype(np.int64) for f in sample["first"].to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(f) - 1 for f in starts])])
    base = np.concatenate([[0], np.cumsum([c.shape[1] for c in cells])])
    first_word = np.concatenate([*[f[:-1] + b for f, b in zip(starts, base, strict=False)], base[-1:]])
    label = np.array([chosen[i] for i in sample["id"].to_pylist()])
    return fit(np.concatenate(cells, 1), first_word, first, label)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out_mod: int = 3, held_out_rest: int = 1, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Toxicity of every whole text, and where it is worst.

    A sentence ends at ``. ! ?`` or a line end. Its chance is a logistic function of its lower-cased
    words and their first bytes, hashed; the document's is a noisy-or of its sentences. Only
    document labels train it (``train``). Scoring is one scan.

    Null and empty texts are scored as one empty sentence. Without both labels every score is 0. Null
    ids and repeated rows are kept; other columns are ignored; an empty table gives an empty result.

    Returns id, held_out, score (0 to 1), predicted (1 from ``threshold`` on), and worst_start,
    worst_end, worst_score: characters and chance of the likeliest sentence (null without words).
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    found = train(docs, labels, held_out_mod, held_out_rest, id_col=id_col, text_col=text_col, **bounds)
    model = spark.sparkContext.broadcast(found or Model(np.zeros(WIDTH), -1e3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in W.pieces(batch):
                s = sentences(data, at)
                each, whole = model.value.score(s)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                each = np.where(np.diff(s.first_word) > 0, each, -1.0)
                worst = np.full(len(whole), -1)
                full = np.flatnonzero(np.diff(s.first))
                if len(full):
                    peak = np.maximum.reduceat(each, s.first[full])
                    doc = np.repeat(np.arange(len(full)), np.diff(s.first)[full])
                    hit = np.flatnonzero(each[s.first[full[0]] :] == peak[doc]) + s.first[full[0]]
                    _, one = np.unique(doc[hit - s.first[full[0]]], return_index=True)
                    worst[full] = np.where(peak >= 0, hit[one], -1)
                none = worst < 0
                a, b = (chars[s.bounds[np.minimum(worst + k, len(s.bounds) - 1)]] - chars[at[:-1]] for k in (0, 1))
                top = each[worst] if len(each) else np.zeros(len(worst))
                yield pa.record_batch([
                    part.column("id"), pa.array(whole), pa.array(a.astype(np.int64), mask=none), pa.array(b.astype(np.int64), mask=none), pa.array(top, mask=none),
                ], ["id", "score", "worst_start", "worst_end", "worst_score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(run, "id long, score double, worst_start long, worst_end long, worst_score double")
    return done.select(
        F.col("id").alias(id_col),
        (bucket_of(F.col("id"), held_out_mod) == held_out_rest).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
        "worst_score",
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``: the filter of ``score``, in one scan."""
    prepare(docs.sparkSession)
    found = train(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    model = docs.sparkSession.sparkContext.broadcast(found or Model(np.zeros(WIDTH), -1e3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in W.pieces(batch, text_col):
                yield part.filter(pa.array(model.value.score(sentences(data, at))[1] < threshold))

    return docs.mapInArrow(W.tidy(run), docs.schema)
