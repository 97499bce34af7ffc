"""Language-model scoring: the summed probability of all subword segmentations of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.automaton import marginals
from maskloom.llm.pieces import MODEL, Vocabulary, shared_vocabulary
from maskloom.llm.store import saved, prepare

LN10 = float(np.log(10))


def piece_weights(vocab: Vocabulary, scores: str, shift: float = 2.7) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of every id, of every byte): all pieces that can be used sum to one.

    ``scores="logs"`` takes the vocabulary's scores as log-probabilities. ``"ranks"`` is for
    vocabularies whose scores are minus the rank of a piece: a Zipf-Mandelbrot law of the rank, 1 /
    (rank + shift), makes weights of them. Bytes and pieces scored at the far end get the last rank.
    """
    score = vocab.score.astype(np.float64).copy()
    low = score[vocab.normal & (score > -1e8)].min()
    score[score <= -1e8] = low - 1
    score[vocab.bytes_at] = low - 1
    log = -np.log(shift - score) if scores == "ranks" else score
    usable = vocab.normal.copy()
    usable[vocab.bytes_at] = True
    top = log[usable].max()
    log = log - (top + np.log(np.exp(log[usable] - top).sum()))
    return log, log[vocab.bytes_at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, W.Words]]:
    for batch in batches:
        for part, data, at in W.pieces(batch):
            yield part, W.split(data, at, lower=True)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words in _texts(batches):
        w, n = np.unique(words.hashes(), return_counts=True)
        yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])


def bucket_of(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod


def score_texts(
    docs: DataFrame,
    model: str = MODEL,
    scores: str = "ranks",
    held_out_mod: int = 7,
    held_out_rest: int = 2,
    frequent: int = 1 << 18,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """log10 probability of every whole text under a subword lattice, beside a word-count base.

    A-Z are lower-cased; tokens are the words and one end. The lattice of a word has every
    segmentation of it, with its word mark, into pieces of an existing vocabulary; the forward
    recursion in log space sums their probabilities, so a text's probability is a product over its
    words (no piece spans two). The chance p that a text ends after a word is learnt from the training
    documents (those whose bucket is not held out): p = (ends + 1) / (tokens + types + 2).

    The base is a word unigram with add-one counts of the training documents. Word counts are
    gathered from all of them by 64-bit word hash, pre-aggregated in the tasks. The words of the
    highest counts, ``frequent`` at most, are broadcast; the occurrences of all others, bounded by
    those words' own counts, meet their counts in a join, one row for each word of a document.

    Null and empty texts have one token, the end. Rows that repeat id and text are scored alike; null
    ids are kept and train. An empty table gives an empty result; other columns are ignored.

    Returns id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double).
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    vocab = shared_vocabulary(spark, model)
    weight, byte_weight = piece_weights(vocab.value, scores)
    weights = spark.sparkContext.broadcast((weight, byte_weight))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = bucket_of(F.col("id"), held_out_mod) == held_out_rest
    train = rows.where(~out)
    counts = saved(train.select("text").mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "word-counts")
    bins = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("bin")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()
    ends = train.count()
    n_types = sum(r["types"] for r in bins) + (ends > 0)
    n_tokens = sum(r["tokens"] for r in bins) + ends
    cut, room = 64, frequent
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if (room := room - r["types"]) < 0:
            break
        cut = r["bin"]
    common = counts.where(F.col("c") >= (1 << cut)).toArrow() if cut < 63 else None
    w = common["w"].to_numpy().view(np.uint64) if common is not None else np.zeros(0, np.uint64)
    order = np.argsort(w)
    c = common["c"].to_numpy()[order] if common is not None else np.zeros(0, np.int64)
    known = spark.sparkContext.broadcast((w[order], c))
    end_chance = (ends + 1) / (n_tokens + n_types + 2)
    go_on, stop = float(np.log10(1 - end_chance)), float(np.log10(end_chance))

    def lookup(h: np.ndarray) -> np.ndarray:
        w, c = known.value
        if not len(w):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(w, h), len(w) - 1)
        return np.where(w[at] == h, c[at], 0)

    def chances(words: W.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the summed probability of some words' segmentations, each with its mark before it."""
        starts, lengths = words.starts[which], words.ends[which] - words.starts[which]
        total = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.full(total[-1], 0x20, np.uint8)
        step = np.arange(int(lengths.sum()))
        before = np.cumsum(lengths) - lengths
        data[step + np.repeat(total[:-1] + 1 - before, lengths)] = words.data[step + np.repeat(starts - before, lengths)]
        return np.ones(len(which), np.int64), marginals(vocab.value.automaton, *weights.value, data, total[:-1], lengths + 1) / LN10

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches):
            h = words.hashes()
            kinds, where, which = np.unique(h, return_index=True, return_inverse=True)
            begin, _, flat = vocab.value.memory(np.float64).fetch(kinds, lambda new: chances(words, where[new]))  # noqa: B023
            each = flat[begin]
            count = lookup(kinds)
            sums = [np.concatenate([[0], np.cumsum(x[which])]) for x in (each + go_on, count > 0, np.log10(count + 1.0))]
            per = [s[words.first[1:]] - s[words.first[:-1]] for s in sums]
            yield pa.record_batch([
                part.column("id"), part.column("key"),
                pa.array(words.counts.astype(np.int64) + 1),
                pa.array(per[1].astype(np.int64) + (ends > 0)),
                pa.array(per[2] + np.log10(ends + 1.0)),
                pa.array(per[0] + stop),
                pa.array(np.ones(len(words.counts), np.int64)),
            ], NAMES)

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches):
            h = words.hashes()
            kinds, which = np.unique(h, return_inverse=True)
            rare = (lookup(kinds) == 0)[which]
            below = np.concatenate([[0], np.cumsum(rare)])
            first, h = below[words.first], h[rare]
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                h[a:b].sort()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            doc = pa.array(doc[at])
            yield pa.record_batch([pa.array(h[at].view(np.int64)), part.column("id").take(doc), part.column("key").take(doc), pa.array(np.diff(np.append(at, len(h))).astype(np.int32))], ["w", "id", "key", "tf"])

    keyed = rows.withColumn("key", F.xxhash64("text"))
    whole = keyed.mapInArrow(by_document, "id long, key long, n_tokens long, n_known long, base double, score double, n_rows long")
    rare = keyed.mapInArrow(rare_words, "w long, id long, key long, tf int")
    met = rare.join(counts.where(F.col("c") < (1 << min(cut, 62))), "w")
    zero = F.lit(0).cast("long")
    met = met.groupBy("id", "key").agg(
        zero.alias("n_tokens"),
        F.sum("tf").alias("n_known"),
        F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("base"),
        F.lit(0.0).alias("score"),
        zero.alias("n_rows"),
    )
    both = whole.unionByName(met).groupBy("id", "key").agg(*[F.sum(x).alias(x) for x in NAMES[2:]])
    level = float(np.log10(n_tokens + n_types + 1))
    n = F.col("n_rows")
    done = both.select(
        F.col("id").alias(id_col),
        out.alias("held_out"),
        F.expr("n_tokens div n_rows").alias("n_tokens"),
        F.expr("n_known div n_rows").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / n - F.expr("n_tokens div n_rows") * level).alias("base_score"),
        (F.col("score") / n).alias("score"),
        F.sequence(F.lit(1).cast("long"), n).alias("copies"),
    )
    return done.withColumn("copies", F.explode("copies")).drop("copies")


NAMES = ["id", "key", "n_tokens", "n_known", "base", "score", "n_rows"]
