"""Repeated passages: a count-min prefilter, then exact grouping of the windows it estimates repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskloom.llm import words as W
from maskloom.llm.copies import Distinct, filtered
from maskloom.llm.sketch import SCHEMA, bitmap, bits_at, listed, repeated_bits, slots, width_for
from maskloom.llm.store import saved

DEPTH = 2
OUT = StructType([StructField("id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])


def _anchors(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window: the smallest hash of its ``gram``-word runs.

    Equal windows have equal anchors, so a window's count is at most its anchor's.
    """
    n = len(h)
    gram = min(gram, window)
    total = np.zeros(n, np.uint64)
    for j in range(min(gram, n)):
        total[: n - j] += h[j:] * W.GOLDEN ** np.uint64(j)
    least = W.sliding_min(W.mix(total), window - gram + 1)
    at = np.flatnonzero(W._starts(first, window))
    at = at[at + window <= n]
    return at, least[at]


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, W.Words]]:
    for rows, data, at in W.pieces(batch):
        yield rows, W.split(data, at)


def _by_document(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


def _finished(rows: pa.RecordBatch, words: W.Words, gone: np.ndarray) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(gone)])
    out = {
        "id": rows.column("id"),
        "n_words": pa.array(words.counts.astype(np.int64), pa.int64()),
        "n_removed": pa.array(np.diff(total[words.first]).astype(np.int64), pa.int64()),
        "kept": W.string_array(*W.joined(words, ~gone)),
    }
    return pa.record_batch(out | ({"rest": rows.column("rest")} if "rest" in rows.schema.names else {}))


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16, most_cells: int = 1 << 29, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of every ``window``-word passage that also starts in a document of smaller id.

    Words are taken unchanged; windows are judged on the input. Copies of a whole text are settled
    by their digest: nothing of a text of ``window`` words or more stays in a later copy. Over the
    different texts,

    1. every task fills a count-min sketch with the distinct window anchors (the smallest hash of a
       window's ``gram``-word runs) of each document; the sketches are merged in a tree. A window
       occurs in no more documents than its anchor is counted, so estimates are too large, never too
       small. Cells follow the number of anchors expected, up to ``most_cells`` a row; a fuller sketch
       lets more windows through and loses none;
    2. a second pass sends only windows whose anchor is estimated in two documents or more, keyed by
       80 bits of window hash, and groups them exactly: the smallest id of each key, pre-aggregated in
       the tasks, owns it. Each key has one owner, so what goes on is one row a key, however many
       documents hold it. A document is told the windows it owns; its other estimated windows start
       in a smaller document and go. Only documents that lose words are shuffled with their text.

    With ``carry`` all other columns come back in a struct ``rest``. Null and empty texts have no words.
    Rows with a null id are returned unchanged and are nobody's source. Rows that repeat an id are one
    document. Very long texts are worked on whole, one at a time. Other columns are otherwise ignored;
    an empty table gives an empty result. Returns id, n_words, n_removed, kept (words joined by one
    space), one row for each input row.
    """
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([rest] if carry else []))
    result = StructType([*OUT.fields, *([rows.schema["rest"]] if carry else [])])
    nameless = rows.where("id is null")
    unique = Distinct(rows.where("id is not null"))

    size = unique.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = width_for(size // 8, 1 << 12, most_cells)  # some ten cells an anchor

    def anchored(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, words in _unpack(batch):
            at, anchor = _anchors(words.hashes(), words.first, window, gram)
            doc = _by_document(at, words.first)
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            bounds = np.searchsorted(doc[new], np.arange(len(words.first)))
            anchor, _ = W.distinct(anchor[new], bounds)
            for k in range(DEPTH):
                yield slots(anchor, cells, k) + k * cells

    repeated = rows.sparkSession.sparkContext.broadcast(repeated_bits(unique.map(listed(DEPTH * cells, anchored), SCHEMA), DEPTH * cells))

    def estimated(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word index, document, hash, second hash) of the windows estimated to repeat."""
        h = words.hashes()
        at, anchor = _anchors(h, words.first, window, gram)
        pick = np.ones(len(at), bool)
        for k in range(DEPTH):
            left = np.flatnonzero(pick)
            pick[left] = bits_at(repeated.value, slots(anchor[left], cells, k) + k * cells)
        if pick.any():
            at, w, v = (x[pick] for x in W.windows(h, words.first, window))
        else:
            at, w, v = at[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return at, _by_document(at, words.first), w, v

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(w, v, id, n): each document's distinct windows, and one row with v < 0 that says how many."""
        for batch in batches:
            for part, words in _unpack(batch):
                _, doc, w, v = estimated(words)
                if not len(w):
                    continue
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "key"))
                order = np.lexsort((w, doc))
                doc, w, v = doc[order], w[order], v[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
                doc, w, v = doc[new], w[new], v[new]
                who, n = np.unique(doc, return_counts=True)
                name = W.mix(keys[who].view(np.uint64) ^ W.mix(ids[who].view(np.uint64) + W.GOLDEN))
                mark = -1 - (W.mix(name + W.GOLDEN) >> np.uint64(33)).astype(np.int64)
                yield pa.record_batch({
                    "w": pa.array(np.concatenate([w, name]).view(np.int64), pa.int64()),
                    "v": pa.array(np.concatenate([(v >> np.uint64(48)).astype(np.int64), mark]).astype(np.int32), pa.int32()),
                    "id": pa.array(np.concatenate([ids[doc], ids[who]]), pa.int64()),
                    "n": pa.array(np.concatenate([np.zeros(len(w), np.int64), n]).astype(np.int32), pa.int32()),
                })

    seen = unique.map(candidates, "w long, v int, id long, n int")
    owners = seen.groupBy("w", "v").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    told = owners.groupBy("id").agg(F.collect_list(F.when(F.col("v") >= 0, F.col("w"))).alias("own"), F.sum("n").alias("asked"))
    told = saved(told.where(F.col("asked") > F.size("own")).select("id", "own"), "owned-windows")
    losers = bitmap(told, "id", told.count())

    def steered(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
        return filtered(batches, losers.value, "id", want)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpack(batch):
                yield _finished(part, words, np.zeros(len(words.starts), bool))

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpack(batch):
                yield _finished(part, words, np.repeat(words.counts >= window, words.counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            lists = batch.column("own")
            for part, words in _unpack(batch):
                at, doc, w, _ = estimated(words)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                change = np.zeros(len(words.starts) + 1, np.int64)
                for k in range(part.num_rows):
                    if (own := lists[row + k]).is_valid:  # not so for those that the bitmap lets through
                        a, b = bounds[k], bounds[k + 1]
                        gone = at[a:b][~np.isin(w[a:b], own.values.to_numpy().view(np.uint64))]
                        change[gone] += 1
                        change[gone + window] -= 1
                row += part.num_rows
                yield _finished(part, words, np.cumsum(change)[:-1] > 0)

    more = ["rest"] if carry else []
    untouched = unique.map(lambda it: whole(steered(it, False)), result)
    touched = unique.map(lambda it: steered(it, True), unique.docs.schema)
    touched = touched.join(told, "id", "left").select("id", "text", "own", *more).mapInArrow(cut, result)
    copies = unique.later().select("id", "text", *more).mapInArrow(copied, result)
    unnamed = nameless.mapInArrow(whole, result)
    return untouched.unionByName(touched).unionByName(copies).unionByName(unnamed).withColumnRenamed("id", id_col)
