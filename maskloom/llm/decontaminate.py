"""Benchmark items inside long documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.copies import filtered
from maskloom.llm.sketch import bitmap, flagged
from maskloom.llm.store import saved, prepare

EXACT = np.uint64(0x5851F42D4C957F2D)


def hashes_needed(u: int, q: int, threshold: float, miss: float) -> int:
    """MinHash functions needed so that an item of q shingles or more, held to ``threshold`` by a set of
    u, shares no minimum with a chance under ``miss``: its Jaccard is at least t / (1 - t + u / q)."""
    least = min(1.0, threshold / (1 - threshold + u / q))
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log1p(-least))


def _minima(h: np.ndarray, k: int) -> np.ndarray:
    """The first k bucket keys (function, minimum) of a set."""
    seeds = np.arange(1, k + 1, dtype=np.uint64) * W.GOLDEN
    least = np.empty(k, np.uint64)
    for a in range(0, k, 64):
        least[a : a + 64] = W.mix(h[None, :] ^ W.mix(seeds[a : a + 64])[:, None]).min(1)
    return W.mix(least + seeds)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part, data, at in W.pieces(batch):
            words = W.split(data, at, lower=True)
            h, first = W.distinct(*W.shingles(words.hashes(), words.first, shingle))
            yield part.column("id"), part.column("key"), h, first


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.uint64).view(np.int64)))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    miss: float = 1e-9,
    most_hashes: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs of document and item where the document holds num/den or more of the item's shingles.

    A-Z are lower-cased; sets have the different ``shingle``-word runs, or the whole sequence if there
    are fewer words. A bitmap of bounded size of all item shingles cuts every document, at the scan,
    to what it may share with any item: containment stays as it was, and documents that are cut to
    less than the smallest item needs drop out. What is left of a document puts it into a partition by
    size (powers of two), items are in classes by size, and each (partition, class) has as many
    MinHash functions as its lowest possible Jaccard needs to miss a true pair with a chance under
    ``miss``. Equal minima are candidates. Where that would take more than ``most_hashes``, all shingles
    left of the document are looked up instead, which misses none. Candidates are verified by exact
    shingle containment. Only buckets are joined (hot ones are split by the adaptive skew join); texts
    are never shuffled and the item table may be of any size.

    Null, empty and wordless texts and items match nothing; null ids are left out. Rows that repeat
    an id are one document (or item), with its best text's figures. Other columns are ignored; either
    table may be empty. Returns id, item id, n_item, n_shared (long) and containment.
    """
    prepare(docs.sparkSession)
    threshold = num / den

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, h, first in _sets(batches, shingle):
            yield pa.record_batch([ids, keys, _lists(np.split(h, first[1:-1])) if len(ids) else _lists([])], ["id", "key", "grams"])

    def rows(df: DataFrame, i: str, t: str) -> DataFrame:
        out = df.select(F.col(i).cast("long").alias("id"), F.col(t).cast("string").alias("text"))
        return out.where("id is not null and text is not null").withColumn("key", F.xxhash64("text"))

    known = saved(rows(items, item_col, item_text_col).mapInArrow(sets_of, "id long, key long, grams array<long>").where("size(grams) > 0"), "items")
    level = F.floor(F.log2(F.size("grams"))).cast("int")
    least = {r["level"]: r["q"] for r in known.groupBy(level.alias("level")).agg(F.min(F.size("grams")).alias("q")).collect()}
    tokens = known.select(F.explode("grams").alias("gram"))
    bits = bitmap(tokens, "gram", max(1 << 19, tokens.count()))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, h, first in _sets(batches, shingle):
            keep = flagged(bits.value, pa.array(h.view(np.int64)))
            below = np.concatenate([[0], np.cumsum(keep)])
            first, h = below[first], h[keep]
            at, grams, buckets = [], [], []
            for d in np.flatnonzero(np.diff(first)).tolist():
                own = h[first[d] : first[d + 1]]
                upper = (2 << (len(own).bit_length() - 1)) - 1
                want = {c: hashes_needed(upper, q, threshold, miss) for c, q in least.items() if len(own) * den >= q * num}
                if not want:
                    continue
                some = _minima(own, max([k for k in want.values() if k <= most_hashes], default=0))
                found = [W.mix(some[:k] + np.uint64(c)) if k <= most_hashes else W.mix(own + EXACT + np.uint64(c)) for c, k in want.items()]
                at.append(d)
                grams.append(own)
                buckets.append(np.concatenate(found))
            yield pa.record_batch([ids.take(pa.array(at, pa.int64())), keys.take(pa.array(at, pa.int64())), _lists(grams), _lists(buckets)], ["id", "key", "grams", "buckets"])

    def item_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = []
            for grams in batch.column("grams"):
                h = grams.values.to_numpy().view(np.uint64)
                c = np.uint64(len(h).bit_length() - 1)
                buckets.append(np.concatenate([W.mix(_minima(h, most_hashes) + c), W.mix(h + EXACT + c)]))
            yield pa.record_batch([batch.column("id"), batch.column("key"), _lists(buckets)], ["item_id", "item_key", "buckets"])

    cut = saved(rows(docs, id_col, text_col).mapInArrow(looked_up, "id long, key long, grams array<long>, buckets array<long>"), "cut-documents")
    theirs = known.mapInArrow(item_buckets, "item_id long, item_key long, buckets array<long>").select("item_id", "item_key", F.explode("buckets").alias("bucket"))
    ours = cut.select("id", "key", F.explode("buckets").alias("bucket"))
    pairs = ours.join(theirs, "bucket").select("id", "key", "item_id", "item_key").distinct()
    n_item = F.size("item_grams").cast("long")
    shared = F.size(F.array_intersect("grams", "item_grams")).cast("long")
    verified = (
        pairs.join(cut.select("id", "key", "grams").dropDuplicates(["id", "key"]), ["id", "key"])
        .join(known.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("grams").alias("item_grams")).dropDuplicates(["item_id", "item_key"]), ["item_id", "item_key"])
        .select("id", "item_id", n_item.alias("n_item"), shared.alias("n_shared"))
        .where(F.col("n_shared") * den >= F.col("n_item") * num)
    )
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item"))
    out = verified.groupBy("id", "item_id").agg(best.alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "best.n_item", "best.n_shared", "best.containment")


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``bad`` (one long column of that name); null ids stay.

    A bitmap of bounded size lets rows that cannot be in ``bad`` pass at the scan, so only the others
    are shuffled with their text. All columns are kept.
    """
    bad = saved(bad.select(F.col(id_col).cast("long").alias(id_col)).where(F.col(id_col).isNotNull()).distinct(), "dropped-ids")
    bits = bitmap(bad, id_col, bad.count())
    steer = "__maskloom_steer"
    while steer in docs.columns:
        steer += "_"
    marked = docs.withColumn(steer, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    clear = marked.mapInArrow(lambda it: filtered(it, bits.value, steer, False), marked.schema).drop(steer)
    doubtful = marked.mapInArrow(lambda it: filtered(it, bits.value, steer, True), marked.schema).drop(steer)
    return clear.unionByName(doubtful.join(bad, id_col, "left_anti").select(*docs.columns))
