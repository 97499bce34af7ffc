"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.store import prepare, saved, shuffle_partitions

EXACT = float(1 << 52)


def finite(vec: Column) -> Column:
    """True for vectors that take part: not null, every component finite."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def scaled(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A float64 matrix of a list<int64> column; shorter vectors are filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(lengths), width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)] = flat[ends[0] : ends[-1]]
    return out


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _gram(batches):
    """The partition's share of the Gram matrix, as (i, j, value)."""
    total = np.zeros((0, 0))
    for batch in batches:
        m = _matrix(batch.column("vec"))
        d = max(len(total), m.shape[1])
        grown = np.zeros((d, d))
        grown[: len(total), : len(total)] = total
        m = _wide(m, d)
        total = grown + m.T @ m
    i, j = np.indices(total.shape)
    yield pa.record_batch({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "g": total.ravel()})


def _packed(rows: int, d: int):
    """Groups consecutive rows into blocks of at most ``rows`` vectors."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = _wide(_matrix(part.column("vec")), d)
                yield pa.record_batch({
                    "ids": pa.array([part.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    "mat": pa.array([m.astype(np.int32 if np.abs(m).max(initial=0) < 2**31 else np.float64).tobytes()], pa.binary()),
                    "n": pa.array([part.num_rows], pa.int32()),
                    "norm": pa.array([float(np.sqrt((m * m).sum(1).max(initial=0)))], pa.float64()),
                })

    return pack


def _reaching(d: int, seed_ids: np.ndarray, seeds: np.ndarray, k: int):
    """Queries with ``floor``, a true lower bound of their k-th best product, and ``reach``, the least length that can pass it."""

    def run(batches):
        for batch in batches:
            q, ids = _wide(_matrix(batch.column("vec")), d), batch.column("id").to_numpy().astype(np.int64)
            floor = np.full(len(q), -np.inf)
            first = _products(q, seeds)
            for r in range(len(q)):  # k-th best product among the longest vectors
                own = first[r][seed_ids != ids[r]]
                if len(own) >= k:
                    floor[r] = np.partition(own, len(own) - k)[len(own) - k]
            norm = np.sqrt((q * q).sum(1))
            reach = np.where(floor <= 0, 0.0, floor / np.maximum(norm, 1e-300)) * (1 - 1e-9) - 1e-6
            yield pa.record_batch([batch.column("id"), batch.column("vec"), pa.array(floor), pa.array(reach)], ["id", "vec", "floor", "reach"])

    return run


def _query_blocks(rows: int, d: int):
    """Consecutive queries as blocks of at most ``rows``, with the least reach of each block."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = _wide(_matrix(part.column("vec")), d)
                ids = part.column("id").to_numpy().astype(np.int64)
                yield pa.record_batch({
                    "qids": pa.array([ids.tobytes()], pa.binary()),
                    "qmat": pa.array([m.astype(np.int32 if np.abs(m).max(initial=0) < 2**31 else np.float64).tobytes()], pa.binary()),
                    "qfloor": pa.array([part.column("floor").to_numpy().tobytes()], pa.binary()),
                    "qn": pa.array([part.num_rows], pa.int32()),
                    "reach": pa.array([float(part.column("reach").to_numpy().min())]),
                })

    return pack


PACKED = "ids binary, mat binary, n int, norm double"


def _unpacked(ids: bytes, mat: bytes, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int32 if len(mat) == 4 * n * d else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(mat, kind).reshape(n, d).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where no sum can pass 2^52, else in 64-bit integers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: higher score, then smaller id."""
    if len(scores) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= low
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class _Search:
    """Running top-k of one block of queries over candidate blocks, fed by descending length."""

    def __init__(self, qids, q, floor, rotation, k, head):
        self.ids, self.q, self.k, self.head, self.rotation = qids, q, k, head, rotation
        turned = q @ rotation
        self.front, self.rest = turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(1))
        self.norm, self.floor = np.sqrt((q * q).sum(1)), floor.copy()
        self.top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]

    def feed(self, ids, c, longest):
        slack = 1e-9 * self.norm * longest + 1e-6
        alive = np.flatnonzero(self.norm * longest + slack >= self.floor)
        if not len(alive) or not len(ids):
            return
        turned = c @ self.rotation
        tail = np.sqrt((turned[:, self.head :] ** 2).sum(1))
        bound = self.front[alive] @ turned[:, : self.head].T + np.outer(self.rest[alive], tail)
        may = (bound + slack[alive, None] >= self.floor[alive, None]) & (ids[None, :] != self.ids[alive, None])
        exact = _products(self.q[alive], c) if may.mean() > 0.05 else None
        for row, r in enumerate(alive):
            at = np.flatnonzero(may[row])
            if not len(at):
                continue
            score = exact[row, at] if exact is not None else _products(self.q[r : r + 1], c[at])[0]
            had = self.top[r]
            s, i = _best(np.concatenate([had[0], score.astype(np.int64)]), np.concatenate([had[1], ids[at]]), self.k)
            self.top[r] = s, i
            if len(s) == self.k:
                self.floor[r] = max(self.floor[r], s[-1])

    def rows(self):
        n = [len(s) for s, _ in self.top]
        return pa.record_batch({
            "query_id": pa.array(np.repeat(self.ids, n), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i in self.top]) if n else np.zeros(0, np.int64), pa.int64()),
            "score": pa.array(np.concatenate([s for s, _ in self.top]) if n else np.zeros(0, np.int64), pa.int64()),
        })


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, head: int = 16, seed_rows: int = 2048, query_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """The k largest integer inner products of each query over all vectors but those of its own id.

    Both tables have (id long, vec array<long>). The rotation comes from the Gram matrix of all
    rows (one d x d sum). Vectors are range-partitioned by descending length and packed into blocks
    of ``block_rows``. The ``seed_rows`` longest vectors give each query a first floor, and so the
    least length that a candidate needs (its reach); queries are packed by reach into blocks of
    ``query_rows``. The join drops a pair of blocks whose lengths cannot reach; within a pair a vector
    is skipped when the rotated partial sum of ``head`` dimensions plus the Cauchy-Schwarz bound on
    the rest is under the floor. What remains is multiplied exactly. Every task sends at most k rows a
    query on. Candidate blocks are dealt to a fixed number of salts and never copied; query blocks are
    copied to every salt and streamed past its candidates, one block's state at a time. Neither side
    is broadcast or collected, but for the seeds.

    Null ids or null vectors take no part; shorter vectors count as filled up with zeros. Ties go to
    the smaller id. Vectors that repeat an id count as rows of their own; a query that is repeated
    whole counts once, the answers of several vectors under one query id are ranked together. No
    queries or no candidates: no rows. Other columns are ignored. Products must fit 63 bits.

    Returns query_id long, rank int (from 1), vec_id long, score long.
    """
    spark = vectors.sparkSession
    prepare(spark)
    deal = shuffle_partitions(spark)
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    vecs = vectors.select("id", "vec").where("id is not null and vec is not null").withColumn("norm2", norm2)
    asked = queries.select("id", "vec").where("id is not null and vec is not null").distinct()

    sums = vecs.select("vec").mapInArrow(_gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    d = 1 + max((r["i"] for r in sums), default=-1)
    if d < 1 and vecs.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    gram = np.zeros((d, d))
    for r in sums:
        gram[r["i"], r["j"]] = r["g"]
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy() if d else np.zeros((0, 0))

    longest_first = [F.col("norm2").desc(), F.col("id")]
    seeds = vecs.orderBy(*longest_first).limit(seed_rows).select("id", "vec").toArrow()
    seed_ids = seeds.column("id").to_numpy().astype(np.int64)
    seed_mat = _wide(_matrix(seeds.column("vec")), d)

    blocks = vecs.repartitionByRange(deal, *longest_first).sortWithinPartitions(*longest_first).select("id", "vec").mapInArrow(_packed(block_rows, d), PACKED)
    # queries of like reach stand in one block, so that a block's least reach says much
    reaching = saved(asked.mapInArrow(_reaching(d, seed_ids, seed_mat, k), "id long, vec array<long>, floor double, reach double"), "reaching-queries")
    near = [F.col("reach"), F.col("id")]
    query_blocks = reaching.repartitionByRange(deal, *near).sortWithinPartitions(*near).mapInArrow(_query_blocks(query_rows, d), "qids binary, qmat binary, qfloor binary, qn int, reach double")
    # every salt has a share of the candidate blocks, longest first, and a copy of all query blocks; the
    # merge join streams the queries past the candidates of their salt, which it can spill. A pair of
    # blocks that length rules out does not leave the join
    share = F.pmod(F.xxhash64("ids"), F.lit(deal)).cast("int")
    dealt = blocks.withColumn("salt", share).repartition(deal, "salt").sortWithinPartitions("salt", F.col("norm").desc())
    asking = query_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))

    def search(batches):
        now, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["qids"], r["salt"]) != now:
                    if state is not None:
                        yield state.rows()
                    now = r["qids"], r["salt"]
                    ids, q = _unpacked(r["qids"], r["qmat"], r["qn"], d)
                    state = _Search(ids, q, np.frombuffer(r["qfloor"]), rotation, k, min(head, d))
                state.feed(*_unpacked(r["ids"], r["mat"], r["n"], d), r["norm"])
        if state is not None:
            yield state.rows()

    pairs = asking.hint("merge").join(dealt, "salt").where("norm >= reach")
    found = pairs.select("salt", "qids", "qmat", "qfloor", "qn", "ids", "mat", "n", "norm").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
