"""N-gram Jaccard join through token-combination prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.components import components
from maskloom.llm.copies import Distinct, filtered
from maskloom.llm.sketch import SCHEMA, add, bitmap, counted, merged, slots, width_for
from maskloom.llm.store import dropped, saved, shuffle_partitions

SIGNATURES = "key long, id long, n int, room int"
#: Sets below 2^SMALL shingles use single tokens of any class.
SMALL = 3


class Prefixes:
    """Signatures of shingle sets such that sets similar enough share one.

    Shingles are ordered from rare to frequent by (estimated count, hash). A rare one (estimate at
    most ``cut``) is a signature by itself. A frequent one is put into one of G subclasses by its
    hash, and every pair of one subclass is a signature. A set of n shingles may miss t = n -
    ceil(threshold * n) of them in a partner. Its prefix is extended until its rare shingles plus,
    for each subclass, its shingles less one, number t + 1: whichever t are missing, a rare shingle
    or a pair stays. Of two sets, the one whose prefix ends earlier has all that it shares within the
    other's prefix, so they meet. G follows the sets' length class (a power of two); a set also signs
    for the next class if its largest partner lies there. Any estimates give correct signatures, as
    long as they are the same everywhere; good ones keep groups small.
    """

    def __init__(self, num: int, den: int, cut: int):
        self.num, self.den, self.cut = num, den, cut

    def need(self, n):
        """t + 1."""
        return n - -(-self.num * n // self.den) + 1

    def classes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        log2 = lambda x: np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
        return log2(n), log2(n * self.den // self.num)

    def sign(self, h: np.ndarray, first: np.ndarray, estimate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, room); room is the largest overlap that a pair first met there can have."""
        n = np.diff(first)
        rank = (estimate.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
        order = np.empty(len(h), np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            order[a:b] = a + np.argsort(rank[a:b])
        h, frequent = h[order], estimate[order] > self.cut
        below = np.concatenate([[0], np.cumsum(~frequent)])
        rare = below[first[1:]] - below[first[:-1]]
        need = self.need(n)
        own, wider = self.classes(n)
        keys, docs, rooms = [], [], []
        for level, who in ((own, n > 0), (wider, (n > 0) & (wider != own))):
            take = np.where(who, np.minimum(need, np.where(level < SMALL, n, rare)), 0)
            doc = np.repeat(np.arange(len(n)), take)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
            keys.append(W.mix(h[first[doc] + at] + level[doc].astype(np.uint64) * W.GOLDEN))
            docs.append(doc)
            rooms.append(n[doc] - at)
            for d in np.flatnonzero(who & (level >= SMALL) & (rare < need)).tolist():
                pairs = self._pairs(h[first[d] + rare[d] : first[d + 1]], int(need[d] - rare[d]), int(level[d]))
                keys.append(pairs)
                docs.append(np.full(len(pairs), d))
                rooms.append(np.full(len(pairs), n[d] - rare[d]))
        return np.concatenate(keys), np.concatenate(docs), np.concatenate(rooms)

    def _pairs(self, h: np.ndarray, missing: int, level: int) -> np.ndarray:
        """Pair signatures of the shortest prefix of frequent shingles that gains ``missing``."""
        groups = max(1, self.need(1 << level) // 2)
        group = (W.mix(h) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        place = np.arange(len(h)) - np.searchsorted(group[by], group[by])
        nth = np.empty(len(h), np.int64)
        nth[by] = place
        gain = np.cumsum(nth > 0)
        end = int(np.searchsorted(gain, missing)) + 1
        out = []
        by = by[by < end]
        sorted_group = group[by]
        for gap in range(1, int(nth[:end].max(initial=0)) + 1):
            same = np.flatnonzero(sorted_group[gap:] == sorted_group[:-gap])
            a, b = h[by[same]], h[by[same + gap]]
            out.append(W.mix(a * np.uint64(0xD6E8FEB86659FD93) + W.mix(b + np.uint64(level * int(W.GOLDEN) % 2**64))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte: 15 steps a doubling."""
    return (15 * np.log2(1 + np.arange(1 << 16))).astype(np.uint8)[counts]


#: Bits of a set's parity image, and of the small one that goes into groups.
PARITY, SMALL_PARITY = 2048, 512


def _parities(h: np.ndarray, first: np.ndarray, bits: int) -> pa.Array:
    """For each set the parity of its hashes in so many cells, as 64-bit integers."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    odd = np.bincount(doc * bits + slots(h, bits, 5), minlength=(len(first) - 1) * bits) & 1
    return pa.array(list(np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)), pa.list_(pa.int64()))


def _leave_a_chance(n_a: str, n_b: str, image_a: str, image_b: str, num: int, den: int) -> Column:
    """Cells that differ are shingles not shared, at least; true if enough may still be shared."""
    apart = F.aggregate(F.zip_with(image_a, image_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col(n_a).cast("long") + F.col(n_b)
    return (total - apart) * (num + den) >= total * (2 * num)


def _may_be_similar(pairs: DataFrame, images: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose parity images leave them a chance."""
    left = images.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("image").alias("image_a"))
    right = images.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("image").alias("image_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_leave_a_chance("n_a", "n_b", "image_a", "image_b", num, den)).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    hub_rounds: int = 8,
    most_cells: int = 1 << 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_links: bool = False,
) -> DataFrame:
    """Components of the documents under "Jaccard of word shingles is num/den or more".

    A-Z are lower-cased; a document's set has its different ``shingle``-word runs, the whole sequence
    if it has fewer words. Two documents link when den * intersection >= num * union. Steps:

    1. copies of a whole text are set aside by digest; they take the component of the first;
    2. a merged count-min sketch of all shingles gives rarity (``Prefixes``); it has up to
       ``most_cells`` two-byte cells, of which one byte is sent on, and only steers cost;
    3. signatures are grouped exactly, and only those held twice are kept;
    4. every holder of a signature is compared with one hub, found by a pre-aggregated minimum; the
       links are closed into components. This is repeated with hubs of other components until the pairs
       of one signature that lie in different components are few (``FEW`` a holder) or a round has left
       more than half of them, at most ``hub_rounds`` times;
    5. these pairs are then all held against the bounds below, and what passes is compared. Members of
       a component are not compared again, so a group of n near copies costs about n comparisons, and
       yet no link between components is lost.

    Pairs are first held against bounds on size, on overlap left (``room``) and on the parity images of
    their sets, none of which can reject a similar pair; then their texts meet and shingles are counted
    exactly, by 64-bit hash. Large groups are spread by the adaptive skew join; no group is collected.

    With ``count_links`` the links inside components are counted too, of copies each. Components of two
    texts need no more work; small ones are counted whole, many in a task; of large ones, blocks of
    texts meet blocks and send on a count for each text, never a pair (``_with_links``).

    Null and empty texts and texts without words have an empty set and link with nothing. Rows that
    repeat an id are one document whose texts link. Rows with a null id have a null component and count
    no links. Very long texts are worked on whole. Other columns are ignored; an empty table gives an
    empty result.

    Returns id, n_shingles long, component_id (smallest id that links reach), one row for each input row;
    with ``count_links`` also n_links long, the number of other rows whose text links with the row's.
    """
    if not 0.5 <= num / den <= 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where("id is not null")
    unique = Distinct(named)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part, data, at in W.pieces(batch):
                words = W.split(data, at, lower=True)
                yield part, *W.distinct(*W.shingles(words.hashes(), words.first, shingle))

    size = unique.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = width_for(size // 4, 1 << 12, most_cells)

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, h, _ in grams(iter([batch])):
            add(table, slots(h, cells))

    counts = merged(unique.map(counted(cells, fill, np.uint16), SCHEMA), cells, np.uint16)
    prefixes = Prefixes(num, den, int(_ranks(np.array([max(32, 4 * int(counts.mean()))]))[0]))
    rarity = spark.sparkContext.broadcast(_ranks(counts))
    del counts

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, first in grams(batches):
            key, doc, room = prefixes.sign(h, first, rarity.value[slots(h, cells)])
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch({
                "key": pa.array(key.view(np.int64), pa.int64()),
                "id": pa.array(ids[doc], pa.int64()),
                "n": pa.array(np.diff(first)[doc].astype(np.int32), pa.int32()),
                "room": pa.array(room.astype(np.int32), pa.int32()),
            })

    signatures = unique.map(signed, SIGNATURES)  # made twice; writing them would cost more than that
    # aggregates are written before they are joined: a join straight on an aggregate's partitions could
    # not split a hot key
    shared = saved(signatures.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared-signatures")
    members = saved(signatures.join(shared.hint("shuffle_hash"), "key"), "members")
    dropped(shared)

    def picked(pairs: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn`` over the documents in ``pairs``, picked at the scan by a bitmap, and over a few others."""
        held = saved(pairs.select("a").union(pairs.select("b")).distinct(), "picked-ids")
        wanted = bitmap(held, "a", held.count())
        return saved(unique.map(lambda batches: fn(filtered(batches, wanted.value, "id", True)), schema), "picked")

    def images_of(pairs: DataFrame, bits: int) -> DataFrame:
        def imaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, h, first in grams(batches):
                yield pa.record_batch([part.column("id"), pa.array(np.diff(first).astype(np.int64)), _parities(h, first, bits)], ["id", "n", "image"])

        return picked(pairs, imaged, "id long, n long, image array<long>")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "text"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sides = [split_grams(part.column(c)) for c in ("text_a", "text_b")]
                for x, y in zip(*sides, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared * (num + den) >= (len(x) + len(y)) * num)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    def split_grams(column: pa.Array) -> list[np.ndarray]:
        words = W.split(*W.text_bytes(column), lower=True)
        h, first = W.distinct(*W.shingles(words.hashes(), words.first, shingle))
        return np.split(h, first[1:-1])

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough, counted exactly."""
        images = images_of(pairs, PARITY)
        likely = saved(_may_be_similar(pairs, images, num, den), "likely")
        whole = picked(likely, texts, "id long, text string")
        both = likely.join(whole.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(whole.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        found = saved(both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long").distinct(), "links-found")
        dropped(images, likely, whole)
        return found

    def fits(a: str, b: str):
        """Bounds on size and on overlap: pairs that fail cannot be similar, or meet elsewhere."""
        least, most = F.least(f"{a}.n", f"{b}.n").cast("long"), F.greatest(f"{a}.n", f"{b}.n").cast("long")
        return (most * num <= least * den) & (F.least(f"{a}.room", f"{b}.room").cast("long") * (num + den) >= (least + most) * num)

    # ids that repeat: what a set-aside copy of theirs equals is linked with their other texts
    again = saved(named.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    links = []
    if repeats := not again.isEmpty():
        worded = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
        same = unique.later().where(worded).join(again, "id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
        links.append(saved(same.distinct(), "links-of-copies"))

    def closed(links: list[DataFrame]) -> DataFrame:
        out = links[0]
        for more in links[1:]:
            out = out.union(more)
        return components(out)

    def labelled(labels: DataFrame) -> DataFrame:
        """The members of signatures that more than one component holds; those of two holders are settled by their hub."""
        with_label = members.where("held > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        split = with_label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return with_label.join(saved(split.select("key"), "open-signatures").hint("shuffle_hash"), "key")

    tried, labels, turn, before = [], None, 0, float("inf")
    while True:
        if labels is None:
            open_members = members.withColumn("label", F.col("id"))
        else:
            open_members = saved(labelled(labels), "open-members")
        last = turn >= hub_rounds
        if not last and turn > 0:
            left, holders = _pairs_left(open_members)
            last, before = left <= FEW * holders or 2 * left > before, left
        if not last:
            # the smallest id first, then any: signatures that share members mostly agree on who it is
            rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            hubs = open_members.groupBy("key").agg(F.min_by(F.struct("label", "id", "n", "room"), F.struct(rank, "n", "room")).alias("hub")).select("key", "hub.*")
            met = open_members.alias("x").join(saved(hubs, "hubs").alias("y").hint("shuffle_hash"), "key")
            met = met.where(F.expr("x.label <> y.label"))
        else:
            # small images go along, so that of a large group only the pairs with a chance leave the join
            small = images_of(open_members.select(F.col("id").alias("a"), F.col("id").alias("b")), SMALL_PARITY)
            seen = saved(open_members.join(small.drop("n"), "id"), "imaged-members")
            met = seen.alias("x").join(seen.alias("y"), "key").where(F.expr("x.label < y.label"))
            met = met.where(_leave_a_chance("x.n", "y.n", "x.image", "y.image", num, den))
        pairs = met.where(fits("x", "y")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        tried.append(pairs)
        links.append(similar(pairs))
        labels = closed(links)
        turn += 1
        if last:
            break

    sized = unique.map(lambda it: _sizes(grams(it)), "id long, key long, n_shingles long")
    reps = sized.join(labels, "id", "left")
    more = []
    if count_links:
        more = ["n_links"]
        if repeats:
            reps = reps.join(again.select("id", F.col("id").alias("own")), "id", "left").withColumn("label", F.coalesce("label", "own")).drop("own")
        reps = saved(reps, "representatives")
        held = unique.groups.select(F.col("first_id").alias("id"), "key", F.col("n").alias("held"))

        def sets_of(ids: Broadcast) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part, h, first in grams(filtered(batches, ids.value, "id", True)):
                    bodies = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    yield pa.record_batch([part.column("id"), part.column("key"), pa.array(bodies, pa.binary())], ["id", "key", "grams"])

            return unique.map(run, "id long, key long, grams binary")

        reps = _with_links(reps, held, sets_of, num, den, 1 if repeats else 2)
    reps = reps.select("id", "key", "n_shingles", F.coalesce("label", "id").alias("component_id"), *more)
    copies = unique.later().select("id", "first_id", "key")
    of = reps.select(F.col("id").alias("first_id"), "key", "n_shingles", "component_id", *more).dropDuplicates(["first_id", "key"])
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    copies = copies.join(of, ["first_id", "key"]).select("id", "n_shingles", own.alias("component_id"), *more)
    nameless = rows.where("id is null").select(F.lit(0).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("key"))
    nameless = nameless.mapInArrow(lambda it: _sizes(grams(it)), "id long, key long, n_shingles long")
    null = F.lit(None).cast("long")
    out = reps.drop("key").unionByName(copies).unionByName(nameless.select(null.alias("id"), "n_shingles", null.alias("component_id"), *[null.alias(c) for c in more]))
    return out.withColumnRenamed("id", id_col)


#: Pairs left for each holder of an open signature at which hub rounds end.
FEW = 8


def _pairs_left(open_members: DataFrame) -> tuple[float, int]:
    """(pairs of one signature with different labels, holders of these signatures)."""
    per_label = open_members.groupBy("key", "label").agg(F.count("*").cast("double").alias("n"))
    per_key = per_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    total = per_key.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
    return total["pairs"] or 0.0, int(total["n"] or 0)


#: Bounds of what is compared at once: texts and shingles of a block, and shingles of one matrix product.
TEXTS, SHINGLES, COLUMNS = 256, 1 << 16, 1 << 12


def _alike(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Matrix of which sets of ``a`` link with which of ``b``; overlaps are exact counts of shared hashes."""
    sides = []
    for sets in (a, b):
        size = np.array([len(x) for x in sets], np.int64)
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    overlap = np.zeros((len(a), len(b)))
    for at in range(0, len(shared), COLUMNS):
        some, held = shared[at : at + COLUMNS], []
        for h, row, size in sides:
            column = np.minimum(np.searchsorted(some, h), len(some) - 1)
            hit = some[column] == h
            table = np.zeros((len(size), len(some)), np.float32)
            table[row[hit], column[hit]] = 1
            held.append(table)
        overlap += held[0] @ held[1].T
    return overlap * (num + den) >= (sides[0][2][:, None] + sides[1][2][None, :]) * num


def _with_links(reps: DataFrame, held: DataFrame, sets_of: Callable[[Broadcast], DataFrame], num: int, den: int, settled: int) -> DataFrame:
    """``reps`` (id, key, n_shingles, label) with n_links. ``held``: (id, key, held) of texts that have copies.

    All links lie inside components. In one of ``settled`` texts or fewer everybody links with everybody.
    The sets of the others are dealt into cells: a cell has many small components, or one block of a
    large one, of about ``TEXTS`` texts and ``SHINGLES`` shingles. Blocks of a component meet pairwise,
    and each meeting sends on a sum for each text.
    """
    rows = reps.where("label is not null and n_shingles > 0").dropDuplicates(["id", "key"]).join(held, ["id", "key"], "left").withColumn("held", F.coalesce("held", F.lit(1)).cast("long"))
    rows = saved(rows.select("id", "key", "label", "held", "n_shingles"), "component-texts")
    blocks = F.ceil(F.greatest(F.col("texts") / TEXTS, F.col("shingles") / SHINGLES)).cast("int")
    sizes = rows.groupBy("label").agg(F.count("*").alias("texts"), F.sum("held").alias("total"), F.sum("n_shingles").alias("shingles"))
    sizes = saved(sizes.withColumn("blocks", blocks), "component-sizes")
    easy = rows.join(sizes.where(F.col("texts") <= settled), "label").select("id", "key", (F.col("total") - F.col("held")).alias("far"))
    open_sizes = sizes.where(F.col("texts") > settled)
    deal = max(shuffle_partitions(reps.sparkSession), int((open_sizes.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0) // SHINGLES) + 1)
    large = F.col("blocks") > 1
    cell = F.when(large, F.pmod(F.xxhash64("id", "key"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("label"), F.lit(deal)))
    todo = saved(rows.join(open_sizes, "label").select("id", "key", "label", "held", large.alias("large"), cell.cast("int").alias("cell")), "texts-to-count")
    wanted = bitmap(todo, "id", todo.count())
    placed = saved(sets_of(wanted).join(todo, ["id", "key"]).dropDuplicates(["id", "key"]), "placed-sets")

    def parts_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(ids, keys, held, sets) of each component in the table."""
        table = table.combine_chunks()
        label = table["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        bounds = np.flatnonzero(np.diff(label[order], prepend=label[order][:1] - 1, append=label[order][-1:] + 1))
        ids, keys, held = (table[c].to_numpy() for c in ("id", "key", "held"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = order[a:b]
            yield ids[at], keys[at], held[at], [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"].take(pa.array(at))]

    def counted_whole(table: pa.Table) -> pa.Table:
        out = []
        for ids, keys, held, sets in parts_of(table):
            links = _alike(sets, sets, num, den)
            np.fill_diagonal(links, False)
            out.append((ids, keys, links @ held))
        ids, keys, far = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "far": pa.array(far.astype(np.int64))})

    def packed(table: pa.Table) -> pa.Table:
        ((ids, keys, held, sets),) = parts_of(table)
        column = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
        return pa.table({
            "label": table["label"].slice(0, 1), "cell": table["cell"].slice(0, 1), "ids": column(ids, np.int64), "keys": column(keys, np.int64),
            "held": column(held, np.int64), "sizes": column([len(x) for x in sets], np.int64), "grams": column(np.concatenate(sets), np.uint64),
        })

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = ({c: np.frombuffer(batch.column(f"{c}_{side}")[r].as_buffer(), np.uint64 if c == "grams" else np.int64) for c in ("ids", "keys", "held", "sizes", "grams")} for side in "xy")
                links = _alike(*(np.split(z["grams"], np.cumsum(z["sizes"])[:-1]) for z in (x, y)), num, den)
                if batch.column("cell_x")[r].as_py() == batch.column("cell_y")[r].as_py():
                    np.fill_diagonal(links, False)
                    sums = [(x, links @ y["held"])]
                else:
                    sums = [(x, links @ y["held"]), (y, links.T @ x["held"])]
                for z, far in sums:
                    yield pa.record_batch([pa.array(z["ids"], pa.int64()), pa.array(z["keys"], pa.int64()), pa.array(far.astype(np.int64))], ["id", "key", "far"])

    schema = "id long, key long, far long"
    small = placed.where(~F.col("large")).groupBy("cell").applyInArrow(counted_whole, schema)
    columns = ("cell", "ids", "keys", "held", "sizes", "grams")
    full = placed.where("large").groupBy("label", "cell").applyInArrow(packed, "label long, cell int, ids binary, keys binary, held binary, sizes binary, grams binary")
    full = saved(full, "component-blocks")
    x, y = (full.select("label", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "xy")
    many = x.join(y, "label").where("cell_x <= cell_y").mapInArrow(met, schema)
    far = saved(easy.unionByName(small).unionByName(many).groupBy("id", "key").agg(F.sum("far").alias("far")), "links-counted")
    dropped(placed, full)
    out = reps.join(far, ["id", "key"], "left").join(held, ["id", "key"], "left")
    n = F.coalesce("far", F.lit(0)) + F.coalesce("held", F.lit(1)) - 1
    return out.select(*reps.columns, F.when(F.col("n_shingles") > 0, n).otherwise(0).cast("long").alias("n_links"))


def _sizes(parts: Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for part, _, first in parts:
        yield pa.record_batch([part.column("id"), part.column("key"), pa.array(np.diff(first).astype(np.int64))], ["id", "key", "n_shingles"])
