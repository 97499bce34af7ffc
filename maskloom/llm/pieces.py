"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.automaton import Automaton, Memory, best_paths
from maskloom.llm.store import prepare

SPACE = "▁".encode()
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes encoded at a time.
CHUNK = 1 << 18
#: What an unknown character scores below the lowest piece (a fixed value of the format).
PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model, as bytes in which the word mark is a plain space."""

    body: list[bytes]
    score: np.ndarray
    normal: np.ndarray
    bytes_at: np.ndarray  # id of each byte piece
    _auto: Automaton | None = field(default=None, repr=False)
    _memory: Memory | None = field(default=None, repr=False)
    _flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_auto": None, "_memory": None, "_flat": None}

    @property
    def bodies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, starts, bytes) of all pieces."""
        if self._flat is None:
            size = np.array([len(b) for b in self.body], np.int64)
            self._flat = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.body), np.uint8)
        return self._flat

    def memory(self, kind: type) -> Memory:
        """What this process remembers of strings that it has met under this vocabulary."""
        if self._memory is None:
            self._memory = Memory(kind)
        return self._memory

    @property
    def automaton(self) -> Automaton:
        if self._auto is None:
            ids = np.flatnonzero(self.normal)
            self._auto = Automaton([self.body[i] for i in ids], ids)
            W.give_back()  # what building it took
        return self._auto

    @property
    def unknown(self) -> float:
        return float(self.score[self.normal].min() - PENALTY)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver. It must have byte pieces; the normaliser is taken as identity."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    body, normal, bytes_at = [], np.zeros(size, bool), np.full(256, -1, np.int32)
    score = np.array([sp.get_score(i) for i in range(size)])
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[1:-1], 16)
            bytes_at[value] = i
            body.append(bytes([value]))
            continue
        body.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.encode().replace(SPACE, b" "))
        normal[i] = bool(body[-1]) and not sp.is_unused(i)
    if (bytes_at < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    return Vocabulary(body, score, normal, bytes_at)


def shared_vocabulary(spark: SparkSession, path: str = MODEL) -> Broadcast:
    """The vocabulary on all executors. Its size is the model file's, whatever the data; only the driver opens it."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _breaks(vocab: Vocabulary) -> tuple[np.ndarray, bool]:
    """Bytes that stand in no piece, and whether a space can only open a piece: where strings may be cut."""
    bodies = [b for b, ok in zip(vocab.body, vocab.normal, strict=True) if ok]
    alone = np.ones(256, bool)
    alone[sorted({b for p in bodies for b in p})] = False
    alone[0x80:] = False
    return alone, not any(b" " in p.lstrip(b" ") for p in bodies)


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.alone, self.opens = _breaks(vocab)

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with a space before each text, unit starts, unit ends, first unit of each text).

        No piece spans two units, so each unit's best path is part of the text's best path.
        """
        full = np.diff(at) > 0
        data = np.insert(data, at[:-1][full], 0x20)
        at = at + np.concatenate([[0], np.cumsum(full)])
        start = np.zeros(len(data) + 1, bool)
        start[at] = True
        if self.opens:
            space = data == 0x20
            start[1:-1] |= space[1:] & ~space[:-1]
        alone = self.alone[data]
        start[:-1] |= alone
        start[1:] |= alone
        edges = np.flatnonzero(start)
        return data, edges[:-1], edges[1:], np.searchsorted(edges, at)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text)."""
        vocab = self.vocab
        data, starts, ends, first = self.units(data, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        h = W.Words(data, starts, ends, first).hashes()
        h, where, which = np.unique(h, return_index=True, return_inverse=True)
        begin, size, flat = vocab.memory(np.int32).fetch(h, lambda new: self._paths(data, starts[where[new]], ends[where[new]]))
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], n)]
        return ids, total[first]

    def _paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of the best path of each unit."""
        vocab = self.vocab
        who, end, piece = best_paths(vocab.automaton, vocab.score, vocab.unknown, data, starts, ends - starts)
        if (piece < 0).any():  # characters spelt by bytes
            begin = np.zeros(len(end), np.int64)
            begin[1:] = np.where(who[1:] == who[:-1], end[:-1], 0)
            n = np.where(piece < 0, end - begin, 1)
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            spelt = vocab.bytes_at[data[np.minimum(starts[who[row]] + begin[row] + nth, len(data) - 1)]]
            piece, who = np.where(piece[row] < 0, spelt, piece[row]), who[row]
        return np.bincount(who, minlength=len(starts)), piece.astype(np.int32)


def decode(vocab: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by text) of ids; the space before each text is taken off."""
    size, begin, flat = vocab.bodies
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    data = flat[np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], n)]
    bounds = total[at]
    opens = bounds[:-1][bounds[1:] > bounds[:-1]]
    opens = opens[data[opens] == 0x20]
    cut = np.zeros(len(data) + 1, np.int64)
    cut[opens + 1] = 1
    return np.delete(data, opens), bounds - np.cumsum(cut)[bounds]


def encode_texts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of every whole text, and whether decoding them gives the text back.

    The best-scoring segmentation under the model's piece scores: one pass over the bytes of each
    different unit (a run between breaks that no piece spans) relaxes best scores along the output
    links of an Aho-Corasick automaton. A space is put before each text; spaces are kept as they are;
    characters that are no pieces are spelt by byte pieces, a literal word mark among them, so that
    decoding is exact. A scan without shuffles; the vocabulary is broadcast (its size is the model's).

    Null and empty texts have no ids. Every row is kept, repeated ones too, and null ids stay null.
    Very long texts are encoded whole; a unit of over ``LONG`` bytes is walked byte by byte, in time
    linear in its length. What was found for a unit is remembered in the worker, up to a bound.
    Other columns are ignored; an empty table gives an empty result.

    Returns id, n_pieces long, pieces array<int>, round_trip boolean.
    """
    prepare(docs.sparkSession)
    vocab = shared_vocabulary(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for batch in batches:
            for part, data, at in W.pieces(batch, size=CHUNK):
                ids, to = encoder.encode(data, at)
                back, back_at = decode(vocab.value, ids, to)
                if np.array_equal(back, data) and np.array_equal(back_at, at):
                    same = np.ones(len(at) - 1, bool)
                else:
                    same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(back_at[:-1], back_at[1:], at[:-1], at[1:], strict=True)])
                yield pa.record_batch([
                    part.column("id"),
                    pa.array(np.diff(to).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids)),
                    pa.array(same),
                ], ["id", "n_pieces", "pieces", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(W.tidy(run), "id long, n_pieces long, pieces array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """The text of each list of piece ids: the inverse of ``encode_texts``. Null lists give empty texts."""
    prepare(encoded.sparkSession)
    vocab = shared_vocabulary(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            at = lists.offsets.to_numpy().astype(np.int64)
            data, to = decode(vocab.value, lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
            yield pa.record_batch([batch.column("id"), W.string_array(data, to)], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(pieces_col), F.array().cast("array<int>")).alias("pieces"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
