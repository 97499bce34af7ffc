"""Aho-Corasick automaton over vocabulary pieces, run over many strings in step."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np

#: Cells (strings x positions) worked on at a time.
CELLS = 1 << 20
#: A string of more bytes is walked by itself, byte by byte: few others would go in step with it.
LONG = 1 << 10
#: Strings, and values of them, that are remembered at a time.
REMEMBERED, VALUES = 1 << 17, 1 << 21


class Memory:
    """Results of strings by their 64-bit hash, kept from one piece of text to the next; emptied when full."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def fetch(self, h: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, flat): the values of different hashes. ``make`` gives (sizes, values) of those not known, by index."""
        if len(self.slot) > REMEMBERED or len(self.flat) > VALUES:
            self.clear()
        at = np.fromiter(map(self.slot.get, h.tolist(), repeat(-1)), np.int64, len(h))
        new = np.flatnonzero(at < 0)
        if len(new):
            size, flat = make(new)
            at[new] = len(self.size) + np.arange(len(new))
            self.slot.update(zip(h[new].tolist(), at[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        return self.begin[at], self.size[at], self.flat


class Automaton:
    """Complete transitions over byte classes, piece ids at states, and output links.

    ``link[s]`` is the state of the longest proper suffix of s that is a piece, or -1.
    """

    def __init__(self, pieces: list[bytes], ids: np.ndarray):
        used = sorted({b for p in pieces for b in p})
        self.classes = np.zeros(256, np.int64)  # 0: bytes in no piece
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for i, p in enumerate(pieces):
            s = 0
            for b in p:
                c = int(self.classes[b])
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    depth.append(depth[s] + 1)
                s = children[s][c]
            ends[s] = i
        n = len(children)
        edges = np.array([(s, c, t) for s, kids in enumerate(children) for c, t in kids.items()], np.int64).reshape(-1, 3)
        depths = np.array(depth)
        self.go = np.zeros((n, width), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece = np.full(n, -1, np.int32)
        self.length = np.zeros(n, np.int32)
        for s, i in ends.items():
            self.piece[s], self.length[s] = ids[i], len(pieces[i])
        self.link = np.full(n, -1, np.int32)
        fail = np.zeros(n, np.int64)
        level = depths[edges[:, 2]]
        for d in range(int(depths.max(initial=0)) + 1):
            here = np.flatnonzero(depths == d)
            if d:
                f = fail[here]
                self.go[here] = self.go[f]  # rows of lower depth are complete
                self.link[here] = np.where(self.piece[f] >= 0, f, self.link[f])
                self.link[here[f == 0]] = -1
            s, c, t = edges[level == d + 1].T
            if d:
                fail[t] = self.go[fail[s], c]
            self.go[s, c] = t
        #: ASCII bytes that are no piece by themselves.
        self.bare = np.ones(256, bool)
        self.bare[[p[0] for p in pieces if len(p) == 1]] = False
        self._lists = None

    def walk(self, text: bytes) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """For one string: (position, bytes of the character that ends there, pieces that end there as (length, id))."""
        if self._lists is None:
            self._lists = (memoryview(self.go.reshape(-1)), self.classes.tolist(), self.piece.tolist(), self.length.tolist(), self.link.tolist())
        go, classes, piece, length, link = self._lists
        width, state, whole, left = self.go.shape[1], 0, 0, 0
        for t, b in enumerate(text):
            state = go[state * width + classes[b]]
            if b < 0x80:
                whole, left = 1, 0
            elif b >= 0xC0:
                whole = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                left = whole - 1
            else:
                left -= 1
            node = state if piece[state] >= 0 else link[state]
            ends = []
            while node >= 0:
                ends.append((length[node], piece[node]))
                node = link[node]
            yield t, whole if left == 0 else 0, ends

    def steps(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For strings in order of falling length: (position, state, byte) of those that reach it."""
        state = np.zeros(len(starts), np.int32)
        reach = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")  # strings longer than t
        for t, m in enumerate(reach.tolist()):
            byte = data[starts[:m] + t]
            state = self.go[state[:m], self.classes[byte]]
            yield t, state, byte

    def outputs(self, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, state) for the pieces that end here, longest first, along the output links."""
        row = np.arange(len(state))
        node = np.where(self.piece[state] >= 0, state, self.link[state])
        while len(row := row[node >= 0]):
            node = node[node >= 0]
            yield row, node
            node = self.link[node]


def groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """(indices, whether they are ASCII) of strings up to LONG by falling length, so many at a time that the tables keep to CELLS cells."""
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    wide = high[starts + lengths] > high[starts]
    for plain in (True, False):
        some = np.flatnonzero((wide != plain) & (lengths <= LONG))
        order = some[np.argsort(-lengths[some], kind="stable")]
        at = 0
        while at < len(order):
            stop = min(len(order), at + max(1, CELLS // (int(lengths[order[at]]) + 1)))
            yield order[at:stop], plain
            at = stop


def char_sizes(byte: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Bytes of the character that ends with this byte, 0 inside one; ``run`` carries what is left to come."""
    lead = np.select([byte < 0x80, byte < 0xC0, byte < 0xE0, byte < 0xF0], [1, 0, 2, 3], 4)
    run[:, 0] = np.where(lead > 0, lead, run[:, 0])
    run[:, 1] = np.where(lead > 0, lead - 1, run[:, 1] - 1)
    return np.where(run[:, 1] == 0, run[:, 0], 0)


def best_paths(auto: Automaton, weight: np.ndarray, unknown: float, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over each string: (string, end position, piece id) of the best path's steps, in order.

    One pass: at each byte the output links give the pieces that end there, longest first, and the
    best score so far is relaxed; equal scores keep the longest last piece. A character that is no
    piece of its own may also be spelt by its bytes (piece id -1) at the score ``unknown``.
    """
    out = []
    for i in np.flatnonzero(lengths > LONG).tolist():
        ends, pieces = _best_path(auto, weight, unknown, data[starts[i] : starts[i] + lengths[i]].tobytes())
        out.append((np.full(len(ends), i), np.array(ends, np.int64), np.array(pieces, np.int32)))
    for some, plain in groups(data, starts, lengths):
        n, size = len(some), lengths[some]
        best = np.full((n, int(size.max(initial=0)) + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros(best.shape, np.int32)
        took = np.full(best.shape, -2, np.int32)
        run = np.zeros((n, 2), np.int64)
        for t, state, byte in auto.steps(data, starts[some], size):
            m = len(state)
            if plain:
                char, bare = None, auto.bare[byte]
            else:
                char = char_sizes(byte, run[:m])
                bare = char > 0
            for row, node in auto.outputs(state):
                length = auto.length[node]
                if not plain:
                    bare[row[length == char[row]]] = False
                score = best[row, t + 1 - length] + weight[auto.piece[node]]
                up = score > best[row, t + 1]
                row, node = row[up], node[up]
                best[row, t + 1], back[row, t + 1], took[row, t + 1] = score[up], auto.length[node], auto.piece[node]
            row = np.flatnonzero(bare)
            if not len(row):
                continue
            step = np.ones(len(row), np.int64) if plain else char[row]
            score = best[row, t + 1 - step] + unknown
            up = score > best[row, t + 1]
            row = row[up]
            best[row, t + 1], back[row, t + 1], took[row, t + 1] = score[up], step[up], -1
        row, at = np.arange(n), size.astype(np.int64)
        while len(row := row[at > 0]):
            at = at[at > 0]
            out.append((some[row], at, took[row, at]))
            at = at - back[row, at]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    who, end, piece = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((end, who))
    return who[order], end[order], piece[order]


def _best_path(auto: Automaton, weight: np.ndarray, unknown: float, text: bytes) -> tuple[list[int], list[int]]:
    """(end positions, piece ids) of one long string's best path, by the same rule."""
    weight = weight.tolist()
    best, back, took = [0.0], [0], [-2]
    for t, char, ends in auto.walk(text):
        top, step, what = -math.inf, 0, -2
        for length, piece in ends:
            if length == char:
                char = 0
            if (score := best[t + 1 - length] + weight[piece]) > top:
                top, step, what = score, length, piece
        if char and best[t + 1 - char] + unknown > top:
            top, step, what = best[t + 1 - char] + unknown, char, -1
        best.append(top)
        back.append(step)
        took.append(what)
    out, at = [], len(text)
    while at > 0:
        out.append(at)
        at -= back[at]
    out.reverse()
    return out, [took[e] for e in out]


def _marginal(auto: Automaton, weight: np.ndarray, byte_weight: np.ndarray, text: bytes) -> float:
    """Log of the summed probability of one long string's segmentations."""
    weight, byte_weight = weight.tolist(), byte_weight.tolist()
    alpha, spelt = [0.0], 0.0
    for t, char, ends in auto.walk(text):
        spelt = (spelt if text[t] & 0xC0 == 0x80 else 0.0) + byte_weight[text[t]]
        ways = [alpha[t + 1 - length] + weight[piece] for length, piece in ends]
        if char and all(length != char for length, _ in ends):
            ways.append(alpha[t + 1 - char] + spelt)
        top = max(ways, default=-math.inf)
        alpha.append(top if top == -math.inf else top + math.log(sum(math.exp(w - top) for w in ways)))
    return alpha[-1]


def marginals(auto: Automaton, weight: np.ndarray, byte_weight: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each string, by the forward recursion.

    ``weight`` has the pieces' log-probabilities, ``byte_weight`` those of the 256 byte pieces, which
    spell the characters that are no pieces of their own.
    """
    out = np.zeros(len(starts))
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = _marginal(auto, weight, byte_weight, data[starts[i] : starts[i] + lengths[i]].tobytes())
    for some, plain in groups(data, starts, lengths):
        n, size = len(some), lengths[some]
        alpha = np.full((n, int(size.max(initial=0)) + 1), -np.inf)
        alpha[:, 0] = 0
        run = np.zeros((n, 2), np.int64)
        spelt = np.zeros(n)
        for t, state, byte in auto.steps(data, starts[some], size):
            m = len(state)
            if plain:
                char, bare = None, auto.bare[byte]
            else:
                char = char_sizes(byte, run[:m])
                bare = char > 0
                spelt[:m] = np.where((byte & 0xC0) == 0x80, spelt[:m], 0) + byte_weight[byte]
            for row, node in auto.outputs(state):
                length = auto.length[node]
                if not plain:
                    bare[row[length == char[row]]] = False
                alpha[row, t + 1] = np.logaddexp(alpha[row, t + 1], alpha[row, t + 1 - length] + weight[auto.piece[node]])
            row = np.flatnonzero(bare)
            if len(row):
                step, cost = (1, byte_weight[byte[row]]) if plain else (char[row], spelt[row])
                alpha[row, t + 1] = np.logaddexp(alpha[row, t + 1], alpha[row, t + 1 - step] + cost)
        out[some] = alpha[np.arange(n), size]
    return out
