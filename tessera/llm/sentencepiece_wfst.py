"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines with explicit arcs:

* ``Normaliser``: the start's arc writes the dummy prefix; then one state, whose arcs read a character and write one (a
  space becomes the space mark, every other character itself);
* ``Pieces``: a tree of states with an arc a character; a state where a piece ends has an arc home that writes its id.
  Read from any place of the input at once (failure arcs, filled in lazily, make that deterministic), its state at a
  place names all pieces that end there, longest first;
* ``Fallback``: a loop at home that reads a character that is no piece and writes the ids of its UTF-8 bytes;
* ``Grammar``: weighs an arc home, given the piece before. In a unigram model that is minus the piece's score. In a BPE
  model scores are merge ranks, which do not add up along a path: an arc weighs nothing if merging the joint text of the
  two pieces gives just these two, else infinity. Pieces are what BPE gives exactly if all neighbours agree in this way, so
  one path is finite, and each place has one best last piece: one state a place is kept.

``Transducer.shortest_paths`` composes them with the input place by place and takes the shortest path in the tropical
semiring (min, +). Weights are not negative in a BPE model, so a path of weight zero ends the search at a place.

Where no piece holds a space mark after another character, no path crosses such a place, so the input falls into
runs that are solved by themselves; short runs are remembered, within bounds, for the life of a worker process.

Defined results: null text has no ids (as the empty text), and null ids decode to null, no ids to the empty text; every
row gives one row; decoding drops the one leading space that the dummy prefix stands for, writes U+FFFD for bytes that are
no UTF-8 and nothing for control ids; the space mark as an input character decodes to a space; a text of any length is
one row, solved run by run; columns other than doc_id and the text are left out, so none can clash; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memory, map_lists

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: The piece before the first one, and before and after a fallback.
HOME = -1
INFINITY = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            i, value, shift = i + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Normaliser:
    """Characters to the piece alphabet: the start's arc, and the one state's arcs. Characters without an arc are written as read."""

    def __init__(self, prefix: bool):
        self.start, self.arcs = MARK if prefix else "", {" ": MARK}

    def apply(self, text: str) -> str:
        for read, write in self.arcs.items():
            text = text.replace(read, write)
        return self.start + text


class Pieces:
    """The tree of pieces. ``arcs[state]`` maps a character to a state; ``longest[state]`` is the longest piece that ends there, ``shorter[piece]`` the next."""

    def __init__(self, pieces: dict[str, int], size: int):
        self.arcs, self.fail, self.longest = [{}], [0], [HOME]
        self.shorter, self.length = [HOME] * size, [0] * size
        depth = [0]
        for piece, i in pieces.items():
            self.length[i] = len(piece)
            state = 0
            for c in piece:
                found = self.arcs[state].get(c)
                if found is None:
                    found = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.fail.append(0)
                    self.longest.append(HOME)
                    depth.append(depth[state] + 1)
                state = found
            self.longest[state] = i
        self.own = [dict(a) for a in self.arcs]  # without what failure arcs add
        for state in sorted(range(len(self.arcs)), key=depth.__getitem__):
            for c, to in self.own[state].items():
                self.fail[to] = self.step(self.fail[state], c) if state else 0
                up = self.longest[self.fail[to]]
                if self.longest[to] == HOME:
                    self.longest[to] = up
                else:
                    self.shorter[self.longest[to]] = up

    def step(self, state: int, c: str) -> int:
        """The state after ``c``: its own arc, or that of the first failure state that has one (then remembered)."""
        at = state
        while True:
            to = self.own[at].get(c)
            if to is not None or not at:
                break
            at = self.fail[at]
        self.arcs[state][c] = to = to or 0
        return to


class Merges:
    """Which pieces merging by rank leaves side by side."""

    def __init__(self, score: dict[str, float]):
        self.score, self.steps = score, functools.cache(self._steps)

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The parts that merging leaves: the best-ranked neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))

    def _steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """A piece's own merges in order: rank, and the first and last part after it. None if they do not lead to the piece."""
        steps = [(INFINITY, piece[0], piece[-1])]
        return [*steps, (-INFINITY, piece, piece)] if self.merged(piece, steps) == [piece] else None

    def agree(self, u: str, v: str) -> bool:
        """Whether merging u + v gives [u, v]: both pieces' merges run in order of rank, and no merge across the border comes first."""
        left, right = self.steps(u), self.steps(v)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            across = self.score.get(left[i][2] + right[j][1], -INFINITY)
            a, b = left[i + 1][0], right[j + 1][0]
            if across > a and across >= b:
                return False
            if a == b == -INFINITY:
                return True
            if a >= b:
                i += 1
            else:
                j += 1


class Grammar(dict):
    """Weights of arcs, remembered within bounds: by (piece before + 1) * pieces + piece for BPE, by piece for unigram models."""

    def __init__(self, names: list[str], score: dict[str, float], bpe: bool, memory: int):
        super().__init__()
        self.names, self.score, self.merges, self.bpe, self.memory = names, score, Merges(score), bpe, memory

    def __missing__(self, key: int) -> float:
        before, piece = divmod(key, len(self.names))
        text = self.names[piece]
        if not self.bpe:
            weight = -self.score[text]
        elif before == 0:
            weight = 0.0 if self.merges.steps(text) else INFINITY
        else:
            weight = 0.0 if self.merges.agree(self.names[before - 1], text) else INFINITY
        if len(self) >= self.memory:
            self.clear()
        self[key] = weight
        return weight


class Transducer:
    """One compiled model file."""

    def __init__(self, path: str, memory: int = 400_000):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    p = dict(_fields(value))
                    self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or any(t == USER for *_, t in self.pieces):
            raise ValueError("only models with the identity normaliser and without user-defined pieces are compiled")
        self.bpe, self.prefix = trainer.get(3, UNIGRAM) == BPE, bool(normaliser.get(3, 1))
        self.id = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        score = {p: s for p, s, t in self.pieces if t == NORMAL}
        bytes_ = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        names = [p for p, *_ in self.pieces]
        self.normaliser, self.tree = Normaliser(self.prefix), Pieces(self.id, len(names))
        self.grammar = Grammar(names, score, self.bpe, 3 * memory)
        self.merges = self.grammar.merges
        #: The fallback's one weight, and what it writes for a character.
        self.floor = 0.0 if self.bpe else 10.0 - min(score.values(), default=0.0)
        self.fallback = (lambda c: [bytes_[b] for b in c.encode()]) if bytes_ else lambda c: [self.unknown]
        crossing = any(MARK in p.lstrip(MARK) for p in self.id)
        self.runs = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = Memory(lambda run: array("I", next(self.shortest_paths([run]))).tobytes(), memory)
        self.written = [p if t == NORMAL else " ⁇ " if t == UNKNOWN else "" for p, _, t in self.pieces]
        self.is_byte = np.array([t == BYTE for *_, t in self.pieces])

    def shortest_paths(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """For each text the ids that the best path through its composition writes.

        Texts are read from left to right, so what one shares with the text before it is composed once: give them sorted.
        """
        tree, weights, bpe, floor, n = self.tree, self.grammar, self.bpe, self.floor, len(self.pieces)
        arcs, longest, shorter, length, ids = tree.arcs, tree.longest, tree.shorter, tree.length, self.id
        weight, last, states, before = [0.0], [HOME], [0], ""
        for text in texts:
            end = 0
            for x, y in zip(text, before):
                if x != y:
                    break
                end += 1
            del weight[end + 1 :], last[end + 1 :], states[end + 1 :]
            before, state = text, states[end]
            for c in text[end:]:
                end += 1
                to = arcs[state].get(c)
                state = tree.step(state, c) if to is None else to
                best, by = INFINITY, HOME
                p = longest[state]
                while p >= 0:
                    start = end - length[p]
                    w = weight[start]
                    if w < best:
                        w += weights[(last[start] + 1) * n + p if bpe else p]
                        if w < best:
                            best, by = w, p
                            if not w:
                                break
                    p = shorter[p]
                if c not in ids and weight[end - 1] + floor < best:
                    best, by = weight[end - 1] + floor, HOME
                weight.append(best)
                last.append(by)
                states.append(state)
            out: list[int] = []
            while end:
                p = last[end]
                if p >= 0:
                    out.append(p)
                    end -= length[p]
                else:
                    end -= 1
                    more = self.fallback(text[end])
                    if more != [self.unknown] or not out or out[-1] != self.unknown:  # unknown characters in a row are one
                        out += more[::-1]
            out.reverse()
            yield out

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of some texts; runs that are not remembered are solved in order."""
        known = self.known
        runs = [self.runs.findall(self.normaliser.apply(t)) if t else [] for t in texts]
        new = sorted(r for r in set(chain.from_iterable(runs)) if len(r) <= known.LONGEST and r not in known and r not in known.elder)
        for run, path in zip(new, self.shortest_paths(new)):
            known.keep(run, array("I", path).tobytes())
        return [b"".join(map(known.__getitem__, r)) for r in runs]

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.packed([text])[0]).tolist()

    def decode(self, ids: list[int] | array | None) -> str | None:
        """The inverse machines' one path: bytes, pieces, then the normaliser's spaces."""
        if ids is None:
            return None
        written, pieces = self.written, self.pieces
        if not self.is_byte[ids].any() if len(ids) else True:
            text = "".join(map(written.__getitem__, ids))
            first = next((i for i in ids if written[i]), None)
            drop = self.prefix and first is not None and pieces[first][2] == NORMAL and text[0] == MARK
            return text[drop:].replace(MARK, " ")
        out, held, first = [], bytearray(), True
        for i in ids:
            piece, _, kind = pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
                first = False
            if written[i]:
                out.append(piece[1:] if first and self.prefix and kind == NORMAL and piece[0] == MARK else written[i])
                first = False
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


@functools.cache
def compiled(path: str) -> Transducer:
    """The machines of a model file, with what they remember: once a process."""
    return Transducer(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids."""

    def make():
        model = compiled(path)
        return lambda ids, texts: (ids, [array("I", p).tolist() for p in model.packed(texts)])

    return map_lists(docs.select("doc_id", F.col(f"`{text}`").alias("text")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id, text."""

    def make():
        model = compiled(path)
        return lambda names, rows: (names, [model.decode(r) for r in rows])

    return map_lists(encoded.select("doc_id", F.col(f"`{ids}`").alias("ids")), make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (ids as little-endian unsigned 32-bit), decoded_sha256, same (decoded = text; null as empty).

    One pass: ids are made, digested and decoded where they are; they never leave their task.
    """

    def make():
        model = compiled(path)

        def fn(names, texts):
            n, fallback, crc, sha, same = [], [], [], [], []
            for t, packed in zip(texts, model.packed(texts)):
                ids = array("I", packed)
                back = model.decode(ids)
                n.append(len(ids))
                fallback.append(int(model.is_byte[ids].sum()) if ids else 0)
                crc.append(zlib.crc32(packed))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (t or ""))
            return names, n, fallback, crc, sha, same

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(docs.select("doc_id", F.col(f"`{text}`").alias("text")), make, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, same boolean")
