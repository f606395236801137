"""Token ids in succinct binary shards: one wavelet matrix a shard.

Documents are put in doc_id order by range partitioning; each partition is encoded as it streams by and cut into
shards of about ``shard_tokens`` ids. A shard's file body is self-contained (little-endian):

    magic "TWM1" | int64: ids n, bits b, documents d, chunk bytes, compressed sizes ...   | zstd blocks
    blocks: doc_ids (JSON), document starts, per bit plane its zero count and rank samples, then its bits in chunks

Bit planes go from the highest bit down; each plane is stably partitioned by its bit before the next (a wavelet
matrix). A rank sample is kept for every 512 bits, so ``access``, ``count`` (occurrences of an id before a place)
and ``select`` (the k-th occurrence) read b ranks or selects and inflate only the chunks they touch.

Bodies are binary values of a Parquet table in the shared folder, one row a shard: Spark's committer writes them, so
a lost executor's shards are written again, and any store that Spark reaches will do.

Defined results: null text is the empty text (the end id alone); rows are ordered by (doc_id, hash of the text), nulls
first, so repeated rows and repeated doc_ids have defined places; doc_ids may be integers or strings (a table's own type
comes back from ``read_documents``); a text of any length is one document, whose shard may then be longer than
``shard_tokens``; columns other than doc_id and the text are left out, so none can clash; an empty table gives no shards.
"""

from __future__ import annotations

import functools
import io
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import ROWS, Memory, cut
from tessera.llm.token_counts import UNSURE, byte_letters

END = 2
SHARD_TOKENS = 1_000_000
CHUNK = 1 << 16  # bytes of a plane inflated at once
STEP = 512  # bits between rank samples
MEMORY = 600_000


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded memory of chunks (runs without white space).

    The word tokenizer drops white space and treats each run by itself, so a run's ids do not depend on its
    surroundings. Texts with special strings, or with characters that libraries may class differently, are encoded whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        info = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in info["added_tokens"]]
        self.hints = {re.match(r"[^A-Za-z]*", s)[0] for s in self.specials}  # what stands in front is alike in either case
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END + 1)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        model, stand_in = self.tokenizer.model, str.maketrans({chr(b): c for c, b in byte_letters().items()})
        find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        kind = "H" if self.kind.itemsize == 2 else "I"

        def merge(word: str) -> bytes:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(stand_in)
            return array(kind, [t.id for t in model.tokenize(letters)]).tobytes()

        words = Memory(merge, memory // 8)
        self.runs = Memory(lambda run: merge(run) if run.isalpha() else b"".join([words[w] for w in find(run)]), memory)

    def encode(self, text: str | None) -> bytes:
        """Packed ids, without an end id."""
        if not text:
            return b""
        if UNSURE.search(text) or any(h in text for h in self.hints) and any(s in text.lower() for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        text = text.lower()
        for stop in (", ", ". "):  # after a letter or digit it is a pre-token: set apart, runs that differ in it alone become one
            parts = text.split(stop)
            if all([p[-1:].isalnum() for p in parts[:-1]]):
                text = f" {stop}".join(parts)
        return b"".join(map(self.runs.__getitem__, text.split()))


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, with what it remembers: once a process."""
    return Encoder(path)


def _pack(block: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(block).tobytes())


def write_shard(doc_ids: list, ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """The file body of one shard. ``starts`` has a place for each document and, last, the number of ids."""
    blocks = [_pack(np.frombuffer(json.dumps(doc_ids).encode(), np.uint8)), _pack(starts.astype("<i8"))]
    v, planes = ids, []
    for k in range(bits - 1, -1, -1):
        bit = (v >> v.dtype.type(k)) & v.dtype.type(1) != 0
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-len(bit) // STEP) * STEP // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view("<u8")).reshape(-1, STEP // 64).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        planes.append((len(v) - int(ranks[-1]), ranks, packed))
        v = np.concatenate([np.compress(~bit, v), np.compress(bit, v)])
    for zeros, ranks, packed in planes:
        blocks += [_pack(np.array([zeros], "<i8")), _pack(ranks), *(_pack(packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))]
    head = np.array([len(ids), bits, len(doc_ids), CHUNK, len(blocks), *map(len, blocks)], "<i8")
    return b"TWM1" + head.tobytes() + b"".join(blocks)


class Shard:
    """Random access to one shard's body; blocks are inflated when they are first needed."""

    def __init__(self, body: bytes):
        if body[:4] != b"TWM1":
            raise ValueError("not a token shard")
        self.n, self.bits, self.n_docs, self.chunk, blocks = (int(x) for x in np.frombuffer(body, "<i8", 5, 4))
        sizes = np.frombuffer(body, "<i8", blocks, 44)
        self._at = 44 + 8 * blocks + np.concatenate([[0], np.cumsum(sizes)])
        self._body, self._open = memoryview(body), {}
        self._per = 2 + -(-(-(-self.n // 8)) // self.chunk)

    def _block(self, k: int, kind: str) -> np.ndarray:
        import zstandard

        if k not in self._open:
            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self._body[self._at[k] : self._at[k + 1]])), kind)
        return self._open[k]

    @property
    def doc_ids(self) -> list:
        return json.loads(self._block(0, "u1").tobytes())

    @property
    def starts(self) -> np.ndarray:
        return self._block(1, "<i8")

    def _zeros(self, plane: int) -> int:
        return int(self._block(2 + plane * self._per, "<i8")[0])

    def _bytes(self, plane: int, lo: int, hi: int) -> np.ndarray:
        """Bytes lo..hi of a plane."""
        first, last, base = lo // self.chunk, max(lo, hi - 1) // self.chunk, 4 + plane * self._per
        parts = [self._block(base + c, "u1") for c in range(first, last + 1)] if hi > lo else [np.zeros(0, np.uint8)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts))[lo - first * self.chunk : hi - first * self.chunk]

    def rank(self, plane: int, place: int) -> int:
        """Ones before ``place``."""
        step = place // STEP
        ones = int(self._block(3 + plane * self._per, "<u4")[step])
        lo = step * STEP // 8
        rest = self._bytes(plane, lo, min(-(-place // 8), -(-self.n // 8)))
        if len(rest):
            ones += int(np.unpackbits(rest, bitorder="little")[: place - step * STEP].sum())
        return ones

    def bit(self, plane: int, place: int) -> int:
        return int(self._bytes(plane, place // 8, place // 8 + 1)[0]) >> (place % 8) & 1

    def select(self, plane: int, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero, by binary search over ranks."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            before = self.rank(plane, mid)
            if (before if one else mid - before) <= k:
                lo = mid
            else:
                hi = mid
        return lo

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for p in range(self.bits):
            b, ones = self.bit(p, place), self.rank(p, place)
            value = value << 1 | b
            place = self._zeros(p) + ones if b else place - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """The token's run in the last order, for places before ``end``."""
        lo, hi = 0, end
        for p in range(self.bits):
            a, b = self.rank(p, lo), self.rank(p, hi)
            lo, hi = (self._zeros(p) + a, self._zeros(p) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before place ``end``."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo if token >> self.bits == 0 else 0

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - p) & 1)
            at = self.select(p, one, at - self._zeros(p) if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane's order is undone by its own bits."""
        kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        v = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._bytes(p, 0, -(-self.n // 8)), bitorder="little", count=self.n).view(bool)
            zeros, before = self._zeros(p), np.empty_like(v)
            before[np.flatnonzero(~bit)] = v[:zeros]
            before[np.flatnonzero(bit)] = v[zeros:] | kind.type(1 << (self.bits - 1 - p))
            v = before
        return v


SHARDS = "part int, first long, n_tokens long, n_docs long, body binary"


def write_shards(docs: DataFrame, path: str, text: str = "text", shard_tokens: int = SHARD_TOKENS, name: str = "shards") -> DataFrame:
    """Encode and write all documents; the shard table: part (range partition), first (ids of the part before the shard),
    n_tokens, n_docs, body. Partitions are dealt by ranges of (doc_id, text hash): many rows of one doc_id are split too."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select("doc_id", F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")

    def run(batches):
        from pyspark import TaskContext

        own = encoder(path)
        bits, part = max(1, int(own.size - 1).bit_length()), TaskContext.get().partitionId()
        end = np.array([END], own.kind).tobytes()
        doc_ids, bodies, held, first = [], [], 0, 0

        def shard():
            ids = np.frombuffer(b"".join(bodies), own.kind)
            starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]) // own.kind.itemsize
            body = write_shard(doc_ids, ids, starts, bits)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip((part, first, len(ids), len(doc_ids), body), kinds)], names=["part", "first", "n_tokens", "n_docs", "body"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    b = own.encode(t) + end
                    doc_ids.append(d)
                    bodies.append(b)
                    held += len(b) // own.kind.itemsize
                    if held >= shard_tokens:
                        yield shard()
                        first, doc_ids, bodies, held = first + held, [], [], 0
        if doc_ids:
            yield shard()

    return cut(dealt.mapInArrow(run, SHARDS), name)


def read_documents(shards: DataFrame, doc_id: str = "long") -> DataFrame:
    """doc_id (of the type named), start (ids of all documents before), n_tokens, ids_crc32, read back from the shards.

    Only one row a range partition goes through the window that adds up what lies before; partitions are as many as
    shuffle partitions, whatever the input.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("_before", F.lit(0)).alias("_before"))
    placed = shards.join(F.broadcast(before), "part").select((F.col("first") + F.col("_before")).alias("start"), "body")
    schema = f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long"

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for start, body in zip(batch.column(0), batch.column(1)):
                shard = Shard(body.as_py())
                ids, at, base = shard.ids().astype("<u4"), shard.starts, start.as_py()
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, type=kinds.field(0).type), pa.array(at[:-1] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=kinds.names)

    return placed.mapInArrow(run, schema)


def export_shard(body: bytes, out: io.BufferedIOBase) -> None:
    """Write one shard's body as a file of its own."""
    out.write(body)
