"""MinHash near-duplicates by a multi-index Hamming join.

1. *Sketch.* A document's set is its distinct shingles of ``SHINGLE`` words (64-bit hashes). Its signature has
   ``CHUNKS * SIZE`` MinHash symbols of 16 bits. Documents with one and the same set become one node.
2. *Multi-index.* Signatures are cut into chunks. Two signatures that differ in at most
   ``chunks * (ERRORS + 1) - 1`` symbols have, by pigeonhole, a chunk with at most ERRORS = 1 differing symbols; so each
   chunk is filed under every key that masks one of its symbols, and such a pair shares a key. The rule's percent decides
   the chunks' size (see ``layout``): sets just similar enough share no key with a chance of at most 3 in a million.
3. *Links.* Within a key each node is paired with the smallest node only. Of these pairs each node first tries the one
   with the closest signature, confirmed on full sets, and components are formed; and all pairs with close signatures
   make coarser clusters. A cluster that still holds several components is gone through in blocks: nodes of different
   components with close signatures are confirmed on full sets where they are, and only links leave the task. Nodes that
   share a key but no cluster are few; their close pairs become candidates. Pairs inside a component need no test, so
   groups of copies never become all their pairs, and no link between components is lost to a cap.
4. *Components* by alternating large-star and small-star steps; each step is a written table.

Nothing about documents is collected to the driver but counts and checksums.

Nodes are sets, not doc_ids: they are numbered in order of their smallest doc_id, so the smallest node of a component has
its smallest doc_id, and two texts under one doc_id are two nodes.

Defined results: null or empty text, or text of white space, has an empty set and no links; fewer words than a shingle
are one shingle of all words; repeated rows are exact copies; rows with a null doc_id cannot be named and stay
unlinked (component_id null, kept); if one doc_id has several texts, each row is linked by its own text, and
``keep_one`` drops the row, not the doc_id; a doc_id of a type other than an integer is a TypeError; a text of any length
is read whole; columns other than doc_id and the text are carried along by ``keep_one`` whatever their names, and left out
elsewhere; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import ROWS, cut, discard, map_lists

SHINGLE, PERCENT = 5, 85
CHUNKS, SIZE = 12, 8
_RNG = np.random.default_rng(20240607)
_ODD = lambda *shape: _RNG.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL, _XOR, _KEY, _MASK = _ODD(CHUNKS * SIZE), _ODD(CHUNKS * SIZE), _ODD(CHUNKS, SIZE), _ODD(CHUNKS, SIZE)
_PLACE = _ODD(64)
#: Chances for sets just similar enough: to share no key, and to be beyond the close or near limit.
MISS_KEY, MISS_NEAR = 3e-6, 1e-6
#: Rows of one block when a key or a cluster is gone through in blocks, and pairs of one leader checked together.
BLOCK, TEXT_BLOCK, SALT_ROWS = 2048, 512, 1024


@dataclass(frozen=True)
class Rule:
    """Documents are linked if 100 * shared shingles >= percent * all shingles of the two."""

    shingle: int = SHINGLE
    percent: int = PERCENT


@dataclass(frozen=True)
class Layout:
    """Symbols of a chunk, and the differing symbols (of CHUNKS * SIZE) up to which pairs are looked at.

    ``close``: differing 2-bit symbols up to which a pair that only shares a key is confirmed on full sets. ``near``:
    differing symbols up to which a pair of a cluster is confirmed. ``wide``: those up to which stars make clusters; pairs
    beyond it are not lost, as they share a key across clusters.
    """

    size: int
    close: int
    near: int
    wide: int


def _beyond(chance: float, limit: int, n: int) -> float:
    """Chance of more than ``limit`` of ``n`` symbols to differ if each does with ``chance``."""
    return math.fsum(math.comb(n, k) * chance**k * (1 - chance) ** (n - k) for k in range(limit + 1, n + 1))


def layout(percent: int) -> Layout:
    """The largest chunks and smallest limits that lose at most MISS_KEY and MISS_NEAR of the pairs at ``percent``."""
    n, differ = CHUNKS * SIZE, 1 - percent / 100
    sizes = (k for k in range(min(n // 2, SIZE), 1, -1) if n % k == 0 and _beyond(differ, 1, k) ** (n // k) <= MISS_KEY)
    size = next(sizes, None)
    if size is None:
        raise ValueError(f"no chunks of {n} symbols find pairs of {percent} percent")
    near, close = (next(k for k in range(n + 1) if _beyond(x, k, n) <= MISS_NEAR) for x in (differ, 0.75 * differ))
    return Layout(size, close, near, near + 7)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in UTF-8: white space and letters of bytes are just those."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers word hashes within bounds."""

    def __init__(self, rule: Rule, memory: int = 300_000):
        from xxhash import xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, w: bytes) -> int:
                if len(self) >= memory:
                    self.clear()
                h = self[w] = xxh3_64_intdigest(w)
                return h

        self.rule, self.words = rule, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        w = np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))
        k = min(self.rule.shingle, len(w))
        if not k:
            return w
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h += mix(w[j : j + len(h)] + _PLACE[j % 64]) * _PLACE[(j + k) % 64]
        return np.unique(mix(h + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS * SIZE MinHash symbols of 16 bits."""
    low = np.full(CHUNKS * SIZE, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        np.minimum(low, ((shingles[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2")


def chunk_keys(signatures: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each signature (a row) its CHUNKS * SIZE keys, each without one symbol of one chunk of ``size``."""
    s = signatures.reshape(-1, CHUNKS * SIZE // size, size).astype(np.uint64) + np.uint64(1)
    terms = s * _KEY.reshape(-1, size)
    return mix(terms.sum(2, keepdims=True, dtype=np.uint64) - terms + _MASK.reshape(-1, size)).reshape(len(s), -1)


def two_bits(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each symbol as three 64-bit words a row: low bits of 96 symbols, then high bits."""
    bits = np.concatenate([signatures & 1, signatures >> 1 & 1], 1).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def sketches(docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    """doc_id, t (hash of the text), s1, s2 (128-bit hash of the set), n_shingles, signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        from xxhash import xxh3_128_digest

        shingler = Shingler(rule)

        def fn(ids, hashes, texts):
            keys, n, sig = [], [], []
            for t in texts:
                s = shingler(t)
                keys.append(np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8"))
                n.append(len(s))
                sig.append(signature(s).tobytes())
            return ids, hashes, [int(k[0]) for k in keys], [int(k[1]) for k in keys], n, sig

        return fn

    body = F.col(f"`{text}`")
    return map_lists(docs.select("doc_id", F.xxhash64(body).alias("t"), body.alias("text")), make, f"doc_id {kind}, t long, s1 long, s2 long, n_shingles long, sig binary")


def _keys(nodes: DataFrame, size: int) -> DataFrame:
    """key, node: every node under all its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)
            keys = chunk_keys(sig, size)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("<i8")), pa.array(ids, pa.int64())], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Groups of rows with equal values in the first ``columns`` (integer) columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is not None and tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for c in cuts:
            if c > at:
                held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def members(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """key, leader, node of keys with two nodes or more. Rows stream by in key order: a large key needs no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, told = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            leader = np.where(start >= 0, n[np.maximum(start, 0)], first if first is not None else 0)
            out = ~new  # all but the first of each key; the first joins when the second comes
            lone = np.concatenate([new[:-1] & ~new[1:], [False]])
            take = out | lone
            parts = [(k[take], leader[take], n[take])]
            if key is not None and not told and not new[0]:
                parts.insert(0, (np.array([key]), np.array([first]), np.array([first])))
            told = bool((not new[-1]) or False)
            key, first = k[-1], leader[-1]
            ks, ls, ns = (np.concatenate(x) for x in zip(*parts))
            if len(ks):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ks, ls, ns)], names=["key", "leader", "node"])

    return _keys(nodes, size).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, leader long, node long")


def _stars(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """a, b, d: the pairs with their number of differing symbols; pairs of very unequal sizes are left out."""
    slim = nodes.select("node", "sig", "n")
    both = pairs.join(slim.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(slim.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x != y).sum(1), pa.int64())], names=["a", "b", "d"])

    return both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, d long")


def _closest(stars: DataFrame) -> DataFrame:
    """a, b: for each b the a whose signature is closest (then the smaller a)."""
    return stars.groupBy("b").agg(F.min(F.struct("d", "a"))["a"].alias("a")).select("a", "b")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) < len(y):
        x, y = y, x
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(y) else 0


def _within(nodes: DataFrame, clusters: DataFrame, labels: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """a, b: links between different components of one cluster, confirmed block against block."""
    all_ = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()).select("node", F.col("component").alias("cluster"))
    own = labels.select("node", F.col("component").alias("c"))
    placed = cut(all_.join(own, "node", "left").select("cluster", "node", F.coalesce("c", "node").alias("c")), "clusters")
    open_ = placed.groupBy("cluster").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("cluster", F.ceil(F.col("k") / TEXT_BLOCK).cast("int").alias("nb"))
    rows = placed.join(open_, "cluster").join(nodes.select("node", "sig"), "node").join(texts, "node")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("cluster", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "c", "sig", "text")
    percent, near = rule.percent, layout(rule.percent).near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule)
        for g in _groups((p for b in batches for p in (b.slice(at, 1024) for at in range(0, b.num_rows, 1024))), 3):
            lo, hi, i, node, c = (g.column(k).to_numpy() for k in range(1, 6))
            sig = np.frombuffer(b"".join(g.column(6).to_pylist()), "<u2").reshape(len(node), -1)
            sets: dict[int, np.ndarray] = {}
            top = {x: x for x in c.tolist()}

            def root(x: int, top=top) -> int:
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            def of(k: int, sets=sets, g=g) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingler(g.column(7)[k].as_py())
                return sets[k]

            one = i == lo[0]
            left = np.flatnonzero(one)
            right = left if lo[0] == hi[0] else np.flatnonzero(~one)
            links = []
            for p in left.tolist():
                q = right[right > p] if lo[0] == hi[0] else right
                q = q[c[q] != c[p]]
                if not len(q):
                    continue
                d = (sig[q] != sig[p]).sum(1)
                for k in q[d <= near][np.argsort(d[d <= near], kind="stable")].tolist():
                    x, y = root(int(c[p])), root(int(c[k]))
                    if x == y:
                        continue
                    m, n = of(p), of(k)
                    if 100 * min(len(m), len(n)) < percent * max(len(m), len(n)):
                        continue
                    common = _shared(m, n)
                    if 100 * common >= percent * (len(m) + len(n) - common):
                        top[max(x, y)] = min(x, y)
                        links.append((int(node[p]), int(node[k])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A leader with many pairs is dealt out over salts."""
    many = pairs.groupBy("a").agg(F.count("*").alias("_n")).withColumn("_salts", F.ceil(F.col("_n") / SALT_ROWS).cast("int"))
    left = many.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int").alias("salt"), "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    percent = rule.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, sets = Shingler(rule), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, got = batch.slice(at, ROWS), []
                for a, salt, b, t in zip(*(c.to_pylist() for c in part.columns)):
                    s = shingler(t)
                    if (a, salt) != now:
                        now, sets = (a, salt), []
                    if b is None:
                        sets.append(s)
                        continue
                    for x in sets:
                        common = _shared(x, s)
                        if 100 * common >= percent * (len(x) + len(s) - common):
                            got.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable), of all nodes with links other than the smallest of each component.

    Smallest neighbours are dealt out anew before they are joined, so that the join's sides are plain exchanges: a hub's
    edges are then split over tasks by adaptive execution.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(parts)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, edges = edges, cut(small, "edges")
        discard(before)
        now = state(edges)
        if now == was:
            break
        was = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.cut_path = edges.cut_path
    return out


def _across(held: DataFrame, nodes: DataFrame, labels: DataFrame, close: int) -> DataFrame:
    """a < b: pairs that share a key, lie in different clusters and have close signatures."""
    labelled = held.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    labelled = cut(labelled, "labelled")
    open_ = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w, pa.int64()) for w in two_bits(sig).view("<i8").T)], names=["node", "x", "y", "z"])

    small = nodes.select("node", "sig").mapInArrow(slim, "node long, x long, y long, z long")
    rows = labelled.join(open_, "key").join(small, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "c", "x", "y", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            lo, hi, i, node, c = (g.column(k).to_numpy() for k in range(1, 6))
            low, high = _bits(g)
            one = i == lo[0]
            left = np.flatnonzero(one)
            right = left if lo[0] == hi[0] else np.flatnonzero(~one)
            for p in left:
                q = right[right > p] if lo[0] == hi[0] else right
                q = q[c[q] != c[p]]
                if len(q):
                    d = np.bitwise_count((low[q] ^ low[p]) | (high[q] ^ high[p])).sum(1)
                    q = q[d <= close]
                if len(q):
                    a, b = np.minimum(node[q], node[p]), np.maximum(node[q], node[p])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _bits(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bits of the 96 symbols, 12 bytes each a row, from the three words."""
    words = np.ascontiguousarray(np.stack([g.column(k).to_numpy() for k in (6, 7, 8)], 1)).view(np.uint8)
    return words[:, :12], words[:, 12:]


def _labelled(docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, chosen (whether doc_id and text are the component's own)."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    limits = layout(rule.percent)
    sketched = cut(sketches(docs, text, rule), "sketches")
    named = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = named.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "t")).alias("row"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")).select("row.doc_id", "row.t", "s1", "s2", "n", "sig")
    order = ["doc_id", "s1", "s2"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut(sets.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = cut(members(nodes, limits.size), "members")
    pairs = held.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    wanted = held.select("node").distinct().join(nodes.select("node", "doc_id", "t"), "node")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    texts = cut(source.join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("node", "text"), "texts")
    stars = cut(_stars(pairs, nodes, min(50, rule.percent)), "stars")
    links = cut(confirmed(_closest(stars), texts, rule), "links")
    labels, clusters = components(links), components(stars.filter(F.col("d") <= limits.wide))
    inside = cut(_within(nodes, clusters, labels, texts, rule), "links")
    across = cut(confirmed(_across(held, nodes, clusters, limits.close), texts, rule), "links")
    old, labels = labels, components(links.unionByName(inside).unionByName(across))
    discard(held, texts, stars, links, inside, across, old, clusters)  # the labels stand on their own
    first = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"), F.col("t").alias("component_t"))
    placed = nodes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    found = placed.join(first, "component").drop("component")
    done = sketched.join(found, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    chosen = F.col("doc_id").isNull() | (F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id")) & (F.col("t") == F.col("component_t"))
    return done.select("doc_id", "t", "n_shingles", own.alias("component_id"), chosen.alias("chosen"))


def near_duplicates(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id): a row for each row of ``docs``."""
    found = _labelled(docs, text, rule)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows that stay, one text of each component, with all columns; rows that repeat a kept doc_id and text all stay."""
    gone = _labelled(docs, text, rule).filter("NOT chosen").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.col(f"`{text}`")).alias("own_t"))
    return kept.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_t") == F.col("gone_t")), "left_anti").select("row.*")
