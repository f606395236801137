"""Exact substring deduplication: bytes under a repeated string of ``LENGTH`` bytes are removed, but for its first place.

1. *Segments.* Of every window of LENGTH bytes the leftmost smallest hash of its GRAM-byte strings is its anchor. Windows
   in a row with one anchor make a segment. Equal windows have equal anchors at equal places, so a window can only
   repeat in a segment filed under the same anchor hash; a text has about one segment in 40 bytes. Rows hold hashes
   and places, no texts.
2. *Copies.* Segments under one anchor come in order of content and place. Of segments that are equal to the byte (128
   bits of hashes), all but the first are repeats whole. Anchors that have several different segments stay open. Each task
   does this for its own segments first, so that a passage of many documents is one row a task; and where one task has
   FORMS different segments of an anchor, they stay open without meeting the other tasks' there (a mark of theirs does),
   so an anchor on the border of such a passage fills no task either.
3. *Suffix arrays.* The bytes of the open segments' first copies are dealt to shards by anchor; each shard sorts its
   suffixes by Larsson and Sadakane's refinement (groups that are still equal are split by the ranks one doubling
   ahead), gets common prefixes by Kasai's recurrence (all segments side by side in numpy) and finds the first place
   of each repeated window. An anchor with very many segments is spread over several shards; 128-bit hashes of their
   distinct windows, sorted, are merged by binary search, in buckets. The larger the input, the more anchors have many
   segments, so "very many" follows from a task's share of all segments, and a window is shipped as its hash and place.
4. *Removal.* Repeated windows go back to their documents, which lose the bytes under them.

Places are ordered by (doc_id, start): "earlier" means a smaller doc_id, or the same doc_id and a smaller start. Strings
are judged on the input; matches never cross documents.

Defined results: null text is the empty text; a null doc_id comes before all others; rows that repeat a doc_id and a
text are one document and get equal results; several texts under one doc_id are told apart by a checksum and compared
by start; texts shorter than LENGTH bytes keep everything; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import ROWS, cut, pack, release, unpack

LENGTH, GRAM = 100, 24
#: Bytes by which suffixes are ordered; a power of two, over LENGTH.
DEPTH = 128
#: Windows gone through at once in a long text (their places must fit 20 bits).
STRETCH = 1 << 19
#: Bytes of one suffix-array shard; segments of one anchor kept in one shard at least, and how many times that at most.
SHARD_BYTES, HOT, HOT_TIMES = 1_500_000, 512, 8
#: Rows that a task compares among themselves, and different segments of an anchor from which they stay open at once.
OWN_ROWS, FORMS = 1_500_000, 64
#: Kinds of rows: to be compared with other tasks'; a repeat; open; a mark that an anchor has open segments elsewhere.
FIRST_HERE, REPEAT, OPEN, MARK = range(4)
FIRST = -(2**63)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings (GRAM is 24: three words)."""
    words = np.lib.stride_tricks.sliding_window_view(b, 8)
    w = np.ascontiguousarray(words).view("<u8").ravel()
    n = len(b) - GRAM + 1
    h = w[:n] * _A
    h ^= h >> np.uint64(29)
    h += w[8 : 8 + n]
    h *= _B
    h ^= h >> np.uint64(32)
    h += w[16 : 16 + n]
    h *= _C
    h ^= h >> np.uint64(31)
    return h


def segments(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment of one text."""
    total, wide = len(b) - LENGTH + 1, LENGTH - GRAM + 1
    out = []
    for base in range(0, max(total, 0), STRETCH):
        part = b[base : min(base + STRETCH, total) + LENGTH - 1]
        h = gram_hashes(part)
        m = h & ~np.uint64(0xFFFFF) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            m, size = np.minimum(m[:-size], m[size:]), size * 2
        if wide > size:
            m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
        at = (m & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out.append((h[at[first]].view("<i8"), first + base, np.diff(np.append(first, len(at)))))
    if not out:
        return np.zeros(0, "<i8"), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*out))


def _source(docs: DataFrame, text: str) -> DataFrame:
    """o (place of the document in the order), text, t (checksum of the text)."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("o"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")) - 2**31).cast("int").alias("t"))


def _own_copies(rows: tuple[np.ndarray, ...], forms: int) -> Iterator[tuple[np.ndarray, ...]]:
    """v, c, o, t, lo, n of one task, sorted out: with a kind each. Rows that are not compared further are dealt by their place, not by anchor."""
    v, c, o, t, lo, n = rows
    # Equal segments side by side (by a mix of both hashes, the anchor beside it); those of several places in order.
    by = np.argsort(v * np.int64(-7046029254386353131) + c)
    v, c = v[by], c[by]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])
    several = np.flatnonzero(~(new & np.append(new[1:], True)))
    group = np.cumsum(new)[several]
    by[several] = by[several][np.lexsort((t[by[several]], lo[by[several]], o[by[several]], group))]
    o, t, lo, n = (x[by] for x in (o, t, lo, n))
    head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    again = (o != o[head]) | (lo != lo[head])  # other texts under the first one's doc_id stay
    anchors, anchor = np.unique(v, return_inverse=True)
    hot = np.bincount(anchor, new, len(anchors)) >= forms
    many = hot[anchor]
    kind = np.where(again, REPEAT, np.where(many, OPEN, FIRST_HERE)).astype(np.int8)
    anywhere = ((o + lo) * np.int64(-7046029254386353131)) ^ (lo << 17)
    yield np.where(kind == FIRST_HERE, v, anywhere), np.where(kind == OPEN, v, c), o, t, lo, n, kind
    marked = anchors[hot]
    nil = np.zeros(len(marked), "<i8")
    yield marked, nil + FIRST, nil, nil, nil, nil, np.full(len(marked), MARK, np.int8)


def _segment_rows(source: DataFrame) -> DataFrame:
    """v (anchor, or where a row is dealt), c (content, or the anchor of open rows), o, t, lo (first window), n (windows), kind."""
    forms, most = FORMS, OWN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        got, size = [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            for part in _own_copies(tuple(np.concatenate(x).astype("<i8") for x in zip(*got)), forms):
                for at in range(0, len(part[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in part], names=["v", "c", "o", "t", "lo", "n", "kind"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for o, text, t in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    raw = text.encode()
                    if len(raw) < LENGTH:
                        continue
                    v, lo, n = segments(np.frombuffer(raw, np.uint8))
                    view = memoryview(raw)
                    c = np.fromiter((xxh3_64_intdigest(view[a:z]) for a, z in zip(lo.tolist(), (lo + n + (LENGTH - 1)).tolist())), np.uint64, len(lo))
                    got.append((v, c.view("<i8"), np.full(len(v), o), np.full(len(v), t), lo, n))
                    size += len(v)
                if size > most:
                    yield from settle()
                    got, size = [], 0
        if got:
            yield from settle()

    return source.mapInArrow(run, "v long, c long, o long, t long, lo long, n long, kind byte").selectExpr("v", "c", "o", "cast(t as int) t", "cast(lo as int) lo", "cast(n as int) n", "kind")


def _copies(rows: DataFrame) -> DataFrame:
    """open, v, o, t, lo, n: repeats whole (open false), and the first copies of segments whose anchor has several (open true).

    Rows stream by in order of anchor, content and place; nothing is held but the last first copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False  # the last first copy, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            v, c, o, t, lo, n, kind = (x.to_numpy(zero_copy_only=False).astype("<i8") for x in batch.columns)
            done = (kind == REPEAT) | (kind == OPEN)
            if done.any():
                columns = (kind == OPEN, np.where(kind == OPEN, c, v), o, t.astype("<i4"), lo.astype("<i4"), n.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in columns], names=["open", "v", "o", "t", "lo", "n"])
                v, c, o, t, lo, n = (x[~done] for x in (v, c, o, t, lo, n))
            if not len(v):
                continue
            held = last is not None
            if held:
                v, c, o, t, lo, n = (np.concatenate([[a], x]) for a, x in zip(last, (v, c, o, t, lo, n)))
            same_v = np.concatenate([[False], v[1:] == v[:-1]])
            first = ~(same_v & np.concatenate([[False], c[1:] == c[:-1]]))
            # Rows with the place of the first copy: other texts under its doc_id are firsts too, repeated rows are left out.
            head = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
            tie = (o == o[head]) & (lo == lo[head])
            first |= tie & np.concatenate([[False], t[1:] != t[:-1]])
            f = np.flatnonzero(first)
            near = same_v[f] & (f > 0)  # a first copy after another segment of its anchor
            is_open = near.copy()
            is_open[:-1] |= near[1:]
            was_open = bool(is_open[-1])
            if held and told:
                is_open[0] = False
            out_open = f[is_open]
            again = np.flatnonzero(~first & ~tie)
            k = f[-1]
            # The last first copy goes on: it may be open because of what comes before or after.
            previous_told = told
            last = (v[k], c[k], o[k], t[k], lo[k], n[k])
            told = was_open or (held and previous_told and k == 0)
            # Marks are segments of no windows: they make their anchor's segments open and are not handed on.
            out_open, again = out_open[n[out_open] > 0], again[n[again] > 0]
            take = np.concatenate([out_open, again])
            if len(take):
                flags = np.zeros(len(take), bool)
                flags[: len(out_open)] = True
                yield pa.RecordBatch.from_arrays([pa.array(flags), *(pa.array(x[take].astype(k_)) for x, k_ in ((v, "<i8"), (o, "<i8"), (t, "<i4"), (lo, "<i4"), (n, "<i4")))], names=["open", "v", "o", "t", "lo", "n"])

    dealt = rows.repartition("v").sortWithinPartitions("v", "c", "o", "lo", "t")
    return dealt.mapInArrow(run, "open boolean, v long, o long, t int, lo int, n int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes ordered by at least their first 128 bytes, by Larsson and Sadakane's refinement."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype("<u8")
    sa = np.argsort(words)
    sorted_words = words[sa]
    start = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    h = 8
    while True:
        group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[sa] = group
        if h >= DEPTH:
            return sa
        lone = start & np.append(start[1:], True)
        todo = np.flatnonzero(~lone)
        if not len(todo):
            return sa
        ahead = rank[np.minimum(sa[todo] + h, n)]
        order = np.argsort(group[todo] * (n + 2) + ahead + 1)
        sa[todo] = sa[todo][order]
        g, a = group[todo], ahead[order]
        start[todo[1:]] |= (a[1:] != a[:-1]) & (g[1:] == g[:-1])
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int = DEPTH) -> np.ndarray:
    """For each place of ``sa`` the prefix shared with the place before, up to ``most``, by Kasai's recurrence.

    A suffix shares at most one byte less than the suffix one byte longer does, so each segment (from ``starts``) goes
    on from its last length; all segments take a step together. Suffixes are ordered by ``most`` bytes only, so where
    that many are shared the order says nothing about the next suffix, which begins anew.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ends = np.append(starts[1:], n)
    padded = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    shared = np.zeros(n, np.int64)
    lane, length = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    at = starts.copy()
    while len(lane):
        phi = before[at]
        now = np.maximum(length - 1, 0)
        now[(phi < 0) | (length >= most)] = 0
        go = np.flatnonzero((phi >= 0) & (now < most))
        while len(go):
            i, j, k = at[go], phi[go], now[go]
            k_ok = (np.maximum(i, j) + k < n) & (padded[i + k] == padded[j + k])
            go = go[k_ok]
            now[go] += 1
            go = go[now[go] < most]
        shared[at] = now
        at = at + 1
        alive = at < ends[lane]
        lane, at, length = lane[alive], at[alive], now[alive]
    return shared[sa]


def repeated_windows(parts: list[bytes], order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard in suffix order: segment, offset, number of the window's class, whether its first place is elsewhere.

    ``order`` and ``starts`` are each segment's document and first window; classes are equal windows.
    """
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, begin)
    segment = np.repeat(np.arange(len(parts)), sizes)[sa]
    offset = sa - begin[segment]
    classes = np.cumsum(shared < LENGTH)
    windows = offset <= sizes[segment] - LENGTH
    segment, offset, classes = segment[windows], offset[windows], classes[windows]
    o, s = order[segment], starts[segment] + offset
    by = np.lexsort((s, o))
    step = np.concatenate([[True], (o[by][1:] != o[by][:-1]) | (s[by][1:] != s[by][:-1])])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(step)
    new = np.concatenate([[True], classes[1:] != classes[:-1]])
    classes = np.cumsum(new) - 1
    first = np.minimum.reduceat(place, np.flatnonzero(new)) if len(place) else place
    return segment, offset, classes, place > first[classes] if len(place) else new[:0]


def _runs(o: np.ndarray, t: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as rows o, t, lo, n of windows in a row."""
    by = np.lexsort((lo, t, o))
    o, t, lo = o[by], t[by], lo[by]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (lo[1:] != lo[:-1] + 1)])
    f = np.flatnonzero(new)
    return o[f], t[f], lo[f], np.diff(np.append(f, len(o)))


_SHARD = pa.schema([("o", pa.int64()), ("t", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("v", pa.int64()), ("bucket", pa.int32()), ("windows", pa.binary())])
_SHARD_DDL = "o long, t int, lo int, n int, v long, bucket int, windows binary"


def _hot(n: int, parts: int) -> int:
    """Segments of one anchor kept in one shard: an eighth of a task's share of ``n``, within HOT and HOT_TIMES as many."""
    return min(max(HOT, n // (8 * parts)), HOT * HOT_TIMES)


def _shards(rows: DataFrame, hot: int) -> DataFrame:
    """Repeated windows (o, t, lo, n) of the open segments; of anchors over ``hot`` also distinct windows, packed and sorted by hash (v, bucket, windows)."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        v, salts, o, t, lo = (np.array([h[i] for h in held], "<i8") for i in range(5))
        parts = [h[5] for h in held]
        segment, offset, classes, repeat = repeated_windows(parts, o, lo)
        if repeat.any():
            s = segment[repeat]
            rows_ = _runs(o[s], t[s], lo[s] + offset[repeat])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(rows_, _SHARD)), *(pa.nulls(len(rows_[0]), f.type) for f in list(_SHARD)[4:])], schema=_SHARD)
        spread = np.flatnonzero((salts[segment] > 0) & ~repeat)
        for anchor in np.unique(v[segment[spread]]):
            mine = spread[v[segment[spread]] == anchor]
            # One of each class: places may tie where rows repeat a doc_id.
            mine = mine[np.unique(classes[mine], return_index=True)[1]]
            hashes = np.frombuffer(b"".join(xxh3_128_digest(parts[s][a : a + LENGTH]) for s, a in zip(segment[mine].tolist(), offset[mine].tolist())), ">u8").astype("<u8").reshape(-1, 2)
            by = np.lexsort((hashes[:, 1], hashes[:, 0]))
            hashes, mine = hashes[by], mine[by]
            n_buckets = np.uint64(salts[segment[mine[0]]])
            bucket = (hashes[:, 0] % n_buckets).astype(int)
            where = segment[mine]
            columns = (hashes[:, 0], hashes[:, 1], o[where], t[where].astype("<i4"), (lo[where] + offset[mine]).astype("<i4"))
            for b in np.unique(bucket):
                pick = np.flatnonzero(bucket == b)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(_SHARD)[:4]), pa.array([anchor], pa.int64()), pa.array([b], pa.int32()), pa.array([pack(*(x[pick] for x in columns))])], schema=_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for v, salt, salts, o, t, lo, part in zip(*(c.to_pylist() for c in batch.columns)):
                if (v, salt) != key and size >= SHARD_BYTES:
                    yield from settle(held)
                    held, size = [], 0
                key = (v, salt)
                held.append((v, salts, o, t, lo, part))
                size += len(part)
        if held:
            yield from settle(held)

    many = rows.groupBy("v").agg(F.count("*").alias("_n")).select("v", F.when(F.col("_n") > hot, F.ceil(F.col("_n") / hot)).otherwise(0).cast("int").alias("salts"))
    # Dealt out anew, so that the join's sides are plain exchanges and an anchor with many rows is split over tasks.
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.join(many, "v").withColumn("salt", F.when(F.col("salts") > 0, F.pmod(F.xxhash64("o", "t", "lo"), F.col("salts"))).otherwise(0).cast("int"))
    dealt = salted.select("v", "salt", "salts", "o", "t", "lo", "part").repartition("v", "salt").sortWithinPartitions("v", "salt")
    return dealt.mapInArrow(run, _SHARD_DDL)


def _merge(runs: DataFrame) -> DataFrame:
    """Windows (o, t, lo, n) of spread anchors that come earlier in another shard: sorted runs are merged by binary search."""

    def settle(held: list[bytes]) -> pa.RecordBatch | None:
        keys, places = np.zeros(0, "S16"), np.zeros((0, 3), np.int64)
        late = []
        for body in held:
            high, low, *at = unpack(body)
            new, at = np.stack([high, low], 1).astype(">u8").view("S16").ravel(), np.stack(at, 1).astype(np.int64)
            i = np.searchsorted(keys, new)
            hit = np.zeros(len(new), bool)
            inside = i < len(keys)
            hit[inside] = keys[i[inside]] == new[inside]
            old = places[i[hit]]
            mine = at[hit]
            later = (mine[:, 0] > old[:, 0]) | (mine[:, 0] == old[:, 0]) & (mine[:, 2] > old[:, 2])
            sooner = (mine[:, 0] < old[:, 0]) | (mine[:, 0] == old[:, 0]) & (mine[:, 2] < old[:, 2])
            late += [mine[later], old[sooner]]
            places[i[hit][sooner]] = mine[sooner]
            keys, places = np.insert(keys, i[~hit], new[~hit]), np.insert(places, i[~hit], at[~hit], axis=0)
        rows = np.concatenate(late) if late else np.zeros((0, 3), np.int64)
        if not len(rows):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_runs(*rows.T), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["o", "t", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for v, b, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (v, b) != key:
                    if held and (out := settle(held)):
                        yield out
                    key, held = (v, b), []
                held.append(body)
        if held and (out := settle(held)):
            yield out

    dealt = runs.filter("bucket IS NOT NULL").select("v", "bucket", "windows").repartition("v", "bucket").sortWithinPartitions("v", "bucket")
    return dealt.mapInArrow(run, "o long, t int, lo int, n int")


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """o, t, text and spans (array of (lo, n): repeated windows in a row) of every document."""
    spark, source = docs.sparkSession, _source(docs, text)
    found = cut(_copies(_segment_rows(source)), "segments")
    hot = _hot(found.filter("open").count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    release(spark)
    distinct = source.select("o", "t", "text")
    wanted = found.filter("open").groupBy("o", "t").agg(F.collect_list(F.struct("v", "lo", "n")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "o", "t", "lo", "part"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: tuple[list, ...] = ([], [], [], [], [])
                for o, t, body, want in zip(*(c.to_pylist() for c in part.columns)):
                    raw = body.encode()
                    for w in want:
                        for column, x in zip(out, (w["v"], o, t, w["lo"], raw[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    opened = distinct.join(wanted, ["o", "t"]).dropDuplicates(["o", "t"]).select("o", "t", "text", "want").mapInArrow(fetch, "v long, o long, t int, lo int, part binary")
    sharded = cut(_shards(opened, hot), "suffixes")
    del opened, wanted
    release(spark)
    spans = found.filter("NOT open").select("o", "t", "lo", "n").unionByName(sharded.filter("o IS NOT NULL").select("o", "t", "lo", "n")).unionByName(_merge(sharded))
    by_doc = spans.groupBy("o", "t").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return distinct.join(by_doc, ["o", "t"], "left").select("o", "t", "text", "spans")


def _removed(size: int, spans: list[dict] | None) -> np.ndarray:
    """Maximal removed runs (first byte, one past the last)."""
    if not spans:
        return np.zeros((0, 2), int)
    lo = np.array([s["lo"] for s in spans])
    hi = lo + np.array([s["n"] for s in spans]) + LENGTH - 1
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    f = np.flatnonzero(new)
    return np.stack([lo[f], hi[np.append(f[1:], len(lo)) - 1]], 1)


def removals(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256: a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        names = ["o", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256"]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out: tuple[list, ...] = tuple([] for _ in kinds)
                for o, body, spans in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    raw = body.encode()
                    gone = _removed(len(raw), spans)
                    digest, pos = hashlib.sha256(), 0
                    for a, z in gone.tolist():
                        digest.update(raw[pos:a])
                        pos = z
                    digest.update(raw[pos:])
                    for column, x in zip(out, (o, len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), gone[:, 0].tolist(), gone[:, 1].tolist(), digest.hexdigest())):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    done = repeated(docs, text).select("o", "text", "spans").mapInArrow(run, "o long, n_bytes long, n_removed long, n_spans long, starts array<int>, ends array<int>, kept_sha256 string")
    return done.select(F.when(F.col("o") != FIRST, F.col("o")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256")
