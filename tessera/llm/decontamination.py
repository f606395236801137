"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items go into one suffix automaton. Each document's words are streamed through it; the
state and the length of the longest match are tracked at every word. A window of ``window`` words that ends at a
word whose match is at least that long is in some item; items shorter than the window count as one window whole.
Words under any such window are hit. The items behind a hit come from the state's ancestor that stands for exactly
the window.

The automaton is broadcast in blocks: items are dealt to blocks of at most ``block_words`` words by a running sum,
so what is broadcast at once is bounded however long the benchmark is. Several blocks are several passes, merged by
document.

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Defined results: null or empty texts have no words and no hits; items without words are never found; repeated
items and documents are handled as often as they occur (an item_id counts once); a null item_id is left out of the
items found though its windows hit; an empty benchmark hits nothing; a text of any length is streamed whole; an empty table
of documents gives an empty table. Columns of the documents are carried along by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.llm.common import FOLD, ROWS, map_lists

WINDOW = 10
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(FOLD)) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; ``items`` are (item_id, words)."""

    def __init__(self, items: Iterable[tuple[object, list[str]]], window: int = WINDOW):
        self.window, self.ids = window, []
        self.number: dict[str, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        texts = []
        for item, words in items:
            if words:
                texts.append([self.number.setdefault(w, len(self.number) + 1) for w in words])
                self.ids.append(item)
        for t in texts:
            self._add(t)
        self._mark(texts)

    def _add(self, text: list[int]) -> None:
        """Blumer's online construction, started again at the root for each item."""
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(arcs)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, texts: list[list[int]]) -> None:
        """For each state its ancestor that holds windows; for such states the items; and the short items ending there."""
        n, w = len(self.length), self.window
        self.holder = [0] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.holder[s] = 0 if self.length[s] < w else s if self.length[up] < w else self.holder[up]
        self.items: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            s = 0
            for i, c in enumerate(t):
                s = self.next[s][c]
                if i + 1 >= w:
                    self.items.setdefault(self.holder[s], set()).add(k)
            if len(t) < w:
                short.setdefault(s, []).append((len(t), k))
        # Short items that are suffixes of a state's strings: its own and its ancestors'.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        if short:
            for s in sorted(range(1, n), key=self.length.__getitem__):
                self.short[s] = self.short[self.link[s]] + tuple(short.get(s, ()))

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(end, length, item index or -1 for windows of the state's items, as state) of windows that end at each word."""
        out = []
        number, nxt, link, length, holder, short, w = self.number, self.next, self.link, self.length, self.holder, self.short, self.window
        s = n = 0
        for i, c in enumerate(map(number.get, words)):
            if c is None:
                s = n = 0
                continue
            q = nxt[s].get(c)
            if q is None:
                while s and c not in nxt[s]:
                    s = link[s]
                n = length[s]
                q = nxt[s].get(c)
                if q is None:
                    s = n = 0
                    continue
            s, n = q, n + 1
            if n >= w:
                out.append((i, w, -1 - holder[s]))
            if short[s]:
                out.extend((i, size, k) for size, k in short[s] if size <= n)
        return out

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit spans (first word, one past the last) and the ids of the items found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        states = set()
        for end, size, k in sorted(self.matches(words), key=lambda x: x[0] - x[1]):
            (found if k >= 0 else states).add(k)
            lo, hi = end - size + 1, end + 1
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
            else:
                spans.append((lo, hi))
        for k in states:
            found |= self.items[-1 - k]
        return spans, {self.ids[k] for k in found}


def _blocks(benchmark: DataFrame, text: str, window: int, block_words: int):
    """Automata over at most ``block_words`` words each (a longer item has a block of its own)."""
    held, size = [], 0
    for row in benchmark.select("item_id", F.col(f"`{text}`").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if held and size + len(words) > block_words:
            yield SuffixAutomaton(held, window)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    yield SuffixAutomaton(held, window)


def hit_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, starts, ends (word places of the maximal hit spans, end exclusive), items: a row for each document."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    parts = []
    for automaton in _blocks(benchmark, text, window, block_words):
        shared = sc.broadcast(automaton)

        def make(shared=shared):
            a = shared.value

            def fn(ids, texts):
                n, lo, hi, items = [], [], [], []
                for t in texts:
                    words = words_of(t)
                    spans, found = a.scan(words)
                    n.append(len(words))
                    lo.append([x for x, _ in spans])
                    hi.append([x for _, x in spans])
                    items.append(sorted(str(x) for x in found if x is not None))
                return ids, texts, n, lo, hi, items

            return fn

        parts.append(map_lists(source, make, f"doc_id {kind}, text string, n_words long, starts array<int>, ends array<int>, items array<string>"))
    if len(parts) == 1:
        return parts[0]
    # Rows that repeat (doc_id, text) come from several blocks each: count them and give them back.
    union = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        union = union.unionByName(p.withColumn("_one", F.lit(0)))
    merged = union.groupBy("doc_id", "text").agg(F.sum("_one").cast("int").alias("_n"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def joined(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (x["starts"] <= last["ends"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate(F.array_sort("_spans"), F.array().cast("array<struct<starts:int,ends:int>>"), joined)
    merged = merged.withColumn("_spans", spans).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return merged.select("doc_id", "text", "n_words", F.col("_spans.starts").alias("starts"), F.col("_spans.ends").alias("ends"), "items")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans, ascending; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the characters from the first to the last word of each span."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, pos = [], 0
    for lo, hi in spans:
        out.append(text[pos : at[lo][0]])
        pos = at[hi - 1][1]
    return "".join(out) + text[pos:]


def cleaned_texts(spans: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """hit_spans plus n_hit, ``clean`` (text less all hit spans) and ``kept``.

    A document is not kept if more than ``max_coverage`` of its words are hit. Every hit span goes: it has a window's
    length at least, or it covers a whole item that is shorter.
    """

    def make():
        def fn(ids, texts, n, lo, hi, items):
            hit = [sum(b - a for a, b in zip(x, y)) for x, y in zip(lo, hi)]
            clean = [t if not x or t is None else _without(t, list(zip(x, y))) for t, x, y in zip(texts, lo, hi)]
            return ids, texts, n, lo, hi, items, hit, clean, [h <= max_coverage * k for h, k in zip(hit, n)]

        return fn

    return map_lists(spans, make, spans.schema.simpleString()[7:-1].replace(",", ", ") + ", n_hit:long, clean:string, kept:boolean")


def document_hits(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda a, x: a + x).cast("long")
    return spans.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept rows of ``docs`` with contaminated spans cut out of ``text``; all columns stay. No shuffle.

    One pass a block. All passes read the uncut text and hand on the spans found so far; the last one judges and cuts.
    """
    schema, at = docs.schema, docs.columns.index(text)
    extra = "spans"
    while extra in schema.names:
        extra += "_"
    carried = StructType([*schema.fields, StructField(extra, ArrayType(ArrayType(IntegerType())))])
    blocks = _blocks(benchmark, text, window, block_words)
    automaton, first = next(blocks), True
    while automaton is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches, shared=shared, first=first, last=following is None):
            import pyarrow as pa

            a = shared.value
            for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
                texts = batch.column(at).to_pylist()
                words = [words_of(t) for t in texts]
                spans = [a.scan(w)[0] for w in words]
                if not first:
                    spans = [merged_spans([*map(tuple, old), *new]) for old, new in zip(batch.column(len(schema)).to_pylist(), spans)]
                columns = list(batch.columns[: len(schema)])
                if not last:
                    names = [*schema.names, extra]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32())))], names=names)
                    continue
                keep = [sum(y - x for x, y in s) <= max_coverage * len(w) for s, w in zip(spans, words)]
                kind = batch.schema.field(at).type
                columns[at] = pa.array([_without(t, x) if x else t for t, x in zip(texts, spans)], type=kind)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep, type=pa.bool_()))

        docs = docs.mapInArrow(run, schema if following is None else carried)
        automaton, first = following, False
    return docs

