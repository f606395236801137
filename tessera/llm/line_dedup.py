"""Line deduplication: drop lines found in many documents, all but one holder's.

Lines are exploded with their place, normalised and hashed (two 64-bit hashes, 128 bits together); documents are
counted by hash; the places of lines over the threshold go back to their documents, which are put together again.
Line texts are never shuffled alone: only hashes and places are, and each document's text once.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. A key of at least
``min_chars`` code points found in at least ``min_docs`` documents loses all its lines, except those in the document
with the largest doc_id that holds it. Other lines stay, joined by \\n.

Defined results: null or empty text is one empty line (null becomes the empty text if lines of it are asked for, and a
document that loses nothing keeps its text, null included); documents are told apart by doc_id when they are counted,
so rows that repeat a doc_id count once; a null doc_id counts as no document and never is the holder; rows that repeat
are returned as often as they occur; of keys with equal doc_ids the document holds all; a text of any length is split
whole; other columns are carried along whatever their names, except that n_lines and n_dropped are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, cut, fold

MIN_CHARS, MIN_DOCS = 20, 3
#: Share of all places from which a key's places are not dealt out by key.
HOT = 1e-4


def line_key(line: Column) -> Column:
    return fold(F.btrim(line, F.lit(WHITE)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def line_places(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """doc_id, t (hash of the text), at (place), h1, h2 of every line with a key that is long enough."""
    # The text ends here, before its lines are exploded: what stands beside a generator is worked out again for each line.
    split = docs.select("doc_id", F.xxhash64(F.col(f"`{text}`")).alias("t"), _lines(text).alias("lines"))
    key = split.select("doc_id", "t", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line")))
    return key.filter(F.length("key") >= min_chars).select("doc_id", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(20), "key").alias("h2"))


def dropped_places(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: float | None = None) -> DataFrame:
    """gone_id, gone_t and the sorted places (gone) of the lines to drop, for documents that lose any.

    Keys that hold a share of at least ``hot`` (HOT) of all places are at most 1 / hot, so they are broadcast to their places,
    which stay where they are; only the places of other keys are dealt out by key. One key may hold a third of all lines.
    """
    places = cut(line_places(docs, text, min_chars), "places")
    # The distinct count deals rows by hash and document first, so a line of a third of all documents is spread out.
    keys = places.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"), F.count("*").alias("n"))
    common = cut(keys.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "holder", "n"), "common")
    least = max(1, math.ceil(places.count() * (HOT if hot is None else hot)))
    known = F.broadcast(common.filter(F.col("n") >= least).select("h1", "h2", F.struct("holder").alias("hot")))
    tagged = places.join(known, ["h1", "h2"], "left")
    warm = tagged.filter(F.col("hot").isNotNull()).select("doc_id", "t", "at", F.col("hot.holder").alias("holder"))
    rest = tagged.filter(F.col("hot").isNull()).join(common.filter(F.col("n") < least), ["h1", "h2"]).select("doc_id", "t", "at", "holder")
    hit = warm.unionByName(rest).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return hit.groupBy(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).agg(F.array_sort(F.collect_set("at")).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the common lines taken out of ``text``, and n_lines and n_dropped (replacing columns of these names)."""
    docs = docs.drop("n_lines", "n_dropped")
    gone = dropped_places(docs, text, min_chars, min_docs)
    # The input's columns travel inside one struct: no name of theirs can clash with the operator's own.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.col(f"`{text}`")).alias("own_t"))
    joined = whole.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_t") == F.col("gone_t")), "left")
    own = F.col("row").getField(text)
    joined = joined.withColumns({"lines": F.when(F.col("gone").isNotNull(), F.split(F.coalesce(own, F.lit("")), "\n", -1)), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")})
    # The lines are used more than once below, so that they are split once a text and not inside the lambda.
    count = F.length(own) - F.length(F.translate(own, "\n", "")) + 1
    joined = joined.withColumn("n_lines", F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(F.coalesce(count, F.lit(1))).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    body = F.when(F.col("gone").isNull(), own).otherwise(rest)
    return joined.select(*[(body if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns], "n_lines", "n_dropped")
