"""Exact groups, 64-bit text hashes, Hamming joins and greedy duplicate leaders."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_groups(items: DataFrame, content: Column, id_: str = "id") -> DataFrame:
    """hash, n, kept (smallest id) of contents found more than once."""
    return items.groupBy(F.md5(content.cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.min(id_).alias("kept")).filter("n > 1")


def simhash(items: DataFrame, text: str = "text", id_: str = "id", *keep: str) -> DataFrame:
    """``id_``, ``keep``, lo, hi: the two halves of a 64-bit SimHash over all tokens (runs without blank, line end and tab).

    A token's bits are the first 64 of its MD5; a hash bit is set if more tokens have it than not. One pass without a shuffle.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in keep}

    def run(batches):
        import pyarrow as pa

        known: dict[str, np.ndarray] = {}
        split = str.maketrans("\n\t\r", "   ")

        def signs(token: str) -> np.ndarray:
            got = known.get(token)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                bits = np.unpackbits(np.frombuffer(hashlib.md5(token.encode()).digest()[:8], np.uint8))
                got = known[token] = bits.astype(np.int8) * 2 - 1
            return got

        for batch in batches:
            lo, hi = [], []
            for t in batch.column(1).to_pylist():
                tokens = Counter((t or "").translate(split).split(" "))
                tokens.pop("", None)
                if not tokens:
                    lo.append(0)
                    hi.append(0)
                    continue
                table = np.frombuffer(b"".join([signs(x).tobytes() for x in tokens]), np.int8).reshape(-1, 64)
                total = np.array(list(tokens.values()), np.float64) @ table
                raw = np.packbits(total > 0).tobytes()
                lo.append(int.from_bytes(raw[:4], "big"))
                hi.append(int.from_bytes(raw[4:], "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[id_, *keep, "lo", "hi"])

    schema = ", ".join([f"{id_} long", *(f"{c} {k}" for c, k in kinds.items()), "lo long, hi long"])
    return items.select(F.col(id_).cast("long").alias(id_), text, *keep).mapInArrow(run, schema)


def hamming(a: DataFrame, b: DataFrame) -> Column:
    return F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))


def representatives(hashed: DataFrame, by: list[str]) -> DataFrame:
    """One row for equal hashes within ``by``: rep (smallest id), copies. Groups of copies never become pairs."""
    return hashed.groupBy(*by, "lo", "hi").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def agreeing_blocks(n: int, bits: int) -> int:
    """How many blocks a key has: the fewest whose key tells n hashes apart, six at most."""
    return next((a for a in range(1, 6) if 64 * a // (bits + a) >= math.log2(max(n, 2)) + 2), 6)


def close_pairs(reps: DataFrame, bits: int, within: str | None = None, across: str | None = None) -> DataFrame:
    """a, b, distance: pairs within ``bits`` of each other, equal in ``within`` or different in ``across``.

    The hash is cut into bits + k blocks; two hashes at most ``bits`` apart agree in at least k of them (pigeonhole), so each
    hash is filed under every choice of k blocks: an equality join, then the test. More blocks a key make keys longer
    than the number of hashes is, so that few pairs meet by chance; k changes the cost, not the result. A pair is taken
    from the first k blocks in which it agrees, so no distinct step is needed.
    """
    k = agreeing_blocks(reps.count(), bits)
    n = bits + k
    edges = [64 * i // n for i in range(n + 1)]
    word = F.shiftleft(F.col("lo"), 32).bitwiseOR(F.col("hi")).alias("word")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    blocks = [((1 << (z - a)) - 1) << (64 - z) for a, z in zip(edges[:-1], edges[1:])]
    choices = [(sum(1 << i for i in chosen), sum(blocks[i] for i in chosen)) for chosen in combinations(range(n), k)]
    keys = F.array(*[F.struct(F.lit(c).alias("choice"), F.col("word").bitwiseAND(F.lit(signed(m))).alias("key")) for c, m in choices])
    flat = reps.select("rep", within or across, word).select("*", F.explode(keys).alias("_k")).select("rep", within or across, "word", "_k.choice", "_k.key")
    # Merged: by the size of the unexploded table Spark would take a side for small, and build all its keys on the driver.
    a, b = flat.hint("merge").alias("a"), flat.hint("merge").alias("b")
    on = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
    if within:
        on = on & (F.col(f"a.{within}") == F.col(f"b.{within}")) & (F.col("a.rep") < F.col("b.rep"))
    else:
        on = on & (F.col(f"a.{across}") < F.col(f"b.{across}"))
    differ = F.col("a.word").bitwiseXOR(F.col("b.word"))
    distance = F.bit_count(differ)
    agree = F.filter(F.array(*[F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << i)) for i, m in enumerate(blocks)]), lambda x: x.isNotNull())
    first = F.aggregate(F.slice(agree, 1, k), F.lit(0), lambda s, x: s + x)
    return a.join(b, on).filter((distance <= bits) & (first == F.col("a.choice"))).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), distance.cast("int").alias("distance"))


def greedy_leaders(pairs: DataFrame, cut) -> DataFrame:
    """removed, kept: what scanning items in order and dropping unvisited neighbours of each kept one removes.

    That is the lexicographically first maximal independent set: an item leads once all its smaller neighbours are
    removed, and goes once a smaller neighbour leads. Rounds run until none is undecided; ``cut`` writes each round's
    table, so lineage stays short and a lost executor costs one round. The kept one is the smallest leading neighbour.
    """
    edges = cut(pairs.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    state = cut(nodes.withColumn("s", F.lit(0)))  # 0 undecided, 1 leads, 2 removed
    while state.filter("s = 0").limit(1).count():
        waits = edges.join(state.filter("s <> 2").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        now = state.join(waits.withColumn("w", F.lit(True)), "id", "left").withColumn("s", F.when((F.col("s") == 0) & F.col("w").isNull(), 1).otherwise(F.col("s"))).drop("w")
        gone = edges.join(now.filter("s = 1").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        state = cut(now.join(gone.withColumn("g", F.lit(True)), "id", "left").withColumn("s", F.when((F.col("s") == 0) & F.col("g"), 2).otherwise(F.col("s"))).drop("g"))
    return edges.join(state.filter("s = 1").select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("removed")).agg(F.min("a").alias("kept"))
