"""Random forests grown whole inside tasks: one task grows some trees on all training rows.

Spark ML grows all trees level by level and ships a histogram of every feature, bin and class for each node, also for the many
that hold a few rows. Here rows are binned once (quantile bins, one byte a value), broadcast, and each task grows its
trees on its own, level by level: weighted bootstrap (Poisson), features drawn anew for each node, Gini gain on sorted (node,
feature, bin) keys, so a level costs what its rows do, however many nodes it has. Trees are seeded one by one: the result
does not depend on how tasks are dealt. Each task votes on the rows to be predicted; only sums of class shares leave it.

The broadcast is bounded by MOST_BYTES; above it callers use Spark ML's forest, which has no such bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import written

BINS = 32
#: Bytes of binned values that are broadcast at most; trees a task.
MOST_BYTES, TREES = 16_000_000, 10


def binned(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Places of the values among up to BINS quantile bins of the training rows' features."""
    out = np.empty(x.shape, np.uint8)
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[train, f], np.arange(1, BINS) / BINS)) if train.any() else np.zeros(0)
        out[:, f] = np.searchsorted(edges, x[:, f])
    return out


def best_splits(node: np.ndarray, codes: np.ndarray, y: np.ndarray, w: np.ndarray, nodes: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, column of ``codes`` and last bin on the left of each node's best split; no gain where no split separates rows."""
    gain, column, at = np.zeros(nodes), np.zeros(nodes, int), np.zeros(nodes, int)
    total = np.bincount(node * k + y, w, nodes * k).reshape(nodes, k)
    size = total.sum(1)
    pure = (total**2).sum(1) / np.maximum(size, 1e-12)
    for j in range(codes.shape[1]):
        key = (node * BINS + codes[:, j]) * k + y
        sums = np.bincount(key, w, nodes * BINS * k).reshape(nodes, BINS, k) if nodes * BINS * k <= 4 * len(node) + 100_000 else None
        if sums is not None:
            left = np.cumsum(sums, 1)
            left_n = left.sum(2)
            right_n = size[:, None] - left_n
            ok = (left_n > 1e-9) & (right_n > 1e-9)
            score = np.where(ok, (left**2).sum(2) / np.maximum(left_n, 1e-12) + ((total[:, None] - left) ** 2).sum(2) / np.maximum(right_n, 1e-12) - pure[:, None], 0.0)
            b = score.argmax(1)
            s, who = score[np.arange(nodes), b], np.arange(nodes)
        else:  # few rows a node: only the cells that hold rows
            cell, of = np.unique(key // k, return_inverse=True)
            sums = np.bincount(of * k + y, w, len(cell) * k).reshape(-1, k)
            owner = cell // BINS
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            run = np.cumsum(sums, 0)
            start = np.repeat(run[first] - sums[first], np.diff(np.append(first, len(cell))), axis=0)
            left = run - start
            left_n = left.sum(1)
            right_n = size[owner] - left_n
            ok = np.ones(len(cell), bool)
            ok[np.append(first[1:], len(cell)) - 1] = False  # a node's last cell has nothing on its right
            score = np.where(ok, (left**2).sum(1) / np.maximum(left_n, 1e-12) + ((total[owner] - left) ** 2).sum(1) / np.maximum(right_n, 1e-12) - pure[owner], 0.0)
            order = np.lexsort((-score, owner))[first]
            s, b, who = score[order], cell[order] % BINS, owner[first]
        better = s > gain[who] + 1e-9
        gain[who[better]], column[who[better]], at[who[better]] = s[better], j, b[better]
    return gain, column, at


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray, k: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Class shares of the leaf that each row of ``asked`` falls into, by one tree."""
    times = rng.poisson(1.0, len(y))
    mine = np.flatnonzero(times)
    out = np.zeros((len(asked), k))
    if not len(mine):
        return out
    rows, labels, w = codes[mine], y[mine], weight[mine] * times[mine]
    few = max(1, int(np.ceil(np.sqrt(codes.shape[1]))))
    node, nodes = np.zeros(len(mine), int), 1
    live, there = np.arange(len(asked)), np.zeros(len(asked), int)
    for level in range(depth + 1):
        total = np.bincount(node * k + labels, w, nodes * k).reshape(nodes, k)
        chosen = rng.random((nodes, codes.shape[1])).argpartition(few - 1, 1)[:, :few]
        if level < depth:
            gain, column, at = best_splits(node, np.take_along_axis(rows, chosen[node], 1).astype(int), labels, w, nodes, k)
        else:
            gain, column, at = np.zeros(nodes), np.zeros(nodes, int), np.zeros(nodes, int)
        split = gain > 0
        done = ~split[there]
        out[live[done]] = total[there[done]] / total[there[done]].sum(1, keepdims=True)
        if not split.any():
            break
        feature, number = chosen[np.arange(nodes), column], np.cumsum(split) - 1
        down = lambda of, x: 2 * number[of] + (x[np.arange(len(of)), feature[of]] > at[of])
        on = split[node]
        rows, labels, w, node = rows[on], labels[on], w[on], node[on]
        node = down(node, rows)
        live, there = live[~done], there[~done]
        there = down(there, asked[live]) if len(live) else there
        nodes = 2 * int(split.sum())
    return out


def fits(rows: DataFrame) -> bool:
    """Whether the binned vectors are small enough to be broadcast."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    return n * dim <= MOST_BYTES


def out_of_fold(rows: DataFrame, n_folds: int, seed: int, trees: int = 300, depth: int = 30) -> DataFrame:
    """id, fold, y, pred, p of every row, told by the forest of the other folds. ``rows``: id, fold, y (double), vec."""
    spark = rows.sparkSession
    got = rows.select("id", "fold", F.col("y").cast("int").alias("y"), F.col("vec").cast("array<float>").alias("vec")).toArrow().sort_by("id")  # at most MOST_BYTES values
    fold, y = (got.column(c).to_numpy().astype(int) for c in ("fold", "y"))
    x = np.array(got.column("vec").combine_chunks().flatten()).reshape(len(y), -1)
    k = int(y.max()) + 1 if len(y) else 0
    shared = spark.sparkContext.broadcast((y, fold, [binned(x, fold != f) for f in range(n_folds)]))
    sets = -(-trees // TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, fold, codes = shared.value
        for batch in batches:
            for job in batch.column(0).to_pylist():
                f, part = divmod(job, sets)
                train, asked = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(asked) or not len(train):
                    continue
                counts = np.bincount(y[train], minlength=k)
                weight = (len(train) / ((counts > 0).sum() * np.maximum(1, counts)))[y[train]]
                p = np.zeros((len(asked), k))
                for t in range(part * TREES, min(trees, (part + 1) * TREES)):
                    p += grow(codes[f][train], y[train], weight, codes[f][asked], k, depth, np.random.default_rng((seed + f, t)))
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array([part] * len(asked)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["at", "part", "votes"])

    votes = spark.range(n_folds * sets).repartition(n_folds * sets, "id").mapInArrow(run, "at long, part long, votes array<double>")
    # Summed in the order of the parts, so that the last bits do not depend on the order of arrival.
    by_row = votes.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("part", "votes"))).alias("v"))
    total = F.aggregate("v", F.array_repeat(F.lit(0.0), k), lambda s, one: F.zip_with(s, one["votes"], lambda a, b: a + b))
    known = spark.createDataFrame(got.select(["id", "fold", "y"]).append_column("at", pa.array(np.arange(len(y)))))
    p = by_row.select("at", total.alias("s")).select("at", F.transform("s", lambda v: v / F.aggregate("s", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    # Written: what follows reads it more than once, and would grow the trees anew each time.
    return written(known.join(p, "at").select("id", F.col("fold").cast("int").alias("fold"), F.col("y").cast("int").alias("y"), best.alias("pred"), "p"))
