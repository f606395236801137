"""The forest against Spark ML's, and its trees against their definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 6))
    x[:, 2] += y
    x[:, 4] += (y == 1) * 1.5
    return spark.createDataFrame([(i, i % 4, float(y[i]), x[i].tolist()) for i in range(400)], "id long, fold int, y double, vec array<double>").cache()


def right(df):
    return df.agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]


def test_forest_is_as_right_as_spark_mls(spark, rows, monkeypatch):
    ours = models.cross_validate(rows, "random_forest", 4, 7, trees=60)
    monkeypatch.setattr(forest, "MOST_BYTES", 0)  # beyond it, Spark ML's forest
    theirs = models.cross_validate(rows, "random_forest", 4, 7, trees=60)
    assert ours.dtypes == theirs.dtypes and ours.count() == theirs.count() == 400
    assert abs(right(ours) - right(theirs)) < 0.05 and right(ours) > 0.6


def test_all_trees_vote_and_dealing_changes_nothing(rows, monkeypatch):
    told = lambda trees: {r.id: tuple(r.p) for r in forest.out_of_fold(rows, 4, 7, trees).collect()}
    one = told(23)
    monkeypatch.setattr(forest, "TREES", 4)
    two = told(23)
    assert all(one[i] == pytest.approx(two[i]) for i in one) and len(one) == 400
    assert all(sum(p) == pytest.approx(1) for p in one.values())
    assert models.CLASSIFIERS["random_forest"](0).getNumTrees() == 300 == forest.out_of_fold.__defaults__[0]


@pytest.mark.parametrize("nodes", [2, 200])
def test_best_splits_equal_brute_force(nodes):
    """With many rows a node, and with few."""
    rng = np.random.default_rng(nodes)
    n, k = 600, 40
    node, y, w = np.append(np.arange(nodes), rng.integers(0, nodes, n - nodes)), rng.integers(0, k, n), rng.integers(1, 4, n) * 1.0
    codes = rng.integers(0, forest.BINS, (n, 3))
    gain, column, at = forest.best_splits(node, codes, y, w, nodes, k)
    pure = lambda m: (np.bincount(y[m], w[m], k) ** 2).sum() / w[m].sum()
    for a in range(nodes):
        of = node == a
        cuts = [(pure(of & (codes[:, j] <= b)) + pure(of & (codes[:, j] > b)) - pure(of)) for j in range(3) for b in range(forest.BINS) if (of & (codes[:, j] <= b)).any() and (of & (codes[:, j] > b)).any()]
        assert gain[a] == pytest.approx(max([0.0, *cuts]), abs=1e-6)
        if gain[a] > 0:
            m = codes[:, column[a]] <= at[a]
            assert pure(of & m) + pure(of & ~m) - pure(of) == pytest.approx(gain[a])


def test_an_unlimited_tree_knows_its_rows():
    rng = np.random.default_rng(0)
    codes, y = rng.integers(0, forest.BINS, (300, 8)).astype(np.uint8), rng.integers(0, 4, 300)
    p = sum(forest.grow(codes, y, np.ones(300), codes, 4, 30, np.random.default_rng(t)) for t in range(60))
    assert (p.argmax(1) == y).all()
    assert forest.grow(codes, y, np.ones(300), codes[:5], 4, 0, rng).std(0).max() == 0
