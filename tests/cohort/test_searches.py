"""What the registered searches and cross-validations are given."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

from tessera.operators import models, selection
from tessera.plans import catalogue
from tessera.plans import cohort as c


def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture
def seen(monkeypatch):
    """Arguments of the operators; predictions are the truth and masks are full."""
    calls = {}

    def cross_validate(rows, name, n_folds, seed, **more):
        calls["cv"] = {"rows": rows.count(), "labels": sorted(r.y for r in rows.select("y").distinct().collect()), "folds": sorted(r.fold for r in rows.select("fold").distinct().collect()), "n_folds": n_folds, "more": more}
        return rows.select("id", "fold", F.col("y").cast("int").alias("y"), F.col("y").cast("int").alias("pred"))

    def mask_fitness(rows, vec, dim, seed=42):
        calls["fitness"] = {"rows": rows.count(), "labels": rows.select("cls").distinct().count()}
        return lambda population: population.mean(1)

    monkeypatch.setattr(models, "cross_validate", cross_validate)
    monkeypatch.setattr(selection, "mask_fitness", mask_fitness)
    return calls


@pytest.mark.parametrize("name", ["q45_rf_cv", "q45_lr_cv"])
def test_cross_validation_gets_all_rows_and_labels(spark, seen, name):
    (k,) = table(spark).agg(F.count_distinct("label")).first()
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert k == 10 and seen["cv"]["rows"] == table(spark).count() and seen["cv"]["labels"] == [float(i) for i in range(k)]
    assert all(r.macro_f1 == 1 for r in rows)


@pytest.mark.parametrize("name", ["q46_ga_select", "q46_bda_select"])
def test_searches_get_all_rows_and_labels(spark, seen, name):
    catalogue.QUERIES[name](spark, SF).collect()
    assert seen["fitness"] == {"rows": table(spark).count(), "labels": 10}


def test_elimination_gets_all_rows(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "written", lambda df: sizes.append((df.count(), df.select("y").distinct().count())) or df)
    monkeypatch.setattr(selection, "select_rfe", lambda weights, dim, k, step: selection.select_none(dim))
    sizes = []
    catalogue.QUERIES["q46_rfe_select"](spark, SF).collect()
    assert sizes == [(table(spark).count(), 10)]


@pytest.mark.parametrize("name", ["q45_rf_cv", "q45_lr_cv"])
def test_cross_validation_is_the_operators_own(spark, seen, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert seen["cv"]["folds"] == list(range(c.CONFIG.folds)) and seen["cv"]["n_folds"] == c.CONFIG.folds == len(rows)
    assert seen["cv"]["more"] == {}


@pytest.mark.parametrize("name", ["q46_ga_select", "q46_bda_select"])
def test_searches_are_the_operators_own(spark, seen, monkeypatch, name):
    """20 masks, 30 rounds."""
    sizes = []
    monkeypatch.setattr(selection, "mask_fitness", lambda *a, **k: lambda population: sizes.append(len(population)) or population.mean(1))
    catalogue.QUERIES[name](spark, SF).collect()
    assert sizes == [20] * 30


def test_pca_keeps_what_the_configuration_says(spark):
    assert {r.dim for r in catalogue.QUERIES["q45_pca"](spark, SF).collect()} == {c.CONFIG.max_pca}
