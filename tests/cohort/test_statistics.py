"""Golden numbers and edge cases of metrics, tests, calibration and conformal sets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, clipped, half_even
from tessera.operators import calibration, conformal, features, gates, metrics, selection, significance


def test_locked_test_metrics(spark):
    table = [[123, 9, 3, 1], [19, 34, 2, 0], [9, 0, 25, 0], [2, 1, 0, 15]]
    preds = spark.createDataFrame([(y, p) for y, row in enumerate(table) for p, n in enumerate(row) for _ in range(n)], "y int, pred int")
    r = metrics.summary(metrics.class_metrics(metrics.confusion(preds, 4))).first()
    want = dict(macro_f1=0.8004206751773794, weighted_f1=0.8065322493880954, accuracy=0.8106995884773662, balanced_accuracy=0.7728052584670232, mcc=0.6812477240458646)
    assert all(r[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_absent_and_single_classes(spark):
    r = metrics.summary(metrics.class_metrics(metrics.confusion(spark.createDataFrame([(0, 0), (0, 1)], "y int, pred int"), 3))).first()
    assert r.mcc is None and r.balanced_accuracy == 0.5 and r.macro_f1 == pytest.approx((2 / 3) / 3)


def test_mcnemar_and_holm(spark):
    rows = [("a", 41, 45), ("b", 36, 55), ("c", 43, 58), ("d", 10, 9)]
    t = significance.with_statistic(spark.createDataFrame(rows, "pair string, n01 long, n10 long")).withColumn("p", significance.chi2_tail("statistic"))
    got = {r.pair: r for r in significance.holm(t, "p", "pair").collect()}
    assert [round(got[k].statistic, 6) for k in "abc"] == [0.104651, 3.56044, 1.940594]
    assert [round(got[k].p, 6) for k in "abc"] == [0.746318, 0.059172, 0.163604]
    assert [round(got[k].holm, 6) for k in "abc"] == [0.746318, 0.177516, 0.327208]
    assert got["d"].statistic is None and got["d"].p is None and got["d"].holm is None
    tie = significance.with_statistic(spark.createDataFrame([("x", 41, 41)], "pair string, n01 long, n10 long")).withColumn("p", significance.chi2_tail("statistic")).first()
    assert round(tie.statistic, 6) == 0.012195 and round(tie.p, 6) == 0.912067


def test_split_rounding(spark):
    for n, want in {911: (638, 137), 368: (258, 55), 231: (162, 35), 125: (88, 19)}.items():
        r = spark.range(1).select(half_even(F.lit(n) * 0.7).alias("a"), half_even(F.lit(n) * 0.15).alias("b")).first()
        assert (r.a, r.b) == want


@pytest.mark.parametrize(("n", "k"), [(10, 10), (9, 9), (123, 112), (69, 63), (28, 27), (17, 17)])
def test_order_statistic(spark, n, k):
    scores = spark.createDataFrame([(0, [1 - i / 1000.0, i / 1000.0]) for i in range(1, n + 1)], "y int, p array<double>")
    r = conformal.quantiles(scores, 0.10).first()
    assert (r.n, r.k) == (n, k) and r.q == pytest.approx(k / 1000.0)


def test_conformal_boundary_and_empty_class(spark):
    p, q = 0.26175721726626361, 0.73824278273373634
    preds = spark.createDataFrame([(0, [p, 1 - p])], "y int, p array<double>")
    sets = conformal.marginal_sets(preds, spark.createDataFrame([(q,)], "q double"))
    assert 0 in sets.first()["set"]
    fit = {r.y: r for r in conformal.by_class(preds, 0.1, 3).collect()}
    assert fit[2].q == 1.0 and fit[2].n == 0 and fit[2].small
    with pytest.raises(ValueError):
        conformal.quantiles(preds, 1.0)


def test_reliability_edges(spark):
    preds = spark.createDataFrame([(0, [c, 1 - c]) for c in (1.0, 0.55)], "y int, p array<double>")
    bins = {r.bin: r.n for r in calibration.reliability(preds, 10).collect()}
    assert bins[9] == 1 and bins[5] == 1 and len(bins) == 10
    assert spark.range(1).select(calibration.bin_of(F.lit(0.3), 10).alias("b")).first().b == 2


def test_proper_scores(spark):
    r = calibration.proper_scores(spark.createDataFrame([(0, [0.25] * 4), (2, [0.25] * 4)], "y int, p array<double>")).first()
    assert r.nll == pytest.approx(math.log(4)) and r.brier == pytest.approx(0.75)
    sure = calibration.proper_scores(spark.createDataFrame([(1, [0.0, 1.0])], "y int, p array<double>")).first()
    assert sure.nll < 1e-6 and sure.brier < 1e-12


def test_temperature_recovers_sharpness(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(2000):
        z = rng.normal(size=3) * 2
        p = np.exp(z) / np.exp(z).sum()
        soft = p ** (1 / 3) / (p ** (1 / 3)).sum()
        rows.append((len(rows), int(rng.choice(3, p=p)), soft.tolist()))
    preds = spark.createDataFrame(rows, "id int, y int, p array<double>")
    t = calibration.fit_temperature(preds)
    assert 0.25 < t < 0.45
    assert calibration.moved(preds, calibration.apply_temperature(preds, t)).count() == 0


def test_argmax_takes_the_first(spark):
    r = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(argmax(F.col("p")).alias("a"), clipped(F.col("p")).alias("c")).first()
    assert r.a == 0 and sum(r.c) == pytest.approx(1)


def test_masks_and_fusion(spark):
    masks = spark.createDataFrame([(f, i, s) for f, on in enumerate([{0, 1}, {1, 2}, set()]) for i, s in [(k, k in on) for k in range(3)]], "fold int, pos int, selected boolean")
    got = {(r.fold_a, r.fold_b): r.jaccard for r in features.jaccard(masks).collect()}
    assert got == {(0, 1): pytest.approx(1 / 3), (0, 2): 0.0, (1, 2): 0.0}
    empty = features.jaccard(masks.withColumn("selected", F.lit(False))).filter("fold_a = 0 AND fold_b = 1").first()
    assert empty.jaccard == 1.0
    assert features.canonical(["lab", "deep", "glcm", "glcm"]) == ["deep", "glcm", "color_lab"]
    dims = {r.arm: r.arm_dim for r in features.slice_map(spark).collect()}
    assert dims == {"A0": 1280, "A1": 1292, "A2": 1298, "A3": 1312, "A4": 1286, "A5": 1310, "A6": 1348, "A7": 1316}
    flat = features.column_stats(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>"), "v")
    assert {r.pos: (r["mean"], r["std"]) for r in flat.collect()} == {0: (2.0, 1.0), 1: (5.0, 1.0)}


def test_searches_are_deterministic_and_find_the_good_places():
    good = np.array([True] * 4 + [False] * 12)
    fitness = lambda pop: np.array([(row == good).mean() for row in pop])
    for search in (selection.select_ga, selection.select_bda):
        a, history = search(fitness, 16, 1)
        b, _ = search(fitness, 16, 1)
        assert (a == b).all() and history == sorted(history) and fitness(a[None])[0] >= 0.8
    assert selection.select_importance(np.array([1.0, 3.0, 3.0, 2.0]), 2).tolist() == [False, True, True, False]
    assert selection.select_rfe(lambda m: np.flatnonzero(m), 10, 3, 0.2).tolist() == [False] * 7 + [True] * 3


def test_swarm_forces_by_hand():
    """Three masks of two places; each force alone, then bounds and inertia."""
    x, step = np.array([[1, 0], [0, 0], [1, 1]], bool), np.array([[0.5, -0.5], [0.0, 1.0], [-1.0, 0.5]])
    food, enemy = x[2], x[1]
    alone = lambda **w: selection.swarm_steps(x, step, food, enemy, selection.Pull(**({k: 0.0 for k in ("separation", "alignment", "cohesion", "food", "enemy", "inertia")} | w)), 6.0)
    for i in range(3):
        assert alone(separation=1.0)[i] == pytest.approx(-sum(x[j].astype(float) - x[i] for j in range(3)) / 2)
    assert alone(alignment=1.0) == pytest.approx(np.array([[-1 / 6, 1 / 3]] * 3))
    assert alone(cohesion=1.0) == pytest.approx(np.array([[2 / 3, 1 / 3]]) - x)
    assert alone(food=1.0).tolist() == [[0, 1], [1, 1], [0, 0]]
    assert alone(enemy=1.0).tolist() == [[1, 0], [0, 0], [1, 1]]
    assert alone(inertia=0.5) == pytest.approx(step / 2)
    assert np.abs(selection.swarm_steps(x, step * 100, food, enemy, selection.Pull(0, 0, 0, 0, 0, 1.0), 6.0)).max() == 6.0


def test_pull_turns_from_apart_to_together():
    rng = np.random.default_rng(0)
    first, last = selection.pull(0.0, rng), selection.pull(1.0, rng)
    assert (first.alignment, first.cohesion, first.food) == (0, 0, 0) and first.separation > 0 and first.enemy > 0 and first.inertia == pytest.approx(0.9)
    assert (last.separation, last.enemy) == (0, 0) and min(last.alignment, last.cohesion, last.food) > 0 and last.inertia == pytest.approx(0.4)


def test_an_emptied_mask_gets_the_place_of_its_largest_step():
    x, step = np.array([[True, False, False], [True, True, False]]), np.array([[3.0, -0.1, 0.2], [0.0, 0.0, 0.0]])
    draw = np.array([[0.0, 1.0, 1.0], [1.0, 1.0, 1.0]])
    assert selection.swarm_positions(x, step, draw, 2.0).tolist() == [[True, False, False], [True, True, False]]


def test_search_start_penalty_and_empty_masks():
    """About 15 % of places at first; the penalty is for each place; empty masks are worst."""
    seen = []
    fitness = lambda pop: seen.append(pop.copy()) or np.ones(len(pop))
    for search in (selection.select_ga, selection.select_bda):
        seen.clear()
        mask, history = search(fitness, 2000, 3, 20, 2, penalty=0.001)
        assert 0.13 < seen[0].mean() < 0.17 and len(seen) == 2
        assert history[0] == pytest.approx(1 - 0.001 * min(p.sum() for p in seen[0]))
    assert selection._scored(fitness, np.array([[False, False], [True, False]]), 0.1).tolist() == [selection.WORST, 0.9]
    values = np.array([0.1, 0.9, 0.5])
    assert {selection.tournament(values, np.random.default_rng(s), 50) for s in range(5)} == {1}


def test_one_interface_for_all_selectors():
    good = np.array([True] * 3 + [False] * 9)
    names = tuple(f"f{i}" for i in range(12))
    problem = selection.Problem(12, lambda pop: np.array([(r == good).mean() for r in pop]), lambda: np.arange(12)[::-1], lambda m: -np.flatnonzero(m), 3, 0.2, (("a", 0, 6), ("b", 6, 12)), names)
    for name in ("importance", "rfe", "ga", "bda", "dragonfly", "dfa"):
        found = selection.run_selector(name, problem, 1)
        assert (found.mask == good).mean() >= 0.75 and found.method in selection.SELECTORS
        assert found.retained == {"a": found.mask[:6].sum(), "b": found.mask[6:].sum()} and found.names == tuple(n for n, m in zip(names, found.mask) if m)
    assert selection.run_selector("importance", problem, 1).mask.tolist() == selection.run_selector("rfe", problem, 1).mask.tolist() == good.tolist()
    assert selection.run_selector("none", problem, 1).mask.all()
    with pytest.raises(ValueError):
        selection.run_selector("magic", problem, 1)
    with pytest.raises(ValueError):
        selection.selected_names(good, names[:5])


def test_arm_selection(spark):
    rows = spark.createDataFrame([("A7", 1316, 0.72, 0.7), ("A2", 1298, 0.7151, 0.6), ("A0", 1280, 0.70, 0.9)], "arm string, dim int, macro_f1 double, balanced_accuracy double")
    assert metrics.select_arm(rows, 0.005).first().arm == "A2"
    assert metrics.beats_baseline(rows, "A0", 0.005).first().winner == "A7" and metrics.beats_baseline(rows, "A0", 0.03).first().winner == "A0"
    history = spark.createDataFrame([(1, 3, 0.5), (2, 1, 0.5), (2, 2, 0.5)], "stage int, epoch int, val_loss double")
    assert tuple(metrics.best_checkpoint(history).first())[:2] == (2, 1)


def test_gates(spark):
    preds = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.7, 0.7]), (3, [float("nan"), 1.0]), (4, [-0.1, 1.1]), (5, [1.0])], "id int, p array<double>")
    bad = {(r["check"], r.detail) for r in gates.probability_validity(preds, 2).collect()}
    assert {("sums to one", "2"), ("no nan", "3"), ("finite and not negative", "4"), ("width", "5")} <= bad and not any(x == "1" for _, x in bad)
    gates.check_mask([True, False], 2)
    for mask, dim, error in (([1, 0], 2, TypeError), ([True], 2, ValueError), ([False, False], 2, ValueError)):
        with pytest.raises(error):
            gates.check_mask(mask, dim)
    assert gates.contract({"t": 0.5, "arm": "A7"}, {"t": 0.5 + 1e-9, "arm": "A2"}) == ["arm"]
    with pytest.raises(PermissionError):
        gates.locked_test(False, preds, 5)
    with pytest.raises(ValueError):
        gates.locked_test(True, preds, 4)
