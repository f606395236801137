"""Feature selection: importance, elimination, genetic and binary-dragonfly search.

A population of masks is small (tens of rows); what is large is the data, so each generation's fitness is one Spark job
over all masks: sums by (mask, fold side, class) of the masked vectors, from which a nearest-centroid fitness follows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fitness = Callable[[np.ndarray], np.ndarray]


def flip(bit: Column, step: Column, draw: Column, tau: float) -> Column:
    """Binary transfer: the bit flips where the draw is under abs(tanh(tau * step))."""
    return F.when(draw < F.abs(F.tanh(F.lit(tau) * step)), 1 - bit).otherwise(bit)


def mask_fitness(rows: DataFrame, vec: str, dim: int, seed: int = 42) -> Fitness:
    """Macro F1 of a nearest-centroid scorer on an inner validation fifth, for a whole population in one job.

    ``rows``: id, cls, ``vec``. The class centroids are read once (classes x dim numbers); masks are broadcast, and each
    validation row scores all masks at once in Arrow batches; only (mask, true, predicted) counts come back.
    """
    from tessera.functions.columns import seeded

    inner = rows.withColumn("_val", F.conv(F.substring(seeded(F.col("id"), seed), 1, 4), 16, 10).cast("int") % 5 == 0)
    flat = inner.filter(~F.col("_val")).select("cls", F.posexplode(vec).alias("pos", "x"))
    means = flat.groupBy("cls", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).toPandas()  # classes x dim rows
    classes = sorted(means["cls"].unique())
    centre = np.zeros((len(classes), dim))
    centre[[classes.index(c) for c in means["cls"]], means["pos"]] = means["m"]
    valid = inner.filter("_val").select("cls", F.col(vec).alias("v"))
    sc = rows.sparkSession.sparkContext

    def fitness(population: np.ndarray) -> np.ndarray:
        shared = sc.broadcast((population.astype(np.float64), centre, classes))

        def run(batches):
            import pyarrow as pa

            masks, c, names = shared.value
            total = np.zeros((len(masks), len(names), len(names)), np.int64)
            for batch in batches:
                y = np.array([names.index(k) if k in names else -1 for k in batch.column(0).to_pylist()])
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(y), -1)
                square = (x[:, None, :] - c[None]) ** 2  # rows x classes x dim
                for at in range(0, len(masks), 8):
                    d = np.round(square @ masks[at : at + 8].T, 9)  # rows x classes x masks
                    best = d.argmin(1)
                    for m in range(best.shape[1]):
                        np.add.at(total[at + m], (y[y >= 0], best[y >= 0, m]), 1)
            m, t, p = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (m, t, p, total[m, t, p])], names=["m", "t", "p", "n"])

        counts = valid.mapInArrow(run, "m long, t long, p long, n long").groupBy("m", "t", "p").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((len(population), len(classes), len(classes)))
        table[counts["m"], counts["t"], counts["p"]] = counts["n"]
        tp, support, predicted = np.einsum("mkk->mk", table), table.sum(2), table.sum(1)
        both = support + predicted
        f1 = np.where(both > 0, 2 * tp / np.maximum(both, 1), 0.0)
        return np.where(population.any(1), f1.mean(1), 0.0)

    return fitness


def select_none(dim: int) -> np.ndarray:
    return np.ones(dim, bool)


def select_importance(importances: np.ndarray, k: int) -> np.ndarray:
    """The k largest, the earlier place first among equals."""
    mask = np.zeros(len(importances), bool)
    mask[np.argsort(-np.asarray(importances), kind="stable")[:k]] = True
    return mask


def select_rfe(weights: Callable[[np.ndarray], np.ndarray], dim: int, k: int, step: float) -> np.ndarray:
    """Recursive elimination: ``weights(mask)`` gives absolute weights of the kept places; a share of all goes each round."""
    mask = np.ones(dim, bool)
    drop = max(1, int(step * dim))
    while mask.sum() > k:
        kept = np.flatnonzero(mask)
        w = np.asarray(weights(mask))
        gone = kept[np.argsort(w, kind="stable")[: min(drop, len(kept) - k)]]
        mask[gone] = False
    return mask


#: Fitness of a mask that selects nothing.
WORST = -1.0


def _scored(fitness: Fitness, population: np.ndarray, penalty: float) -> np.ndarray:
    """Fitness less ``penalty`` for each selected place; an empty mask is worst."""
    return np.where(population.any(1), fitness(population) - penalty * population.sum(1), WORST)


def tournament(values: np.ndarray, rng: np.random.Generator, size: int) -> int:
    """The best of ``size`` drawn members, the first drawn among equals."""
    drawn = rng.integers(0, len(values), size)
    return int(drawn[values[drawn].argmax()])


def select_ga(fitness: Fitness, dim: int, seed: int, size: int = 20, generations: int = 30, crossover: float = 0.7, mutation: float = 0.05, entrants: int = 3, density: float = 0.15, penalty: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Genetic search: tournaments of ``entrants``, one child of two parents by one-point crossover, bit mutation.

    The first population selects about ``density`` of the places; the best mask so far leads every next one, unmutated.
    Returns it and the best fitness of each generation.
    """
    rng = np.random.default_rng(seed)
    population, best, best_value, history = rng.random((size, dim)) < density, np.zeros(dim, bool), -np.inf, []
    for _ in range(generations):
        values = _scored(fitness, population, penalty)
        if values.max() > best_value:
            best, best_value = population[values.argmax()].copy(), float(values.max())
        history.append(float(values.max()))
        children = [best]
        while len(children) < size:
            one, two = (population[tournament(values, rng, entrants)] for _ in range(2))
            at = int(rng.integers(1, dim)) if dim > 1 and rng.random() < crossover else dim
            children.append(np.append(one[:at], two[at:]) ^ (rng.random(dim) < mutation))
        population = np.array(children)
    return best, history


@dataclass(frozen=True)
class Pull:
    """Weights of a swarm's forces in one round."""

    separation: float
    alignment: float
    cohesion: float
    food: float
    enemy: float
    inertia: float


def pull(done: float, rng: np.random.Generator, inertia: tuple[float, float] = (0.9, 0.4)) -> Pull:
    """Weights when a share ``done`` of the rounds is over: apart and away from the worst at first, together and to the best later."""
    early, late = 1.0 - done, done
    draw = lambda most: most * float(rng.random())
    return Pull(separation=draw(2) * early, enemy=draw(1) * early, alignment=draw(2) * late, cohesion=draw(2) * late, food=draw(2) * late, inertia=inertia[0] + (inertia[1] - inertia[0]) * done)


def swarm_steps(position: np.ndarray, step: np.ndarray, food: np.ndarray, enemy: np.ndarray, by: Pull, v_max: float) -> np.ndarray:
    """The next step vectors of the whole swarm (members x places)."""
    x = position.astype(float)
    members, centre = len(x), x.mean(0)
    apart = (x - centre) * members / max(1, members - 1)  # what the others' places, less the member's own, add up to, turned round
    forces = by.separation * apart + by.alignment * step.mean(0) + by.cohesion * (centre - x) + by.food * (food - x) + by.enemy * (enemy + x)
    return np.clip(forces + by.inertia * step, -v_max, v_max)


def swarm_positions(position: np.ndarray, step: np.ndarray, draw: np.ndarray, tau: float) -> np.ndarray:
    """Bits flip where the draw is under abs(tanh(tau * step)); a mask left empty gets the place of its largest step."""
    out = position ^ (draw < np.abs(np.tanh(tau * step)))
    empty = np.flatnonzero(~out.any(1))
    out[empty, np.abs(step[empty]).argmax(1)] = True
    return out


def select_bda(fitness: Fitness, dim: int, seed: int, size: int = 20, iterations: int = 30, v_max: float = 6.0, tau: tuple[float, float] = (1.0, 4.0), inertia: tuple[float, float] = (0.9, 0.4), density: float = 0.15, penalty: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Binary dragonfly search: see ``pull``, ``swarm_steps`` and ``swarm_positions``; tau rises, the best mask so far leads the swarm."""
    rng = np.random.default_rng(seed)
    position, step = rng.random((size, dim)) < density, rng.uniform(-1.0, 1.0, (size, dim))
    best, best_value, history = np.zeros(dim, bool), -np.inf, []
    for i in range(iterations):
        values = _scored(fitness, position, penalty)
        if values.max() > best_value:
            best, best_value = position[values.argmax()].copy(), float(values.max())
        history.append(best_value)
        done = i / max(1, iterations - 1)
        by = pull(done, rng, inertia)
        step = swarm_steps(position, step, position[values.argmax()], position[values.argmin()], by, v_max)
        position = swarm_positions(position, step, rng.random((size, dim)), tau[0] + (tau[1] - tau[0]) * done)
        position[0] = best
    return best, history


# --- One interface -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Problem:
    """What a selector may ask for. Only what it uses need be given."""

    dim: int
    fitness: Fitness | None = None
    importances: Callable[[], np.ndarray] | None = None
    weights: Callable[[np.ndarray], np.ndarray] | None = None
    keep: int = 16
    step: float = 0.25
    branches: tuple[tuple[str, int, int], ...] = ()  # name, first place, one past the last
    names: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Selection:
    method: str
    mask: np.ndarray
    retained: dict[str, int]
    names: tuple[str, ...]
    history: tuple[float, ...] = ()


def fitted_importances(rows: DataFrame, vec: str, seed: int, trees: int = 50) -> np.ndarray:
    """Impurity importances of a random forest fitted to id, y, ``vec``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select("y", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=8, seed=seed).fit(data).featureImportances.toArray()


def selected_names(mask: np.ndarray, names: tuple[str, ...]) -> tuple[str, ...]:
    """Names of the selected places; there must be one for each place."""
    if len(names) != len(mask):
        raise ValueError(f"{len(names)} names for {len(mask)} places")
    return tuple(n for n, chosen in zip(names, mask) if chosen)


SELECTORS: dict[str, Callable[[Problem, int], tuple[np.ndarray, list[float]]]] = {
    "none": lambda p, seed: (select_none(p.dim), []),
    "importance": lambda p, seed: (select_importance(p.importances(), p.keep), []),
    "rfe": lambda p, seed: (select_rfe(p.weights, p.dim, p.keep, p.step), []),
    "ga": lambda p, seed: select_ga(p.fitness, p.dim, seed, **p.options),
    "bda": lambda p, seed: select_bda(p.fitness, p.dim, seed, **p.options),
}


def run_selector(name: str, problem: Problem, seed: int) -> Selection:
    """Any selector by name; ``dragonfly`` and ``dfa`` are other names of ``bda``."""
    known = {"dragonfly": "bda", "dfa": "bda"}.get(name, name)
    if known not in SELECTORS:
        raise ValueError(f"unknown selector {name!r}; known: {sorted(SELECTORS)}")
    mask, history = SELECTORS[known](problem, seed)
    mask = np.asarray(mask, bool)
    return Selection(known, mask, {b: int(mask[lo:hi].sum()) for b, lo, hi in problem.branches}, selected_names(mask, problem.names) if problem.names else (), tuple(history))

