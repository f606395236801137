"""Scalar expressions on strings, probabilities and ranks. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-7


def normalize_key(c: Column) -> Column:
    """Trimmed, runs of white space, underscores and hyphens as one underscore, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"[\s_\-]+", "_"))


def id_of_filename(c: Column) -> Column:
    """What stands before the first double underscore."""
    return F.substring_index(c, "__", 1)


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^.]+)$", 1))


def parent_key(name: Column, augmented: Column) -> Column:
    """Lineage key: no extension, white space, brackets or underscores, lower case; augmented names lose a last _number too."""
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    bare = F.when(augmented, F.regexp_replace(bare, r"_\d+$", "")).otherwise(bare)
    return F.lower(F.regexp_replace(bare, r"[\s()_]+", ""))


def seeded(c: Column, seed: int) -> Column:
    """A key whose order is a shuffle: the same for the same seed, in any engine with MD5."""
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")).cast("binary"))


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def ranked(df: DataFrame, by: list[str], key: str, id_: str, out: str = "rn") -> DataFrame:
    """row_number() over (partition by ``by`` order by ``key``, ``id_``) for an MD5 ``key``, without one task a group.

    The key's first three hex digits cut every group into 4096 slices of equal size. Rows are numbered within slices;
    what lies before a slice comes from counts by slice (at most 4096 a group).
    """
    cut = F.substring(key, 1, 3)
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*by, cut.alias("_slice")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*by, "_slice").orderBy(key, id_)
    numbered = df.withColumn("_slice", cut).withColumn("_in", F.row_number().over(inner))
    on = [numbered[c].eqNullSafe(before[c]) for c in [*by, "_slice"]]
    return numbered.join(before, on, "left").select(*[numbered[c] for c in df.columns], (F.col("_before") + F.col("_in")).cast("long").alias(out))


def clipped(p: Column, eps: float = EPS) -> Column:
    """Probabilities kept within [eps, 1 - eps] and divided by their sum."""
    c = F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps)))
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.transform(c, lambda x: x / total)


def argmax(p: Column) -> Column:
    """Index from 0 of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, i: Column) -> Column:
    return F.get(p, i.cast("int"))


def tempered(p: Column, t: Column, eps: float = 1e-12) -> Column:
    """softmax(ln p / t)."""
    z = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(eps))) / t)
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def focal_loss(p_true: Column, gamma: float = 2.0) -> Column:
    q = F.greatest(F.least(p_true, F.lit(1 - EPS)), F.lit(EPS))
    return -F.pow(1 - q, F.lit(gamma)) * F.log(q)


def review_status(valid: Column, size: Column) -> Column:
    """The four review states."""
    return F.when(~valid, "INPUT_QUALITY_FAILURE").when(size == 0, "NO_CLASS_MEETS_CONFORMAL_THRESHOLD").when(size == 1, "STANDARD_OUTPUT").otherwise("SPECIALIST_REVIEW_REQUIRED")
