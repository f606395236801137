"""SQL (DuckDB) of the cohort's building blocks, as common table expressions."""

from tessera.operators.scoring import LETTERS
from tessera.plans.cohort import CLASSES, EMBEDDING_BRANCHES

ITEMS = """items AS (SELECT doc_id AS id, lang AS cls, source, CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) >= 16 THEN 'augmented' ELSE 'original' END AS source_type, text, n_chars FROM documents)"""
CLASS_LIST = "classes AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES) + "]) AS cls)"
SPLIT = (
    ITEMS
    + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(concat(id, ':42')), id) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM items WHERE source_type = 'original'),
split AS (SELECT id, cls, source, source_type, text, n_chars, CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM placed
          UNION ALL SELECT id, cls, source, source_type, text, n_chars, 'train' FROM items WHERE source_type <> 'original')"""
)
FOLDS = (
    SPLIT
    + """,
dev AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(concat(id, ':43')), id) AS frn FROM split WHERE split = 'train' AND source_type = 'original'),
dev_sizes AS (SELECT cls, count(*) AS n FROM dev GROUP BY cls),
dev_offsets AS (SELECT cls, coalesce(sum(n) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, greatest(2, least(5, min(n) OVER ())) AS k FROM dev_sizes),
folded AS (SELECT dev.*, CAST((frn - 1 + o) % k AS INT) AS fold FROM dev JOIN dev_offsets USING (cls))"""
)


def _features(letters):
    return ", ".join(f"coalesce((length(text) - length(replace(text, '{c}', '')))::DOUBLE / nullif(length(text), 0), 0.0) AS x{i}" for i, c in enumerate(letters))


def scorer(letters=LETTERS, name="", val=False):
    """CTEs ending in oof{name} (and held{name}): id, cls, fold, y, k (class index), p, pred."""
    n = range(len(letters))
    means = ", ".join(f"avg(x{i}) AS c{i}" for i in n)
    dist = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in n)
    idx = "CASE cls " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"

    def scored(src, fold, out):
        return f""",
d{out} AS (SELECT f.id, f.cls, f.fold, {idx.replace('cls', 'f.cls', 1)} AS y, {idx.replace('cls', 'c.cls', 1)} AS k, -100.0 * round({dist}, 9) AS z FROM {src} f JOIN centres{name} c ON c.fold = {fold}),
m{out} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM d{out}),
q{out} AS (SELECT id, cls, fold, y, k, e / sum(e) OVER (PARTITION BY id) AS p FROM m{out}),
{out} AS (SELECT *, first_value(k) OVER (PARTITION BY id ORDER BY p DESC, k) AS pred FROM q{out})"""

    out = f""",
feat{name} AS (SELECT id, cls, fold, {_features(letters)} FROM folded),
ids{name} AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold),
centres{name} AS (SELECT i.fold, f.cls, {means} FROM ids{name} i JOIN feat{name} f ON f.fold <> i.fold GROUP BY i.fold, f.cls)"""
    if val:
        out += f""",
hfeat{name} AS (SELECT id, cls, -1 AS fold, split, {_features(letters)} FROM split WHERE split <> 'train')""" + scored(f"hfeat{name}", -1, f"held{name}")
        out += f""",
vrank{name} AS (SELECT id, row_number() OVER (PARTITION BY cls ORDER BY md5(concat(id, ':44')), id) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM split WHERE split = 'val'),
part AS (SELECT id, CASE WHEN rn <= round_even(n * 0.5::DOUBLE, 0) THEN 'calib' ELSE 'conf' END AS part FROM vrank{name}),
val AS (SELECT h.*, part FROM held{name} h JOIN part USING (id))"""
        return FOLDS + out
    return out + scored(f"feat{name}", "f.fold", f"oof{name}")


OOF = FOLDS + scorer()
VAL = scorer(val=True)
CONFUSION = """,
conf AS (SELECT y, pred, count(*) AS n FROM (SELECT DISTINCT id, y, pred FROM oof) GROUP BY y, pred),
grid AS (SELECT a.y, b.pred, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS y) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pred) b LEFT JOIN conf ON conf.y = a.y AND conf.pred = b.pred)"""
FOLD_CONFUSION = """,
fc AS (SELECT fold, y, pred, count(*) AS n FROM (SELECT DISTINCT id, fold, y, pred FROM oof) GROUP BY ALL),
ks AS (SELECT fold, k FROM (SELECT DISTINCT fold FROM oof) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)),
pc AS (SELECT ks.fold, ks.k, coalesce((SELECT sum(n) FROM fc WHERE fc.fold = ks.fold AND y = k), 0)::DOUBLE AS t, coalesce((SELECT sum(n) FROM fc WHERE fc.fold = ks.fold AND pred = k), 0)::DOUBLE AS p,
       coalesce((SELECT sum(n) FROM fc WHERE fc.fold = ks.fold AND y = k AND pred = k), 0)::DOUBLE AS c FROM ks),
pm AS (SELECT *, CASE WHEN t + p > 0 THEN 2 * c / (t + p) ELSE 0 END AS f1, CASE WHEN t > 0 THEN c / t END AS recall FROM pc),
fs AS (SELECT fold, avg(f1) AS macro_f1, sum(t * f1) / sum(t) AS weighted_f1, sum(c) / sum(t) AS accuracy, avg(recall) AS balanced_accuracy,
       CASE WHEN sum((t > 0)::INT) > 1 THEN CASE WHEN (sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t)) > 0 THEN (sum(c) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) ELSE 0 END END AS mcc FROM pm GROUP BY fold)"""
EMBEDDINGS = """emb AS (SELECT vec_id AS id, label::VARCHAR AS cls, embedding AS vec, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':45')), vec_id) AS rn FROM embeddings),
emb_sizes AS (SELECT cls, count(*) AS n FROM emb GROUP BY cls),
emb_offsets AS (SELECT cls, coalesce(sum(n) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM emb_sizes),
erows AS (SELECT id, emb.cls, vec, CAST((rn - 1 + o) % 5 AS INT) AS fold FROM emb JOIN emb_offsets ON emb.cls = emb_offsets.cls)"""
RANGES = "ranges AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {s}, {e})" for b, s, e in EMBEDDING_BRANCHES) + ") t(branch, start, stop))"
