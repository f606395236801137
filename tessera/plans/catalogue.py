"""Named queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import focal_loss, id_of_filename, parent_key
from tessera.operators import audit, calibration, conformal, dedup, features, labels, lineage, metrics, significance, splits
from tessera.plans import cohort as c
from tessera.plans.cohort_sql import CLASS_LIST, CONFUSION, EMBEDDINGS, FOLD_CONFUSION, FOLDS, ITEMS, OOF, RANGES, SPLIT, VAL, scorer
from tessera.operators.scoring import LETTERS
from tessera.sources.sinks import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({x: F.round(F.col(x), places) for x in columns})


# --- Labels, lineage and audit -------------------------------------------------------------------------------------


@query(
    f"""WITH {ITEMS}, {CLASS_LIST}, s AS (SELECT DISTINCT source FROM items), n AS (SELECT cls, source, count(*) AS n FROM items GROUP BY ALL),
g AS (SELECT classes.cls, s.source, coalesce(n, 0) AS n FROM classes CROSS JOIN s LEFT JOIN n ON n.cls = classes.cls AND n.source = s.source)
SELECT cls, source, n, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(sum((n > 0)::INT) OVER w AS BIGINT) AS contributing,
CASE WHEN sum(n) OVER w = 0 THEN 'ZERO' WHEN sum(n) OVER w < 50 THEN 'CRITICAL' ELSE 'OK' END AS status FROM g WINDOW w AS (PARTITION BY cls)"""
)
def q01_coverage_matrix(spark, d):
    return labels.coverage(c.items(spark, d), c.classes(spark))


MAPPING = [("orders", "1 urgent", "HIGH"), ("Orders", "2_high ", "HIGH"), ("orders", "3-Medium", "MEDIUM"), ("orders", "4-NOT SPECIFIED", "EXCLUDE_NOT_TARGET")]
MAPPING_SQL = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in MAPPING)


@query(
    f"""WITH m AS (SELECT lower(regexp_replace(trim(l), '[\\s_\\-]+', '_', 'g')) AS k, t FROM (VALUES {MAPPING_SQL}) v(d, l, t)),
o AS (SELECT o_orderpriority AS l, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(t, 'UNKNOWN') AS target, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS n_items FROM o LEFT JOIN m ON m.k = lower(regexp_replace(trim(l), '[\\s_\\-]+', '_', 'g')) GROUP BY 1"""
)
def q02_label_mapping_outcomes(spark, d):
    counts = c.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n")).withColumn("dataset", F.lit("ORDERS"))
    mapping = spark.createDataFrame(MAPPING, "dataset string, raw_label string, target string")
    return labels.outcome_rollup(labels.map_labels(counts, mapping, "dataset", "label"), "n")


@query(
    """WITH a AS (SELECT DISTINCT source AS key FROM documents), b AS (SELECT 'src' || i AS key FROM range(2, 23) t(i))
SELECT key, 'only_configured' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'only_mapped' FROM b WHERE key NOT IN (SELECT key FROM a)"""
)
def q03_mapping_key_mismatch(spark, d):
    mapped = spark.createDataFrame([(f"src{i}",) for i in range(2, 23)], "key string")
    return labels.key_mismatch(c.read(spark, d, "documents").select(F.col("source").alias("key")).distinct(), mapped)


PREFIXES = ["red", "red_widget", "small", "small_bolt", "old"]


@query(
    """WITH p AS (SELECT lower(regexp_replace(trim(p_name), '[\\s_\\-]+', '-', 'g')) AS k FROM part)
SELECT CASE WHEN starts_with(k, 'red-widget') THEN 'red_widget' WHEN starts_with(k, 'small-bolt') THEN 'small_bolt' WHEN starts_with(k, 'small') THEN 'small'
WHEN starts_with(k, 'old') THEN 'old' WHEN starts_with(k, 'red') THEN 'red' END AS prefix_class, count(*) AS n FROM p GROUP BY 1"""
)
def q04_prefix_classification(spark, d):
    return labels.prefix_class(c.read(spark, d, "part").select("p_name"), "p_name", PREFIXES).groupBy("prefix_class").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT source, cls, count(*) AS n, string_agg(DISTINCT source_type, ', ' ORDER BY source_type) AS source_types FROM items GROUP BY source, cls")
def q05_inventory_scan(spark, d):
    return labels.inventory(c.items(spark, d))


@query(f"WITH {ITEMS} SELECT cls, CAST(count_if(source_type = 'original') AS BIGINT) AS n_original, CAST(count_if(source_type = 'augmented') AS BIGINT) AS n_augmented, count_if(source_type = 'original') < 100 AS include_augmented FROM items GROUP BY cls")
def q06_augmentation_policy_auto(spark, d):
    return labels.augmentation_policy(c.items(spark, d), c.CONFIG.augmented, c.CONFIG.augmented_threshold)


VARIETY = "(length(text) - length(translate(text, '#*$%&|<>', '')))"


@query(
    f"""WITH {ITEMS}, q AS (SELECT *, concat_ws('; ', CASE WHEN n_chars < 400 THEN 'too small' END, CASE WHEN {VARIETY} * 20 > n_chars THEN 'too many symbols' END) AS reason FROM items)
SELECT id, cls, reason = '' AS passed, CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL: ' || reason END AS quality_status FROM q"""
)
def q07_quality_gate(spark, d):
    return gated(spark, d).select("id", "cls", (F.col("reason") == "").alias("passed"), lineage.quality_status(F.col("reason")).alias("quality_status"))


def gated(spark, d):
    """Items with ``reason``; size by code points, clutter by symbols."""
    rows = c.items(spark, d, "text", "n_chars")
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    reason = F.concat_ws("; ", F.when(F.col("n_chars") < 400, F.lit("too small")), F.when(symbols * 20 > F.col("n_chars"), F.lit("too many symbols")))
    return rows.withColumn("reason", reason)


@query(f"WITH {ITEMS} SELECT id, source, cls, item_no, printf('ITEM_%08d', item_no) AS item_id, printf('ITEM_%08d', item_no) AS parsed_id FROM (SELECT *, row_number() OVER (ORDER BY source, cls, id) AS item_no FROM items)")
def q08_surrogate_ids(spark, d):
    out = lineage.surrogate_ids(c.items(spark, d).select("id", "source", "cls"), ["source", "cls"], "id")
    return out.withColumn("parsed_id", id_of_filename(F.concat("item_id", F.lit("__"), "source", F.lit("__x.txt"))))


@query(f"WITH {ITEMS} SELECT coalesce(cls, 'TOTAL') AS cls, coalesce(source, 'TOTAL') AS source, count(*) AS n FROM items GROUP BY ROLLUP (cls, source)")
def q09_source_contribution_rollup(spark, d):
    return labels.contribution_rollup(c.items(spark, d))


STATUS = f"""{ITEMS}, k AS (SELECT *, min(id) OVER (PARTITION BY md5(text)) AS kept FROM items),
st AS (SELECT *, id <> kept AS duplicate, id = kept AND (n_chars < 400 OR {VARIETY} * 20 > n_chars) AS rejected FROM k),
f AS (SELECT *, NOT duplicate AND NOT rejected AND source = 'src19' AS review, NOT duplicate AND NOT rejected AND source <> 'src19' AS final FROM st)"""


def statuses(spark, d):
    """Items with the four outcomes: exact copies of a smaller id, rejected, under review, final."""
    rows = gated(spark, d).withColumn("hash", F.md5("text"))
    kept = dedup.exact_groups(rows, F.col("text")).select("hash", "kept")
    rows = rows.drop("text").join(kept, "hash", "left").withColumn("duplicate", F.coalesce(F.col("id") != F.col("kept"), F.lit(False)))
    rows = rows.withColumn("rejected", ~F.col("duplicate") & (F.col("reason") != ""))
    clean = ~F.col("duplicate") & ~F.col("rejected")
    return rows.withColumns({"review": clean & (F.col("source") == "src19"), "final": clean & (F.col("source") != "src19")})


@query(f"WITH {STATUS} SELECT cls, count(*) AS n_extracted, CAST(count_if(duplicate) AS BIGINT) AS n_duplicates, CAST(count_if(rejected) AS BIGINT) AS n_rejected, CAST(count_if(final) AS BIGINT) AS n_final FROM f GROUP BY cls")
def q10_class_balance_report(spark, d):
    return lineage.balance_report(statuses(spark, d))


@query(
    """WITH n AS (SELECT 'documents' AS source_table, lang AS cls, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'embeddings', label::VARCHAR, count(*) FROM embeddings GROUP BY 2)
SELECT source_table, arg_min(cls, (-n, cls)) AS largest, arg_min(cls, (n, cls)) AS smallest, max(n) AS n_max, min(n) AS n_min, round(max(n) / min(n), 2) AS ratio, max(n) / min(n) >= 3.0 AS warns FROM n GROUP BY 1"""
)
def q11_imbalance_ratio(spark, d):
    one = labels.imbalance(c.read(spark, d, "documents").groupBy(F.col("lang").alias("cls")).agg(F.count("*").alias("n"))).withColumn("source_table", F.lit("documents"))
    two = labels.imbalance(c.read(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("cls")).agg(F.count("*").alias("n"))).withColumn("source_table", F.lit("embeddings"))
    return one.unionByName(two)


@query(
    f"""WITH {STATUS} SELECT count(*) AS n_items, CAST(count_if(final) AS BIGINT) AS n_final, CAST(count_if(rejected) AS BIGINT) AS n_rejected, CAST(count_if(duplicate) AS BIGINT) AS n_duplicate, CAST(count_if(review) AS BIGINT) AS n_review,
CAST(count_if(final::INT + rejected::INT + duplicate::INT + review::INT = 0) AS BIGINT) AS n_unaccounted, CAST(count_if(final::INT + rejected::INT + duplicate::INT + review::INT > 1) AS BIGINT) AS n_conflicting,
count_if(final::INT + rejected::INT + duplicate::INT + review::INT <> 1) = 0 AS passed FROM f"""
)
def q12_integrity_conservation(spark, d):
    return lineage.conservation(statuses(spark, d))


@query(f"WITH {SPLIT} SELECT id, cls, source_type, split FROM split")
def q13_stratified_split(spark, d):
    return c.split_items(spark, d).select("id", "cls", "source_type", "split")


@query(f"WITH {SPLIT} SELECT split, cls, source, count(*) AS n FROM split GROUP BY GROUPING SETS ((split), (cls), (source), (split, cls), (source, cls))")
def q14_split_distributions(spark, d):
    return audit.distributions(c.split_items(spark, d))


@query(f"WITH {SPLIT}, {CLASS_LIST}, s AS (SELECT unnest(['train', 'val', 'test']) AS split), n AS (SELECT split, cls, count(*) AS n FROM split GROUP BY ALL) SELECT s.split, classes.cls, coalesce(n, 0) AS n FROM s CROSS JOIN classes LEFT JOIN n ON n.split = s.split AND n.cls = classes.cls")
def q14_split_grid(spark, d):
    return audit.split_grid(c.split_items(spark, d), spark.createDataFrame([("train",), ("val",), ("test",)], "split string"), c.classes(spark))


@query(f"WITH {FOLDS} SELECT i AS fold_id, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS split_role, id, cls FROM folded CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i)")
def q15_kfold_plan(spark, d):
    return splits.fold_plan(c.folded(spark, d), c.CONFIG.folds)


@query(f"WITH {FOLDS} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_distinct, count(*) AS n_development FROM folded")
def q15_development_union(spark, d):
    rows = c.folded(spark, d)
    return splits.development_union(splits.fold_plan(rows, c.CONFIG.folds), rows)


@query(
    f"""WITH {FOLDS}, p AS (SELECT i AS fold_id, fold = i AS val, cls, count(*) AS n FROM folded CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i) GROUP BY ALL)
SELECT fold_id, CAST(sum(n) FILTER (NOT val) AS BIGINT) AS n_train, CAST(sum(n) FILTER (val) AS BIGINT) AS n_val, '{{' || string_agg('"' || cls || '":' || n, ',' ORDER BY cls) FILTER (NOT val) || '}}' AS train_counts FROM p GROUP BY fold_id"""
)
def q15_fold_summary(spark, d):
    return splits.fold_summary(splits.fold_plan(c.folded(spark, d), c.CONFIG.folds))


@query(f"WITH {FOLDS} SELECT 'loaded' AS plan, 0 AS n_violations UNION ALL SELECT 'damaged', CAST(count_if(id % 7 = 0) + count_if(id % 7 = 1) + count_if(id % 7 = 1 AND fold = 0) AS BIGINT) FROM folded")
def q15_fold_plan_violations(spark, d):
    """A sound plan, and one in which some items are validated by no fold (id % 7 = 0) or missing from fold 0 (id % 7 = 1)."""
    from tessera.sources.files import loaded_fold_plan

    plan = splits.fold_plan(c.folded(spark, d), c.CONFIG.folds)
    seventh = F.col("id") % 7
    damaged = plan.withColumn("split_role", F.when(seventh == 0, "train").otherwise(F.col("split_role"))).filter(~((seventh == 1) & (F.col("fold_id") == 0)))
    count = lambda p, name: loaded_fold_plan(p, c.classes(spark), c.CONFIG.folds)[1].agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("plan"), "n_violations")
    return count(plan, "loaded").unionByName(count(damaged, "damaged"))


@query(f"WITH {FOLDS}, t AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(concat(id, ':47')), id) AS irn, count(*) OVER (PARTITION BY cls) AS icn FROM folded WHERE fold <> 0) SELECT cls, CASE WHEN irn <= round_even(icn * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS \"inner\", count(*) AS n FROM t GROUP BY ALL")
def q16_nested_split(spark, d):
    """The inner fifth of fold 0's training rows, by class."""
    return splits.nested_split(c.folded(spark, d).filter("fold <> 0").select("id", "cls"), c.CONFIG.seed + 5).groupBy("cls", "inner").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FOLDS}, {CLASS_LIST}, n AS (SELECT i, cls, count(*) AS n FROM folded CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE fold <> i GROUP BY ALL),
g AS (SELECT i AS fold_id, classes.cls, coalesce(n, 0) AS n_train FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i) f CROSS JOIN classes LEFT JOIN n USING (i, cls))
SELECT fold_id, cls, n_train, round(CASE WHEN n_train > 0 THEN sum(n_train) OVER (PARTITION BY fold_id) / (4.0::DOUBLE * n_train) END, 6) AS weight FROM g"""
)
def q16_fold_class_weights(spark, d):
    return rounded(splits.class_weights(c.folded(spark, d), c.classes(spark), c.CONFIG.folds), "weight")


@query(
    f"""WITH {FOLDS}, plan AS (SELECT i, fold = i AS v, id FROM folded CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i))
SELECT 'train and val of a fold are disjoint' AS "check", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM plan
UNION ALL SELECT 'each item is validated once', count(DISTINCT id), count(DISTINCT id) - CAST(count_if(v) AS BIGINT) FROM plan
UNION ALL SELECT 'no held-out item is in a fold', count(*), CAST(count_if(id IN (SELECT id FROM split WHERE split <> 'train')) AS BIGINT) FROM plan
UNION ALL SELECT 'no augmented item is in a fold', count(*), CAST(count_if(id IN (SELECT id FROM split WHERE source_type <> 'original')) AS BIGINT) FROM plan
UNION ALL SELECT 'each row has a class', count(*), CAST(0 AS BIGINT) FROM plan"""
)
def q17_fold_invariant_violations(spark, d):
    return splits.invariants(splits.fold_plan(c.folded(spark, d), c.CONFIG.folds), c.split_items(spark, d))


@query(
    f"""WITH {SPLIT}, a AS (SELECT count(DISTINCT split) AS k FROM split GROUP BY md5(text)), b AS (SELECT count(DISTINCT split) AS k FROM split GROUP BY id), g AS (SELECT count(DISTINCT split) AS k FROM split WHERE source_type = 'augmented' GROUP BY source, cls)
SELECT 'content_in_several_splits' AS kind, count(*) AS n_groups, CAST(count_if(k > 1) AS BIGINT) AS n_leaks FROM a UNION ALL SELECT 'id_in_several_splits', count(*), CAST(count_if(k > 1) AS BIGINT) FROM b
UNION ALL SELECT 'augmented_spread', count(*), CAST(count_if(k > 1) AS BIGINT) FROM g"""
)
def q18_leakage_findings(spark, d):
    return audit.leaks(c.split_items(spark, d, "text").withColumn("hash", F.md5("text")).drop("text"), "hash")


@query(
    f"""{'WITH ' + VAL}, s AS (SELECT part, cls, count(*) AS n FROM (SELECT DISTINCT id, cls, part FROM val) GROUP BY ALL)
SELECT part, cls, n, round(100.0 * n / sum(n) OVER (PARTITION BY part), 4) AS percent FROM s"""
)
def q19_calib_conf_partition(spark, d):
    parts = splits.halves(c.holdout(spark, d, "val").select("id", "cls"), c.CONFIG.seed + 2)
    counts = parts.groupBy("part", "cls").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("part")), 4))


# --- Duplicates ----------------------------------------------------------------------------------------------------


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def q20_exact_duplicate_groups(spark, d):
    return dedup.exact_groups(c.items(spark, d, "text"), F.col("text"))


def _half(first: int) -> str:
    bits = " + ".join(f"(CASE WHEN sum(((h >> {31 - i}) & 1) * 2 - 1) > 0 THEN {1 << (31 - i)} ELSE 0 END)" for i in range(32))
    return bits.replace("h >>", f"h{first} >>")


SIMHASH = f"""{ITEMS}, tok AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h0, ('0x' || substr(md5(t), 9, 8))::BIGINT AS h1 FROM (SELECT id, unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) AS t FROM items) WHERE t <> ''),
sh AS (SELECT id, CAST({_half(0)} AS BIGINT) AS lo, CAST({_half(1)} AS BIGINT) AS hi FROM tok GROUP BY id),
hashed AS (SELECT items.id, cls, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM items LEFT JOIN sh USING (id))"""
PAIRS = f"""{SIMHASH}, reps AS (SELECT cls, lo, hi, min(id) AS rep FROM hashed GROUP BY cls, lo, hi),
pairs AS (SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INT) AS distance FROM reps a JOIN reps b ON a.cls = b.cls AND a.rep < b.rep WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 5)"""


def representatives(spark, d):
    """Hashed once and written: the join of pairs reads them twice."""
    return written(dedup.representatives(dedup.simhash(c.items(spark, d, "text"), "text", "id", "cls"), ["cls"]))


@query(f"WITH {SIMHASH} SELECT id, lo, hi FROM hashed")
def q21_simhash(spark, d):
    return dedup.simhash(c.items(spark, d, "text"))


@query(f"WITH {PAIRS} SELECT a, b, distance FROM pairs")
def q21_near_duplicate_pairs(spark, d):
    return dedup.close_pairs(representatives(spark, d), c.CONFIG.duplicate_bits, within="cls")


@query(
    f"""WITH RECURSIVE {PAIRS}, later AS (SELECT a, list(b) AS bs, row_number() OVER (ORDER BY a) AS r FROM pairs GROUP BY a),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT later.r, CASE WHEN list_contains(gone, later.a) THEN gone ELSE list_concat(gone, bs) END FROM walk JOIN later ON later.r = walk.r + 1),
removed AS (SELECT DISTINCT unnest(gone) AS b FROM (SELECT gone FROM walk ORDER BY r DESC LIMIT 1))
SELECT b AS removed, min(a) AS kept FROM pairs WHERE b IN (SELECT b FROM removed) AND a NOT IN (SELECT b FROM removed) GROUP BY b"""
)
def q22_near_duplicate_greedy(spark, d):
    pairs = dedup.close_pairs(representatives(spark, d), c.CONFIG.duplicate_bits, within="cls")
    return dedup.greedy_leaders(pairs, written)


@query(f"WITH {SIMHASH}, reps AS (SELECT cls, lo, hi, min(id) AS rep FROM hashed GROUP BY cls, lo, hi) SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INT) AS distance FROM reps a JOIN reps b ON a.cls < b.cls WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 5")
def q23_cross_class_conflicts(spark, d):
    return dedup.close_pairs(representatives(spark, d), c.CONFIG.duplicate_bits, across="cls")


@query(
    f"""WITH {ITEMS} SELECT 'joined' AS side, coalesce(quality::VARCHAR, 'UNKNOWN') AS quality, count(*) AS n FROM items LEFT JOIN labels ON labels.doc_id = items.id GROUP BY 2
UNION ALL SELECT 'missing_metadata', NULL, count(*) FROM items WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan_metadata', NULL, count(*) FROM labels WHERE doc_id NOT IN (SELECT id FROM items)"""
)
def q24_metadata_join_orphans(spark, d):
    rows, meta = c.items(spark, d), c.read(spark, d, "labels").withColumnRenamed("doc_id", "id")
    joined = audit.with_metadata(rows.select("id"), meta, "id", ["quality"]).groupBy("quality").agg(F.count("*").alias("n")).select(F.lit("joined").alias("side"), "quality", "n")
    sides = spark.createDataFrame([("missing_metadata",), ("orphan_metadata",)], "side string")
    lost = sides.join(audit.orphans(rows.select("id"), meta.select("id"), "id").groupBy("side").agg(F.count("*").alias("n")), "side", "left")
    return joined.unionByName(lost.select("side", F.lit(None).cast("string").alias("quality"), F.coalesce("n", F.lit(0)).alias("n")))


@query(
    f"""WITH {ITEMS}, lost AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM items WHERE id NOT IN (SELECT doc_id FROM labels))
SELECT CAST(r AS INT) AS place, id::VARCHAR AS detail, CAST(1 AS BIGINT) AS n FROM lost WHERE r <= 50 UNION ALL SELECT 51, 'more', greatest(0, count(*) - 50) FROM lost"""
)
def q24_capped_issues(spark, d):
    rows, meta = c.items(spark, d).select("id"), c.read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return audit.capped(audit.orphans(rows, meta, "id").filter("side = 'missing_metadata'"), "id")


# --- Features ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {EMBEDDINGS}, flat AS (SELECT fold, i - 1 AS pos, vec[i]::DOUBLE AS x FROM erows, range(1, 65) t(i)),
s AS (SELECT pos, count(*) AS n, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM flat WHERE fold <> 0 GROUP BY pos)
SELECT CAST(flat.pos AS INT) AS pos, s.n, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS std, round(avg((x - mean) / sd), 6) AS mean_z, round(stddev_pop((x - mean) / sd), 6) AS std_z FROM flat JOIN s ON s.pos = flat.pos WHERE fold = 0 GROUP BY flat.pos, s.n"""
)
def q25_zscore_fold_safe(spark, d):
    rows = c.embedding_rows(spark, d)
    stats = features.column_stats(rows.filter("fold <> 0"), "vec")
    z = features.zscore(rows.filter("fold = 0"), "vec", stats).select(F.posexplode("z").alias("pos", "z"))
    held = z.groupBy("pos").agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"))
    return rounded(stats.join(held, "pos"), "mean", "std", "mean_z", "std_z")


ARM_ROWS = ", ".join(f"('{a}', {i}, '{b}', {features.BRANCHES[b]})" for a, bs in features.ARMS.items() for i, b in enumerate(bs))


@query(f"SELECT arm, branch, CAST(sum(dim) OVER (PARTITION BY arm ORDER BY i) - dim AS BIGINT) AS start, CAST(sum(dim) OVER (PARTITION BY arm ORDER BY i) AS BIGINT) AS stop, CAST(sum(dim) OVER (PARTITION BY arm) AS BIGINT) AS arm_dim FROM (VALUES {ARM_ROWS}) t(arm, i, branch, dim)")
def q26_fused_slice_map(spark, d):
    return features.slice_map(spark)


@query(
    f"""WITH {EMBEDDINGS} SELECT id, 64 AS dim, round(list_sum(list_transform(vec, lambda x: x::DOUBLE)), 4) AS checksum, CAST(0 AS BIGINT) AS n_bad FROM erows"""
)
def q26_fused_vectors(spark, d):
    rows = c.embedding_rows(spark, d)
    branches = {("color_lab" if b == "lab" else b): rows.select("id", F.slice("vec", a + 1, z - a).alias("vec")) for b, a, z in c.EMBEDDING_BRANCHES}
    fused = features.fuse(branches, "id", ["lab", "deep", "glcm", "lbp"])
    bad = features.bad_vectors(fused, "fused", 64).agg(F.count("*").alias("n_bad"))
    total = F.aggregate("fused", F.lit(0.0), lambda a, x: a + x)
    return fused.select("id", F.size("fused").alias("dim"), F.round(total, 4).alias("checksum")).join(F.broadcast(bad))


# --- Predictions, metrics, significance ----------------------------------------------------------------------------


@query(f"WITH {OOF} SELECT id, fold, cls, max(pred) AS pred, round(max(CASE WHEN k = 0 THEN p END), 6) AS p_de, round(max(CASE WHEN k = 1 THEN p END), 6) AS p_en, round(max(CASE WHEN k = 2 THEN p END), 6) AS p_es, round(max(CASE WHEN k = 3 THEN p END), 6) AS p_fr FROM oof GROUP BY id, fold, cls")
def q27_oof_predictions(spark, d):
    return c.oof(spark, d).select("id", "fold", "cls", "pred", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p_{k}") for i, k in enumerate(c.CLASSES)])


@query(f"WITH {OOF} {CONFUSION} SELECT y, pred, n FROM grid")
def q28_confusion_matrix(spark, d):
    return metrics.confusion(c.oof(spark, d), len(c.CLASSES))


@query(
    f"""WITH {OOF} {CONFUSION}, k AS (SELECT unnest([0, 1, 2, 3]) AS k), m AS (SELECT k, CAST((SELECT sum(n) FROM grid WHERE y = k) AS BIGINT) AS support, CAST((SELECT sum(n) FROM grid WHERE pred = k) AS BIGINT) AS predicted, CAST((SELECT sum(n) FROM grid WHERE y = k AND pred = k) AS BIGINT) AS tp FROM k)
SELECT k, support, predicted, tp, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS "precision", round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END, 6) AS f1 FROM m"""
)
def q29_class_metrics(spark, d):
    return rounded(metrics.class_metrics(metrics.confusion(c.oof(spark, d), len(c.CLASSES))), "precision", "recall", "f1")


def fold_summaries(preds: DataFrame, *by: str) -> DataFrame:
    return metrics.summary(metrics.class_metrics(metrics.confusion(preds, len(c.CLASSES), *by), *by), *by)


@query(f"WITH {OOF} {FOLD_CONFUSION} SELECT fold, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(mcc, 6) AS mcc FROM fs")
def q29_fold_metrics(spark, d):
    return rounded(fold_summaries(c.oof(spark, d), "fold"), *metrics.METRICS)


@query(f"WITH {OOF} {FOLD_CONFUSION} SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in metrics.METRICS) + " FROM fs")
def q29_fold_summary(spark, d):
    out = metrics.over_folds(fold_summaries(c.oof(spark, d), "fold"))
    return rounded(out, *out.columns)


ARMS_SQL = FOLDS + scorer(LETTERS[:4], "4") + scorer(LETTERS[:8], "8") + scorer(LETTERS, "12") + """,
ap AS (SELECT DISTINCT 'L4' AS arm, id, fold, y, pred FROM oof4 UNION ALL SELECT DISTINCT 'L8', id, fold, y, pred FROM oof8 UNION ALL SELECT DISTINCT 'L12', id, fold, y, pred FROM oof12)"""


@query(
    f"""WITH {ARMS_SQL}, n AS (SELECT a.arm AS arm_a, b.arm AS arm_b, CAST(count_if(a.pred <> a.y AND b.pred = b.y) AS BIGINT) AS n01, CAST(count_if(a.pred = a.y AND b.pred <> b.y) AS BIGINT) AS n10 FROM ap a JOIN ap b ON a.id = b.id AND a.arm < b.arm GROUP BY ALL)
SELECT arm_a, arm_b, n01, n10, round(CASE WHEN n01 + n10 >= 25 THEN pow(abs(n01 - n10) - 1, 2) / (n01 + n10) END, 6) AS statistic FROM n"""
)
def q30_mcnemar(spark, d):
    return rounded(significance.discordant(c.arm_predictions(spark, d)), "statistic")


@query()
def q30_mcnemar_holm(spark, d):
    return rounded(significance.mcnemar_holm(c.arm_predictions(spark, d)), "statistic", "p", "holm")


@query(
    f"""WITH {ARMS_SQL}, t AS (SELECT a.arm || '-' || b.arm AS pair, round(count_if(a.pred <> a.y AND b.pred = b.y) / count(*), 6) AS p FROM ap a JOIN ap b ON a.id = b.id AND a.arm < b.arm GROUP BY a.arm, b.arm),
r AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS rn, count(p) OVER () AS m FROM t)
SELECT pair, p, round(max(least(1.0, p * (m - rn + 1))) OVER (ORDER BY rn), 6) AS holm FROM r"""
)
def q30_holm(spark, d):
    """Holm's step on numbers that come from the arms' predictions: shares of items that only the second arm gets right."""
    n = c.arm_predictions(spark, d).agg(F.count_distinct("id").alias("n"))
    pairs = significance.discordant(c.arm_predictions(spark, d)).join(F.broadcast(n)).select(F.concat_ws("-", "arm_a", "arm_b").alias("pair"), F.round(F.col("n01") / F.col("n"), 6).alias("p"))
    return rounded(significance.holm(pairs, "p", "pair"), "holm")


@query(
    f"""WITH {OOF} {CONFUSION}, k AS (SELECT unnest([0, 1, 2, 3]) AS k), m AS (SELECT k, CAST((SELECT sum(n) FROM grid WHERE y = k) AS BIGINT) AS support, CAST((SELECT sum(n) FROM grid WHERE pred = k) AS BIGINT) AS predicted FROM k)
SELECT k, support, predicted, round(100.0::DOUBLE * support / sum(support) OVER (), 2) AS true_percent, round(100.0::DOUBLE * predicted / sum(predicted) OVER (), 2) AS predicted_percent, round(predicted / greatest(1, support), 4) AS ratio FROM m"""
)
def q31_dominance_diagnostics(spark, d):
    return metrics.dominance(metrics.confusion(c.oof(spark, d), len(c.CLASSES)))


ARM_SCORES = f"""{ARMS_SQL}, ak AS (SELECT unnest([0, 1, 2, 3]) AS k), cm AS (SELECT arm, k, CAST(count_if(y = k) AS DOUBLE) AS s, CAST(count_if(pred = k) AS DOUBLE) AS p, CAST(count_if(y = k AND pred = k) AS DOUBLE) AS t FROM ap CROSS JOIN ak GROUP BY arm, k),
ar AS (SELECT arm, CAST(substr(arm, 2) AS INT) AS dim, avg(CASE WHEN s + p > 0 THEN 2 * t / (s + p) ELSE 0 END) AS macro_f1, avg(CASE WHEN s > 0 THEN t / s END) AS balanced_accuracy FROM cm GROUP BY arm)"""


def arm_results(spark, d) -> DataFrame:
    """arm, dim, macro_f1, balanced_accuracy of the three letter sets, from their out-of-fold predictions."""
    return fold_summaries(c.arm_predictions(spark, d), "arm").select("arm", F.substring("arm", 2, 9).cast("int").alias("dim"), "macro_f1", "balanced_accuracy")


@query(f"WITH {ARM_SCORES} SELECT arm, dim, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM ar WHERE macro_f1 >= (SELECT max(macro_f1) FROM ar) - 0.005 - 1e-9 ORDER BY dim, balanced_accuracy DESC, arm LIMIT 1")
def q31_arm_selection(spark, d):
    return rounded(metrics.select_arm(arm_results(spark, d), c.CONFIG.arm_margin), "macro_f1", "balanced_accuracy")


@query(f"WITH {ARM_SCORES}, x AS (SELECT max(CASE WHEN arm = 'L4' THEN macro_f1 END) AS b, arg_max(arm, CASE WHEN arm <> 'L4' THEN macro_f1 END) AS top, max(CASE WHEN arm <> 'L4' THEN macro_f1 END) AS m FROM ar) SELECT CASE WHEN m - b > 0.005 THEN top ELSE 'L4' END AS winner FROM x")
def q31_baseline_margin_winner(spark, d):
    return metrics.beats_baseline(arm_results(spark, d), "L4", c.CONFIG.arm_margin)


@query(
    f"""WITH {ARM_SCORES}, w AS (SELECT arm FROM ar WHERE macro_f1 >= (SELECT max(macro_f1) FROM ar) - 0.005 - 1e-9 ORDER BY dim, balanced_accuracy DESC, arm LIMIT 1),
n AS (SELECT a.arm AS arm_a, b.arm AS arm_b, CAST(count_if(a.pred <> a.y AND b.pred = b.y) AS BIGINT) AS n01, CAST(count_if(a.pred = a.y AND b.pred <> b.y) AS BIGINT) AS n10 FROM ap a JOIN ap b ON a.id = b.id AND a.arm < b.arm GROUP BY ALL)
SELECT w.arm AS winner, o.arm AS other, n01, n10 FROM w JOIN ar o ON o.arm <> w.arm LEFT JOIN n ON arm_a = least(w.arm, o.arm) AND arm_b = greatest(w.arm, o.arm)"""
)
def q31_winner_evidence(spark, d):
    """The selected arm against each other one: discordant counts by unordered pair."""
    results = arm_results(spark, d)
    return significance.evidence(metrics.select_arm(results, c.CONFIG.arm_margin), results, significance.discordant(c.arm_predictions(spark, d)))


# --- Calibration and conformal sets --------------------------------------------------------------------------------

CLIP = "cl AS (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS c FROM {src}), cp AS (SELECT *, c / sum(c) OVER (PARTITION BY id) AS q FROM cl)"


@query("WITH " + VAL + ", " + CLIP.format(src="val") + ", r AS (SELECT part, id, max(CASE WHEN k = y THEN -ln(q) END) AS nll, sum(pow(q - (k = y)::INT, 2)) AS brier FROM cp GROUP BY part, id) SELECT part, count(*) AS n, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM r GROUP BY part")
def q32_nll_brier(spark, d):
    return rounded(calibration.proper_scores(c.holdout_predictions(spark, d, "val"), "part"), "nll", "brier")


BINS = """edges AS (SELECT i AS bin, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(0, 10) t(i))"""


@query(
    f"""WITH {VAL}, {BINS}, r AS (SELECT id, max(p) AS conf, max((pred = y)::INT)::DOUBLE AS ok FROM held GROUP BY id),
b AS (SELECT bin, count(*) AS n, avg(conf) AS confidence, avg(ok) AS accuracy FROM r JOIN edges ON (bin = 0 OR conf >= lo) AND (conf < hi OR bin = 9) GROUP BY bin)
SELECT CAST(edges.bin AS INT) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(n, 0) AS n, round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(accuracy, 0), 6) AS accuracy FROM edges LEFT JOIN b ON b.bin = edges.bin"""
)
def q33_reliability_bins(spark, d):
    both = c.holdout_predictions(spark, d, "val", "test")
    return rounded(calibration.reliability(both, c.CONFIG.ece_bins), "lo", "hi", "confidence", "accuracy")


@query(
    f"""WITH {VAL}, {BINS}, r AS (SELECT id, part, max(p) AS conf, max((pred = y)::INT)::DOUBLE AS ok FROM val GROUP BY id, part),
b AS (SELECT part, bin, count(*) AS n, avg(conf) AS confidence, avg(ok) AS accuracy FROM r JOIN edges ON (bin = 0 OR conf >= lo) AND (conf < hi OR bin = 9) GROUP BY part, bin)
SELECT part, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b GROUP BY part"""
)
def q33_ece(spark, d):
    return rounded(calibration.ece(calibration.reliability(c.holdout_predictions(spark, d, "val"), c.CONFIG.ece_bins, None, None, "part"), "part"), "ece")


@query(
    f"""WITH {VAL}, {BINS}, b AS (SELECT k, bin, count(*) AS n, avg(p) AS confidence, avg((k = y)::INT) AS accuracy FROM val JOIN edges ON (bin = 0 OR p >= lo) AND (p < hi OR bin = 9) GROUP BY k, bin)
SELECT k, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b GROUP BY k"""
)
def q34_per_class_ece(spark, d):
    return rounded(calibration.per_class_ece(c.holdout_predictions(spark, d, "val"), c.CONFIG.ece_bins), "ece")


@query(
    f"""WITH {VAL}, g AS (SELECT i, round(0.05::DOUBLE * exp(ln(400::DOUBLE) / 59 * i), 6) AS t FROM range(0, 60) r(i)), z AS (SELECT i, t, id, y, k, ln(greatest(p, 1e-12)) / t AS z FROM val CROSS JOIN g WHERE part = 'calib'),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY i, id)) AS e FROM z), s AS (SELECT *, e / sum(e) OVER (PARTITION BY i, id) AS p FROM e), cl AS (SELECT *, greatest(least(p, 1 - 1e-7), 1e-7) AS c FROM s),
q AS (SELECT i, t, k, y, c / sum(c) OVER (PARTITION BY i, id) AS q FROM cl) SELECT CAST(i AS INT) AS i, t, round(avg(-ln(q)), 5) AS nll FROM q WHERE k = y GROUP BY i, t"""
)
def q35_temperature_grid(spark, d):
    preds = c.holdout_predictions(spark, d, "val").filter("part = 'calib'")
    return rounded(calibration.temperature_grid(preds), "nll", places=5)


@query()
def q35_temperature_calibrated(spark, d):
    """Scores of the conformal half before and after scaling, and rows whose argmax moved (0)."""
    preds = written(c.holdout_predictions(spark, d, "val"))
    t = calibration.fit_temperature(preds.filter("part = 'calib'"))
    conf = preds.filter("part = 'conf'")
    after = calibration.apply_temperature(conf, t)
    n_moved = calibration.moved(conf, after).agg(F.count("*").alias("n_moved"))
    both = conf.withColumn("stage", F.lit("raw")).unionByName(after.withColumn("stage", F.lit("calibrated")))
    scores = calibration.proper_scores(both, "stage").join(calibration.ece(calibration.reliability(both, c.CONFIG.ece_bins, None, None, "stage"), "stage"), "stage")
    return rounded(scores.withColumn("t", F.lit(t)).crossJoin(n_moved), "nll", "brier", "ece", "t")


K = "greatest(1, least(n, CAST(ceil(round((n + 1) * 0.9::DOUBLE, 9)) AS BIGINT)))"
MARGINAL = f"""{VAL}, sc AS (SELECT id, 1 - p AS score FROM val WHERE part = 'conf' AND k = y), rk AS (SELECT *, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM sc), fit AS (SELECT n, {K} AS k, score AS q FROM rk WHERE rn = {K})"""
MONDRIAN = f"""{VAL}, sc AS (SELECT id, y, 1 - p AS score FROM val WHERE part = 'conf' AND k = y), rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY score) AS rn, count(*) OVER (PARTITION BY y) AS n FROM sc), fitted AS (SELECT y, n, {K} AS k, score AS q FROM rk WHERE rn = {K}),
fit AS (SELECT c.y, coalesce(n, 0) AS n, k, coalesce(q, 1.0) AS q, coalesce(n, 0) < 15 AS small FROM (SELECT unnest([0, 1, 2, 3]) AS y) c LEFT JOIN fitted ON fitted.y = c.y)"""
TEST_SETS = """tst AS (SELECT h.* FROM held h WHERE id NOT IN (SELECT id FROM part)), sets AS (SELECT tst.id, any_value(tst.y) AS y, any_value(pred) AS pred, max(p) AS conf, count_if(1 - p <= q) AS size, max((1 - p <= q AND tst.k = tst.y)::INT) AS covered, string_agg(CASE WHEN 1 - p <= q THEN ['de', 'en', 'es', 'fr'][tst.k + 1] END, ';' ORDER BY tst.k) AS names FROM tst JOIN fit ON {on} GROUP BY tst.id)"""
EVALUATION = "round(avg(covered), 6) AS coverage, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.5), 6) AS median_size, round(avg((size = 1)::INT), 6) AS singleton, round(avg((size = 0)::INT), 6) AS empty, round(avg((size > 1)::INT), 6) AS ambiguous"
SET_COLUMNS = ("coverage", "mean_size", "median_size", "singleton", "empty", "ambiguous")


def marginal_test_sets(spark, d):
    preds = written(c.holdout_predictions(spark, d, "val", "test"))
    fit = conformal.quantiles(preds.filter("part = 'conf'"), c.CONFIG.alpha)
    return conformal.marginal_sets(preds.filter("part = 'test'"), fit)


@query(f"WITH {MARGINAL} SELECT n, k, round(q, 6) AS q FROM fit")
def q36_conformal_fit(spark, d):
    return rounded(conformal.quantiles(c.holdout_predictions(spark, d, "val").filter("part = 'conf'"), c.CONFIG.alpha), "q")


@query(f"WITH {MARGINAL}, {TEST_SETS.format(on='true')} SELECT count(*) AS n, {EVALUATION} FROM sets")
def q36_conformal_marginal(spark, d):
    return rounded(conformal.evaluation(marginal_test_sets(spark, d)), *SET_COLUMNS)


@query(f"WITH {MARGINAL}, {TEST_SETS.format(on='true')} SELECT CAST(s AS INT) AS size, (SELECT count(*) FROM sets WHERE size = s) AS n FROM range(0, 5) t(s)")
def q36_set_sizes(spark, d):
    return conformal.size_histogram(marginal_test_sets(spark, d), len(c.CLASSES))


@query(f"WITH {MARGINAL}, tst AS (SELECT h.* FROM held h WHERE id NOT IN (SELECT id FROM part)) SELECT tst.k, round(avg((1 - p <= q)::INT), 6) AS rate FROM tst CROSS JOIN fit GROUP BY tst.k")
def q36_inclusion_rates(spark, d):
    return rounded(conformal.inclusion_rates(marginal_test_sets(spark, d), len(c.CLASSES)), "rate")


@query(f"WITH {MONDRIAN} SELECT y, n, k, round(q, 6) AS q, small FROM fit")
def q37_mondrian_fit(spark, d):
    return rounded(conformal.by_class(c.holdout_predictions(spark, d, "val").filter("part = 'conf'"), c.CONFIG.alpha, len(c.CLASSES)), "q")


@query(f"WITH {MONDRIAN}, {TEST_SETS.format(on='fit.y = tst.k')} SELECT y, count(*) AS n, {EVALUATION} FROM sets GROUP BY y")
def q37_conformal_mondrian(spark, d):
    preds = written(c.holdout_predictions(spark, d, "val", "test"))
    fit = conformal.by_class(preds.filter("part = 'conf'"), c.CONFIG.alpha, len(c.CLASSES))
    return rounded(conformal.evaluation(conformal.mondrian_sets(preds.filter("part = 'test'"), fit), "y"), *SET_COLUMNS)


@query(
    f"""WITH {MARGINAL}, {TEST_SETS.format(on='true')}, v AS (SELECT sets.*, n_chars >= 400 AS ok FROM sets JOIN items USING (id))
SELECT id, CASE WHEN ok THEN ['de', 'en', 'es', 'fr'][pred + 1] END AS label, round(CASE WHEN ok THEN conf END, 6) AS confidence, CASE WHEN ok THEN coalesce(names, '') END AS prediction_set,
CASE WHEN NOT ok THEN 'INPUT_QUALITY_FAILURE' WHEN size = 0 THEN 'NO_CLASS_MEETS_CONFORMAL_THRESHOLD' WHEN size = 1 THEN 'STANDARD_OUTPUT' ELSE 'SPECIALIST_REVIEW_REQUIRED' END AS status FROM v"""
)
def q38_triage_status(spark, d):
    sets = marginal_test_sets(spark, d).join(c.items(spark, d, "n_chars").select("id", "n_chars"), "id")
    return rounded(conformal.triage(sets, F.col("n_chars") >= 400, c.CLASSES), "confidence").drop("size")


# --- Selection, freezes, samples, lineage, attribution -------------------------------------------------------------

POPULATION = [(i, j, ((7 * i + 3 * j) % 11 - 5) / 2.0, (i * j) % 2) for i in range(6) for j in range(8)]
POPULATION_SQL = ", ".join(f"({i}, {j}, {dx}::DOUBLE, {b})" for i, j, dx, b in POPULATION)


@query(f"SELECT i, j, CAST(CASE WHEN abs((exp(3.0 * dx) - exp(-3.0 * dx)) / (exp(3.0 * dx) + exp(-3.0 * dx))) > ((i * 5 + j * 3) % 10) / 10.0::DOUBLE THEN 1 - bit ELSE bit END AS INT) AS bit FROM (VALUES {POPULATION_SQL}) t(i, j, dx, bit)")
def q39_bda_transfer_step(spark, d):
    from tessera.operators.selection import flip

    rows = spark.createDataFrame(POPULATION, "i int, j int, dx double, bit int")
    draw = ((F.col("i") * 5 + F.col("j") * 3) % 10) / 10.0
    return rows.select("i", "j", flip(F.col("bit"), F.col("dx"), draw, 3.0).alias("bit"))


MASKS = f"""{EMBEDDINGS}, flat AS (SELECT fold, i - 1 AS pos, vec[i]::DOUBLE AS x FROM erows, range(1, 65) t(i)), v AS (SELECT f.fold, flat.pos, round(avg(x * x) - pow(avg(x), 2), 9) AS v FROM (SELECT DISTINCT fold FROM erows) f JOIN flat ON flat.fold <> f.fold GROUP BY ALL),
masks AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY v DESC, pos) <= 20 AS selected FROM v)"""
JACCARD = f"""{MASKS}, sets AS (SELECT fold, list(pos) FILTER (selected) AS s FROM masks GROUP BY fold), j AS (SELECT a.fold AS fold_a, b.fold AS fold_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM sets a JOIN sets b ON a.fold < b.fold)"""


def masks(spark, d):
    return features.variance_masks(c.embedding_rows(spark, d), "vec", 20, c.CONFIG.folds)


@query(f"WITH {JACCARD} SELECT fold_a, fold_b, round(jaccard, 6) AS jaccard FROM j")
def q40_mask_jaccard(spark, d):
    return rounded(features.jaccard(masks(spark, d)), "jaccard")


@query(f"WITH {JACCARD} SELECT round(avg(jaccard), 6) AS mean, round(quantile_cont(jaccard, 0.5), 6) AS median, round(min(jaccard), 6) AS min, round(max(jaccard), 6) AS max FROM j")
def q40_jaccard_summary(spark, d):
    return rounded(features.jaccard_summary(features.jaccard(masks(spark, d))), "mean", "median", "min", "max")


@query(f"WITH {MASKS}, {RANGES} SELECT fold, branch, count(*) AS total, CAST(count_if(selected) AS BIGINT) AS retained FROM masks JOIN ranges ON pos >= start AND pos < stop GROUP BY ALL")
def q40_branch_retained(spark, d):
    return features.branch_retained(masks(spark, d), c.branch_ranges(spark))


@query(f"WITH {MASKS}, {RANGES}, r AS (SELECT fold, branch, count(*) AS total, count_if(selected) AS retained FROM masks JOIN ranges ON pos >= start AND pos < stop GROUP BY ALL) SELECT branch, round(avg(retained), 6) AS mean_retained, round(stddev_pop(retained), 6) AS std_retained, round(100 * avg(retained / total), 6) AS percent FROM r GROUP BY branch")
def q40_family_breakdown(spark, d):
    return rounded(features.family_breakdown(features.branch_retained(masks(spark, d), c.branch_ranges(spark))), "mean_retained", "std_retained", "percent")


@query(
    f"""WITH {MASKS}, {RANGES}, sets AS (SELECT branch, fold, list(pos) FILTER (selected) AS s FROM masks JOIN ranges ON pos >= start AND pos < stop GROUP BY ALL),
j AS (SELECT a.branch, CASE WHEN len(coalesce(a.s, [])) + len(coalesce(b.s, [])) = 0 THEN 1 ELSE len(list_intersect(coalesce(a.s, []), coalesce(b.s, []))) / len(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))) END AS jaccard FROM sets a JOIN sets b ON a.branch = b.branch AND a.fold < b.fold)
SELECT branch, round(avg(jaccard), 6) AS mean_jaccard FROM j GROUP BY branch"""
)
def q40_branch_jaccard(spark, d):
    return rounded(features.branch_jaccard(masks(spark, d), c.branch_ranges(spark)), "mean_jaccard")


@query(f"WITH {MASKS}, n AS (SELECT fold, count_if(selected) AS n FROM masks GROUP BY fold) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, string_agg(n::VARCHAR, ',' ORDER BY fold) AS per_fold FROM n")
def q40_dimension_stats(spark, d):
    return rounded(features.dimension_stats(masks(spark, d)), "mean", "std")


@query(f"WITH {MASKS}, {RANGES} SELECT fold, string_agg(branch || '_' || lpad((pos - start)::VARCHAR, 3, '0'), ';' ORDER BY pos) AS names FROM masks JOIN ranges ON pos >= start AND pos < stop WHERE selected GROUP BY fold")
def q40_selected_names(spark, d):
    from tessera.operators.selection import selected_names

    names = tuple(f"{b}_{i:03d}" for b, lo, hi in c.EMBEDDING_BRANCHES for i in range(hi - lo))
    chosen: dict[int, list[bool]] = {}
    for r in masks(spark, d).orderBy("fold", "pos").collect():  # folds x places rows
        chosen.setdefault(r.fold, []).append(r.selected)
    return spark.createDataFrame([(f, ";".join(selected_names(m, names))) for f, m in chosen.items()], "fold int, names string")


FROZEN = "fz AS (SELECT regexp_replace(url, '^https?://', '') || '#' || page_id AS rel_path, sha256(coalesce(html, '')) AS sha256 FROM pages)"


def frozen(spark, d):
    pages = c.read(spark, d, "pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("#"), F.col("page_id").cast("string")).alias("rel_path"), F.col("html").alias("content"))
    return audit.freeze(pages)


@query(
    f"""WITH {FROZEN}, b AS (SELECT substr(md5(rel_path), 1, 2) AS bucket, sha256(string_agg(rel_path || ':' || sha256, '' ORDER BY rel_path || ':' || sha256)) AS h, count(*) AS n FROM fz GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(h, '' ORDER BY bucket)) AS aggregate_hash FROM b"""
)
def q41_freeze_manifest(spark, d):
    return audit.freeze_manifest(frozen(spark, d))


@query(
    f"""WITH {FROZEN}, old AS (SELECT * FROM fz WHERE substr(sha256, 1, 1) <> '0'), new AS (SELECT rel_path, CASE WHEN substr(sha256, 1, 1) = '1' THEN 'x' ELSE sha256 END AS sha256 FROM fz WHERE substr(sha256, 1, 1) <> '2')
SELECT coalesce(old.rel_path, new.rel_path) AS rel_path, CASE WHEN old.rel_path IS NULL THEN 'ADDED' WHEN new.rel_path IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM old FULL JOIN new ON old.rel_path = new.rel_path WHERE old.sha256 IS DISTINCT FROM new.sha256"""
)
def q41_freeze_diff(spark, d):
    fz = frozen(spark, d)
    first = F.substring("sha256", 1, 1)
    new = fz.filter(first != "2").withColumn("sha256", F.when(first == "1", "x").otherwise(F.col("sha256")))
    return audit.freeze_diff(fz.filter(first != "0"), new)


@query("SELECT id, cls, rn FROM (SELECT vec_id AS id, label::VARCHAR AS cls, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':46')), vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def q42_seeded_class_sample(spark, d):
    rows = c.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cls"))
    return splits.seeded_sample(rows, 5, c.CONFIG.seed + 4)


@query(
    f"""WITH {SPLIT}, p AS (SELECT split, lower(regexp_replace(regexp_replace('Doc (' || (id % 50) || ').txt', '\\.[^.]*$', ''), '[\\s()_]+', '', 'g')) AS key FROM split WHERE split <> 'train'),
k AS (SELECT lower(regexp_replace(regexp_replace(regexp_replace('doc_' || (id % 50) || '_' || id || '.txt', '\\.[^.]*$', ''), '_\\d+$', ''), '[\\s()_]+', '', 'g')) AS key FROM split WHERE source_type = 'augmented'),
n AS (SELECT key, count(*) AS n FROM k GROUP BY key) SELECT split, count(*) AS n_parents, CAST(sum(n) AS BIGINT) AS n_descendants FROM p JOIN n USING (key) GROUP BY split"""
)
def q43_lineage_parent_leak(spark, d):
    rows = c.split_items(spark, d)
    group = (F.col("id") % 50).cast("string")
    parents = rows.filter("split <> 'train'").select("split", parent_key(F.concat(F.lit("Doc ("), group, F.lit(").txt")), F.lit(False)).alias("key"))
    children = rows.filter("source_type = 'augmented'").select(parent_key(F.concat(F.lit("doc_"), group, F.lit("_"), F.col("id").cast("string"), F.lit(".txt")), F.lit(True)).alias("key"))
    return lineage.parent_leaks(children, parents)


@query(
    f"""WITH {EMBEDDINGS}, {RANGES}, flat AS (SELECT cls, i - 1 AS pos, vec[i]::DOUBLE AS x FROM erows, range(1, 65) t(i)), mn AS (SELECT pos, avg(x) AS mean, avg(CASE WHEN cls = '0' THEN x END) - avg(CASE WHEN cls = '1' THEN x END) AS w FROM flat GROUP BY pos),
a AS (SELECT flat.pos, avg(abs(w * (x - mean))) AS a FROM flat JOIN mn USING (pos) GROUP BY flat.pos), b AS (SELECT branch, sum(a) AS total, avg(a) AS mean FROM a JOIN ranges ON pos >= start AND pos < stop GROUP BY branch)
SELECT branch, round(total, 6) AS total, round(mean, 6) AS mean, round(100 * total / sum(total) OVER (), 4) AS percent, CAST(row_number() OVER (ORDER BY round(total, 9) DESC, branch) AS INT) AS rank FROM b"""
)
def q44_attribution_rollup(spark, d):
    per = places(spark, d)
    return features.attribution_rollup(per, c.branch_ranges(spark)).select("branch", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), F.round("percent", 4).alias("percent"), "rank")


def places(spark, d):
    """Attribution of each embedding place to the linear scorer between classes 0 and 1."""
    rows = c.embedding_rows(spark, d)
    flat = rows.select("cls", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = flat.groupBy("pos").agg(F.avg("x").alias("mean"), (F.avg(F.when(F.col("cls") == "0", F.col("x"))) - F.avg(F.when(F.col("cls") == "1", F.col("x")))).alias("w"))
    return features.attribution(rows, "vec", stats.select("pos", "mean"), stats.select("pos", "w"))


@query(
    f"""WITH {EMBEDDINGS}, flat AS (SELECT cls, i - 1 AS pos, vec[i]::DOUBLE AS x FROM erows, range(1, 65) t(i)), mn AS (SELECT pos, avg(x) AS mean, avg(CASE WHEN cls = '0' THEN x END) - avg(CASE WHEN cls = '1' THEN x END) AS w FROM flat GROUP BY pos),
a AS (SELECT flat.pos, round(avg(abs(w * (x - mean))), 6) AS attribution FROM flat JOIN mn USING (pos) GROUP BY flat.pos) SELECT CAST(pos AS INT) AS pos, attribution FROM a ORDER BY attribution DESC, pos LIMIT 10"""
)
def q44_top_features(spark, d):
    return rounded(places(spark, d), "attribution").orderBy(F.col("attribution").desc(), "pos").limit(10)


@query("WITH " + OOF + " SELECT fold, round(avg(-pow(1 - greatest(least(p, 1 - 1e-7), 1e-7), 2.0) * ln(greatest(least(p, 1 - 1e-7), 1e-7))), 6) AS focal_loss FROM oof WHERE k = y GROUP BY fold")
def q45_focal_loss(spark, d):
    return rounded(c.oof(spark, d).groupBy("fold").agg(F.avg(focal_loss(F.get("p", F.col("y")))).alias("focal_loss")), "focal_loss")


# --- Spark ML, searches and gates ----------------------------------------------------------------------------------


def _rows(spark, d):
    """All labelled embeddings as id, cls, fold, y (place of the label among those present), vec; and the labels."""
    rows = c.embedding_rows(spark, d).filter("cls IS NOT NULL")
    labels = sorted((r.cls for r in rows.select("cls").distinct().collect()), key=lambda x: (len(x), x))  # one row a class
    return rows.withColumn("y", (F.array_position(F.array(*map(F.lit, labels)), F.col("cls")) - 1).cast("double")), labels


def _cv(spark, d, name):
    from tessera.operators.models import cross_validate

    rows, labels = _rows(spark, d)
    preds = cross_validate(rows, name, c.CONFIG.folds, c.CONFIG.seed)
    return rounded(metrics.summary(metrics.class_metrics(metrics.confusion(preds, len(labels), "fold"), "fold"), "fold"), *metrics.METRICS)


@query()
def q45_rf_cv(spark, d):
    return _cv(spark, d, "random_forest")


@query()
def q45_lr_cv(spark, d):
    return _cv(spark, d, "logistic_regression")


@query()
def q45_calibrators(spark, d):
    """Scores of the conformal half, raw and by each calibrator."""
    from tessera.operators.models import calibrate

    preds = written(c.holdout_predictions(spark, d, "val"))
    calib, conf = preds.filter("part = 'calib'"), preds.filter("part = 'conf'")
    out = None
    for method in ("none", "platt", "isotonic"):
        one = calibration.proper_scores(calibrate(calib, conf, len(c.CLASSES), method, c.CONFIG.min_calibration).withColumn("method", F.lit(method)), "method")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "nll", "brier")


@query()
def q45_pca(spark, d):
    from tessera.operators.models import fold_safe_pca

    out = fold_safe_pca(c.embedding_rows(spark, d), "vec", c.CONFIG.max_pca, 64)
    return out.select("id", F.size("reduced").alias("dim"), F.round(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


def _search(spark, d, name):
    from tessera.operators import selection

    rows = written(_rows(spark, d)[0].select("id", "cls", "vec").repartition(8))
    fitness = selection.mask_fitness(rows, "vec", 64)
    run = {"ga": lambda: selection.select_ga(fitness, 64, c.CONFIG.seed), "bda": lambda: selection.select_bda(fitness, 64, c.CONFIG.seed)}[name]
    mask, history = run()
    return spark.createDataFrame([(i, bool(b), float(history[-1])) for i, b in enumerate(mask)], "pos int, selected boolean, best_fitness double")


@query()
def q46_ga_select(spark, d):
    return _search(spark, d, "ga")


@query()
def q46_bda_select(spark, d):
    return _search(spark, d, "bda")


@query()
def q46_rfe_select(spark, d):
    """Elimination by logistic-regression weights, 64 places to 16."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    import numpy as np

    from tessera.operators.selection import select_rfe

    rows = written(_rows(spark, d)[0].select("y", F.col("vec").cast("array<double>").alias("vec")))

    def weights(mask):
        places = F.array(*[F.lit(int(i)) for i in np.flatnonzero(mask)])
        data = rows.select("y", array_to_vector(F.transform(places, lambda i: F.get("vec", i))).alias("features"))
        return np.abs(LogisticRegression(labelCol="y", regParam=0.01, maxIter=20).fit(data).coefficientMatrix.toArray()).sum(0)

    mask = select_rfe(weights, 64, 16, 0.25)
    return spark.createDataFrame([(i, bool(b)) for i, b in enumerate(mask)], "pos int, selected boolean")


@query(
    f"""WITH {VAL}, bad AS (SELECT id, sum(p) AS s, min(p) AS lo FROM val GROUP BY id) SELECT count(*) AS n_rows, CAST(count_if(abs(s - 1) > 1e-5 OR lo < 0) AS BIGINT) AS n_violations FROM bad"""
)
def q47_probability_validity(spark, d):
    from tessera.operators.gates import probability_validity

    preds = c.holdout_predictions(spark, d, "val")
    return preds.agg(F.count("*").alias("n_rows")).crossJoin(probability_validity(preds, len(c.CLASSES)).agg(F.count("*").alias("n_violations")))


@query(
    f"""WITH {VAL}, a AS (SELECT id, 'train' AS part FROM folded UNION ALL SELECT DISTINCT id, part FROM val UNION ALL SELECT id, 'test' FROM split WHERE split = 'test'), k AS (SELECT id, count(DISTINCT part) AS k FROM a GROUP BY id)
SELECT count(*) AS n_ids, CAST(count_if(k > 1) AS BIGINT) AS n_shared FROM k"""
)
def q47_partition_isolation(spark, d):
    parts = splits.halves(c.holdout(spark, d, "val").select("id", "cls"), c.CONFIG.seed + 2).select("id", "part")
    parts = parts.unionByName(c.folded(spark, d).select("id", F.lit("train").alias("part"))).unionByName(c.holdout(spark, d, "test").select("id", F.lit("test").alias("part")))
    return splits.isolation(parts)


@query(
    f"""WITH {OOF} {FOLD_CONFUSION}, r AS (SELECT 'L12' AS arm, avg(macro_f1) AS m, count(*) AS n FROM fs), s AS (SELECT * FROM (VALUES ('L12', 0.5::DOUBLE), ('L99', 0.5)) v(arm, macro_f1))
SELECT s.arm AS detail, 'all folds' AS "check" FROM s LEFT JOIN r ON r.arm = s.arm WHERE coalesce(n, 0) <> 5 UNION ALL SELECT s.arm, 'mean' FROM s LEFT JOIN r ON r.arm = s.arm WHERE m IS NULL OR abs(m - macro_f1) > 1e-4"""
)
def q47_winner_contract(spark, d):
    from tessera.operators.gates import winner_contract

    rows = fold_summaries(c.oof(spark, d), "fold").withColumn("arm", F.lit("L12"))
    stored = spark.createDataFrame([("L12", 0.5), ("L99", 0.5)], "arm string, macro_f1 double")
    return winner_contract(stored, rows, c.CONFIG.folds)


@query("SELECT \"check\", count(*) AS n FROM (SELECT 'missing' AS \"check\" FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1")
def q47_cache_preflight(spark, d):
    from tessera.operators.gates import missing_cache

    return missing_cache(c.read(spark, d, "documents").select("doc_id"), c.read(spark, d, "labels").select("doc_id"), "doc_id").groupBy("check").agg(F.count("*").alias("n"))


@query(
    f"""WITH {VAL}, a AS (SELECT id, 'train' AS part FROM folded UNION ALL SELECT DISTINCT id, part FROM val), g AS (
SELECT 'probabilities' AS gate, CAST(count_if(abs(s - 1) > 1e-5 OR lo < 0) AS BIGINT) AS n_violations FROM (SELECT id, sum(p) AS s, min(p) AS lo FROM val GROUP BY id)
UNION ALL SELECT 'isolation', CAST(count_if(k > 1) AS BIGINT) FROM (SELECT id, count(DISTINCT part) AS k FROM a GROUP BY id)
UNION ALL SELECT 'labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), t AS (SELECT * FROM g UNION ALL SELECT 'all', CAST(sum(n_violations) AS BIGINT) FROM g)
SELECT gate, n_violations, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t"""
)
def q47_composed_gates(spark, d):
    """Probabilities are valid, training and validation rows are apart, every document has labels (many have none)."""
    from tessera.operators.gates import composed, missing_cache, probability_validity

    preds = c.holdout_predictions(spark, d, "val")
    parts = preds.select("id", "part").unionByName(c.folded(spark, d).select("id", F.lit("train").alias("part")))
    shared = parts.groupBy("id").agg(F.count_distinct("part").alias("k")).filter("k > 1")
    labelled = missing_cache(c.read(spark, d, "documents").select("doc_id"), c.read(spark, d, "labels").select("doc_id"), "doc_id")
    return composed({"probabilities": probability_validity(preds, len(c.CLASSES)), "isolation": shared, "labels": labelled.filter("check = 'missing'")})


MANIFESTS = [(0, "x1", 1298, True), (1, "x1", 1298, False), (2, "x2", 1298, True), (3, "x1", 1316, True), (4, None, 1298, True)]


@query(
    """SELECT fold, CASE WHEN e IS DISTINCT FROM 'x1' THEN 'experiment' WHEN dim IS DISTINCT FROM 1298 THEN 'dimension' WHEN NOT complete THEN 'complete' END AS reason
FROM (VALUES (0, 'x1', 1298, true), (1, 'x1', 1298, false), (2, 'x2', 1298, true), (3, 'x1', 1316, true), (4, NULL, 1298, true)) t(fold, e, dim, complete)"""
)
def q47_fold_cache_validation(spark, d):
    from tessera.operators.gates import first_failure

    rows = spark.createDataFrame(MANIFESTS, "fold int, experiment string, dim int, complete boolean")
    checks = {"experiment": F.col("experiment") == "x1", "dimension": F.col("dim") == 1298, "complete": F.col("complete")}
    return rows.select("fold", first_failure(checks).alias("reason"))


@query(
    f"""WITH {scorer(val=True)}, {{gates}}
SELECT CASE WHEN m >= 0.70 AND least >= 0.50 AND r <= 1.15 AND c >= 0.65 THEN 'CERTIFIED_WINNER' ELSE 'FALLBACK' END AS status, round(m, 6) AS m, round(least, 6) AS least, round(r, 6) AS r, round(c, 6) AS c FROM a, h""".replace(
        "{gates}",
        """ks AS (SELECT unnest([0, 1, 2, 3]) AS k), op AS (SELECT DISTINCT id, y, pred FROM oofx), hp AS (SELECT DISTINCT id, y, pred FROM val),
oc AS (SELECT k, CAST(count_if(y = k) AS DOUBLE) AS s, CAST(count_if(pred = k) AS DOUBLE) AS p, CAST(count_if(y = k AND pred = k) AS DOUBLE) AS t FROM op CROSS JOIN ks GROUP BY k),
hc AS (SELECT k, CAST(count_if(y = k) AS DOUBLE) AS s, CAST(count_if(pred = k) AS DOUBLE) AS p, CAST(count_if(y = k AND pred = k) AS DOUBLE) AS t FROM hp CROSS JOIN ks GROUP BY k),
a AS (SELECT avg(CASE WHEN s + p > 0 THEN 2 * t / (s + p) ELSE 0 END) AS m, min(CASE WHEN s + p > 0 THEN 2 * t / (s + p) ELSE 0 END) AS least, max(round(p / greatest(1, s), 4)) AS r FROM oc),
h AS (SELECT avg(CASE WHEN s + p > 0 THEN 2 * t / (s + p) ELSE 0 END) AS c FROM hc)""",
    ).replace(", ks AS", scorer(name="x").removeprefix(FOLDS) + ", ks AS", 1)
)
def q47_run_gates(spark, d):
    from tessera.operators.gates import run_gates

    conf = metrics.confusion(c.oof(spark, d), len(c.CLASSES))
    per = metrics.class_metrics(conf)
    held = metrics.summary(metrics.class_metrics(metrics.confusion(c.holdout_predictions(spark, d, "val"), len(c.CLASSES))))
    out = run_gates(per, metrics.summary(per), metrics.dominance(conf), held)
    return rounded(out, "m", "least", "r", "c")


@query(
    f"""WITH {VAL}, t AS (SELECT id, any_value(y) AS y, any_value(pred) AS pred FROM held WHERE id NOT IN (SELECT id FROM part) GROUP BY id), ks AS (SELECT unnest([0, 1, 2, 3]) AS k),
m AS (SELECT k, (SELECT count(*) FROM t WHERE y = k)::DOUBLE AS s, (SELECT count(*) FROM t WHERE pred = k)::DOUBLE AS p, (SELECT count(*) FROM t WHERE y = k AND pred = k)::DOUBLE AS c FROM ks)
SELECT round(avg(CASE WHEN s + p > 0 THEN 2 * c / (s + p) ELSE 0 END), 6) AS macro_f1, round(sum(c) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s > 0 THEN c / s END), 6) AS balanced_accuracy FROM m"""
)
def q48_locked_test(spark, d):
    from tessera.operators.gates import locked_test

    preds = c.holdout_predictions(spark, d, "test")
    rows = locked_test(True, preds, splits.expected_test_rows(c.items(spark, d), c.CONFIG.train_ratio, c.CONFIG.val_ratio))
    return rounded(metrics.summary(metrics.class_metrics(metrics.confusion(rows, len(c.CLASSES)))), *metrics.METRICS).select("macro_f1", "accuracy", "balanced_accuracy")


@query("WITH " + FOLDS + ", b AS (SELECT arg_min(cls, (-n, cls)) AS pred FROM dev_sizes) SELECT pred, count(*) AS n, CAST(count_if(cls = pred) AS BIGINT) AS n_right FROM folded CROSS JOIN b GROUP BY pred")
def q48_majority_baseline(spark, d):
    rows = c.folded(spark, d)
    best = rows.groupBy("cls").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cls"))["cls"].alias("pred"))
    return rows.join(F.broadcast(best)).groupBy("pred").agg(F.count("*").alias("n"), F.count_if(F.col("cls") == F.col("pred")).alias("n_right"))


FINAL = f"""{EMBEDDINGS}, flat AS (SELECT id, cls, fold, i - 1 AS pos, vec[i]::DOUBLE AS x FROM erows, range(1, 65) t(i)),
st AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS s FROM flat WHERE fold < 4 GROUP BY pos), z AS (SELECT id, cls, fold, flat.pos, (x - m) / s AS z FROM flat JOIN st ON st.pos = flat.pos),
ce AS (SELECT cls, pos, avg(z) AS c FROM z WHERE fold < 4 AND cls IS NOT NULL GROUP BY ALL), dd AS (SELECT z.id, z.cls AS y, ce.cls AS k, round(sum((z.z - c) * (z.z - c)), 6) AS d FROM z JOIN ce ON ce.pos = z.pos WHERE fold = 4 GROUP BY z.id, z.cls, ce.cls),
fin AS (SELECT id, y, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM dd) WHERE r = 1)"""


@query(f"WITH {FINAL} SELECT id, y, pred FROM fin")
def q48_final_retrain(spark, d):
    """Normaliser and centres of all training rows (folds 0 to 3), and the holdout (fold 4) scored by them."""
    rows = c.embedding_rows(spark, d)
    return features.final_scores(rows.filter("fold = 4"), "vec", *features.final_fit(rows.filter("fold < 4"), "vec"))


REASON = "CASE WHEN coalesce(text, '') = '' THEN 'MISSING' WHEN length(text) < 32 THEN 'TOO_SMALL' WHEN length(replace(text, substr(text, 1, 1), '')) = 0 THEN 'UNIFORM' END"


def _frozen(spark, d):
    """The scorer's arrays, its temperature 1 over the sharpness, and the conformal half's quantile."""
    from tessera.operators.inference import Frozen
    from tessera.operators.scoring import SHARPNESS, centroids, letter_features

    train = c.base(spark, d).filter("split = 'train' AND source_type = 'original'").select("cls", F.lit(0).alias("fold"), "x")
    centres = {r.cls: list(r.c) for r in centroids(train, 0, len(LETTERS)).filter("fold = -1").collect()}  # one row a class
    q = conformal.quantiles(c.holdout_predictions(spark, d, "val").filter("part = 'conf'"), c.CONFIG.alpha).first()
    dim = len(LETTERS)
    return Frozen(lambda x: F.array(*letter_features(x)), [0.0] * dim, [1.0] * dim, [True] * dim, [centres[k] for k in c.CLASSES], 1 / SHARPNESS, q.q if q else 1.0, c.CLASSES)


@query(
    f"""WITH {MARGINAL}, x AS (SELECT doc_id AS id, {REASON} AS reason FROM documents)
SELECT coalesce(reason, 'usable') AS reason, CASE WHEN reason IS NULL THEN 'status' ELSE 'validate' END AS stage, count(*) AS n FROM x GROUP BY ALL"""
)
def q49_inference_stages(spark, d):
    """Every document through the nine stages: how far they come, and why some stop."""
    return inferred(spark, d).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason"), "stage").agg(F.count("*").alias("n"))


def inferred(spark, d) -> DataFrame:
    from tessera.operators.inference import infer, invalid_reason

    rows = c.items(spark, d, "text").select("id", "text")
    spread = F.length(F.replace(F.col("text"), F.substring("text", 1, 1))).cast("double")
    return infer(rows, "text", invalid_reason(F.length("text") > 0, F.length("text"), spread), _frozen(spark, d))


@query(
    f"""WITH {MARGINAL}, {TEST_SETS.format(on='true')}, x AS (SELECT doc_id AS id, {REASON} AS reason FROM documents)
SELECT id, CASE WHEN reason IS NULL THEN ['de', 'en', 'es', 'fr'][pred + 1] END AS label, CASE WHEN reason IS NULL THEN coalesce(names, '') END AS prediction_set,
CASE WHEN reason IS NOT NULL THEN 'INPUT_QUALITY_FAILURE' WHEN size = 0 THEN 'NO_CLASS_MEETS_CONFORMAL_THRESHOLD' WHEN size = 1 THEN 'STANDARD_OUTPUT' ELSE 'SPECIALIST_REVIEW_REQUIRED' END AS status FROM sets JOIN x USING (id)"""
)
def q49_inference(spark, d):
    """Labels, sets and statuses of the held-out test rows by the batch pipeline."""
    test = c.holdout(spark, d, "test").select("id")
    return inferred(spark, d).join(test, "id", "left_semi").select("id", "label", "prediction_set", "status")


def images(spark, d) -> DataFrame:
    """id, height, width, pixels: each embedding drawn as a 64 x 64 image; every ninth row lacks its last byte."""
    side = 64
    rows = c.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.pmod(F.floor(x * 512 + 128), F.lit(256)).cast("int")).alias("v"))
    digits = F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    row = F.concat(digits, digits, digits)  # 64 pixels of 3 bytes
    shifted = [F.concat(F.expr(f"substr(r, {1 + 6 * i})"), F.expr(f"substr(r, 1, {6 * i})")) for i in range(0, side, 8)]
    whole = F.repeat(F.concat(*shifted), side // len(shifted))
    body = rows.withColumn("r", row).select("id", F.lit(side).alias("height"), F.lit(side).alias("width"), F.unhex(whole).alias("pixels"))
    return body.withColumn("pixels", F.when(F.col("id") % 9 == 0, F.expr("substr(pixels, 1, length(pixels) - 1)")).otherwise(F.col("pixels")))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 'pixels do not fill the size' END AS error, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 12 END AS n_glcm, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 18 END AS n_lbp, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 36 END AS n_hog, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 6 END AS n_lab, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 1.0::DOUBLE END AS lbp_mass FROM embeddings")
def q49_image_descriptors(spark, d):
    """Widths of the four descriptors and the LBP histogram's mass; bad rows say why. (Values are tested against plain numpy.)"""
    from tessera.operators.descriptors import extract

    out = extract(images(spark, d))
    size = lambda x: F.when(F.col(x).isNotNull(), F.size(x))
    return out.select("id", "error", size("glcm").alias("n_glcm"), size("lbp").alias("n_lbp"), size("hog").alias("n_hog"), size("color_lab").alias("n_lab"), F.round(F.aggregate("lbp", F.lit(0.0), lambda a, x: a + x), 6).alias("lbp_mass"))
