"""Labels, lineage, duplicates, splits, files and descriptors."""

import datetime
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Config, check_domain
from tessera.functions import image_files, images
from tessera.functions.columns import id_of_filename, normalize_key, parent_key, ranked, seeded
from tessera.operators import audit, dedup, descriptors, features, gates, inference, labels, lineage, significance, splits
from tessera.sources import files, sinks
from tessera.sources.sinks import written
from tessera.streaming import incremental


def test_keys(spark):
    r = spark.createDataFrame([(" Lichen - Planus ", "ITEM_00000001__a__b.jpg")], "k string, f string").select(normalize_key(F.col("k")).alias("k"), id_of_filename(F.col("f")).alias("i"), parent_key(F.lit("img (3)_12.jpg"), F.lit(True)).alias("p")).first()
    assert tuple(r) == ("lichen_planus", "ITEM_00000001", "img3")


def test_mapping(spark):
    mapping = files.mapping_from_json(spark, '{"_meta": {"x": "y"}, "A": {"Lichen_Planus": "LP", "Merged": "AMBIGUOUS_MERGED"}}')
    counts = spark.createDataFrame([("a", "lichen planus", 3), ("A", "Merged", 2), ("A", "other", 1)], "d string, l string, n int")
    got = {r.l: r.target for r in labels.map_labels(counts, mapping, "d", "l").collect()}
    assert got == {"lichen planus": "LP", "Merged": "AMBIGUOUS_MERGED", "other": "UNKNOWN"}
    assert labels.bad_targets(mapping, ["LP"]).count() == 0 and labels.bad_targets(mapping, ["X"]).count() == 1


def test_greedy_leaders_are_not_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (5, 7)], "a long, b long")
    assert {tuple(r) for r in dedup.greedy_leaders(pairs, written).collect()} == {(2, 1), (6, 5), (7, 5)}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_leaders_equal_the_scan(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {tuple(sorted(map(int, rng.integers(0, 40, 2)))) for _ in range(60)}
    edges = {e for e in edges if e[0] < e[1]}
    gone, kept = {}, set()
    for i in range(40):
        if i not in gone:
            for a, b in edges:
                if i in (a, b) and max(a, b) != i and max(a, b) not in gone and max(a, b) not in kept:
                    gone[max(a, b)] = i
            kept.add(i)
    got = dict(tuple(r) for r in dedup.greedy_leaders(spark.createDataFrame(sorted(edges), "a long, b long"), written).collect())
    assert got.keys() == gone.keys() and got == {b: min(x for x in kept if (x, b) in edges) for b in gone}


def test_close_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**32, 6)]
    rows = []
    for i in range(60):
        lo, hi = base[i % 3], base[3 + i % 3]
        for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
            lo, hi = (lo ^ (1 << int(bit)), hi) if bit < 32 else (lo, hi ^ (1 << int(bit - 32)))
        rows.append((i, f"c{i % 2}", lo, hi))
    reps = dedup.representatives(spark.createDataFrame(rows, "id long, cls string, lo long, hi long"), ["cls"])
    r = [(x.rep, x.cls, x.lo, x.hi) for x in reps.collect()]
    far = lambda x, y: bin(x[2] ^ y[2]).count("1") + bin(x[3] ^ y[3]).count("1")
    assert {(p.a, p.b, p.distance) for p in dedup.close_pairs(reps, 5, within="cls").collect()} == {(x[0], y[0], far(x, y)) for x in r for y in r if x[1] == y[1] and x[0] < y[0] and far(x, y) <= 5}
    assert {(p.a, p.b) for p in dedup.close_pairs(reps, 5, across="cls").collect()} == {(x[0], y[0]) for x in r for y in r if x[1] < y[1] and far(x, y) <= 5}


def items(spark, n=400):
    return spark.range(n).select("id", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("cls"), F.lit("s").alias("source"), F.when(F.col("id") % 10 == 0, "augmented").otherwise("original").alias("source_type"))


def test_splits_and_folds(spark):
    one = {r.id: r.split for r in splits.stratified_split(items(spark), 0.7, 0.15, 42).collect()}
    assert one == {r.id: r.split for r in splits.stratified_split(items(spark), 0.7, 0.15, 42).collect()}
    assert one != {r.id: r.split for r in splits.stratified_split(items(spark), 0.7, 0.15, 7).collect()}
    assert all(one[i] == "train" for i in range(0, 400, 10))
    folded = splits.folds(items(spark).filter("source_type = 'original'"), 5, 1)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    plan = splits.fold_plan(folded, 5)
    split = folded.select("id", "cls", "source", "source_type").withColumn("split", F.lit("train"))
    assert all(r.n_violations == 0 for r in splits.invariants(plan, split).collect())
    assert splits.invariants(plan, split.withColumn("split", F.lit("test"))).agg(F.sum("n_violations")).first()[0] > 0
    assert splits.folds(items(spark, 9), 5, 1).select("fold").distinct().count() == 3
    weights = splits.class_weights(folded, spark.createDataFrame([("c0",), ("none",)], "cls string"), 5)
    assert weights.filter("cls = 'none' AND weight IS NULL").count() == 5


def test_ranks_equal_one_window(spark):
    from pyspark.sql import Window

    df = items(spark).withColumn("k", seeded(F.col("id"), 5))
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("cls").orderBy("k", "id"))).select("id", "w")
    assert ranked(df, ["cls"], "k", "id").join(want, "id").filter("rn <> w").count() == 0


def test_surrogate_ids_are_dense(spark):
    got = lineage.surrogate_ids(items(spark), ["cls"], "id", slices=7).orderBy("cls", "id").collect()
    assert [r.item_no for r in got] == list(range(1, 401)) and got[0].item_id == "ITEM_00000001"


def test_conservation(spark):
    rows = [(True, False, False, False), (False, True, False, False), (False, False, False, False), (True, True, False, False)]
    r = lineage.conservation(spark.createDataFrame(rows, "final boolean, rejected boolean, duplicate boolean, review boolean")).first()
    assert (r.n_items, r.n_unaccounted, r.n_conflicting, r.passed) == (4, 1, 1, False)


def test_freeze_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "rel_path string, sha256 string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "rel_path string, sha256 string")
    assert {tuple(r) for r in audit.freeze_diff(old, new).collect()} == {("a", "REMOVED"), ("c", "CHANGED"), ("d", "ADDED")}


def jpeg():
    """A frame header, a scan header, coded data and the end."""
    return b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\x34" * 9 + b"\xff\xd9"


def png(width=5, height=4):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * height * (1 + 3 * width))) + chunk(b"IEND", b"")


def test_damaged_bodies_are_found():
    pixels = b"\1" * 16 * 3
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 4, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels
    entries = [(256, 3, 1, 4), (257, 3, 1, 4), (273, 4, 1, 62), (279, 4, 1, 16)]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0) + b"\2" * 16
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8 " + struct.pack("<I", 6) + b"abcdef"
    for body in (jpeg(), png(), bmp, tiff, webp):
        assert image_files.intact(body)
        assert not image_files.intact(body[: len(body) * 2 // 3]) and not image_files.intact(body[:4])
    flipped = bytearray(png())
    flipped[45] ^= 1
    assert not image_files.intact(bytes(flipped)) and not image_files.intact(b"") and not image_files.intact(b"text")


def test_the_last_of_repeated_provenance_rows_stays(spark, tmp_path):
    columns = files.struct(files.PROVENANCE).names
    lines = [",".join(columns)] + [",".join([i, d] + [""] * (len(columns) - 2)) for i, d in (("a", "one"), ("b", "two"), ("a", "three"), ("a", "four"))]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    got = {r.item_id: r.source_dataset for r in files.provenance_csv(spark, f"{tmp_path}/p.csv").collect()}
    assert got == {"a": "four", "b": "two"} and files.provenance_csv(spark, f"{tmp_path}/p.csv").columns == columns


def test_stored_fold_plans_are_checked(spark):
    rows = [(f, "val" if i % 3 == f else "train", i, "x" if i % 2 else "y") for i in range(12) for f in range(3)]
    plan = spark.createDataFrame(rows, "fold_id int, split_role string, id int, cls string")
    classes = spark.createDataFrame([("x",), ("y",), ("z",)], "cls string")
    weights, bad = files.loaded_fold_plan(plan, classes, 3)
    assert bad.count() == 0
    assert {(r.fold_id, r.cls): (r.n_train, r.weight) for r in weights.collect()}[0, "x"] == (4, pytest.approx(8 / (3 * 4)))
    assert all(r.weight is None for r in weights.filter("cls = 'z'").collect())
    broken = plan.filter("NOT (id = 1 AND fold_id = 0)").unionByName(plan.filter("id = 2 AND fold_id = 1")).withColumn("split_role", F.when(F.col("id") == 3, "train").otherwise(F.col("split_role")))
    broken = broken.unionByName(plan.filter("id = 4 AND fold_id = 0").withColumn("fold_id", F.lit(7)))
    got = {(r["check"], r.detail) for r in files.loaded_fold_plan(broken, classes, 3)[1].collect()}
    assert {("all folds", "1"), ("once a fold", "2"), ("validated once", "3"), ("fold number", "7")} <= got


def test_fusion_raises_for_missing_and_repeated_ids(spark):
    one = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, vec array<double>")
    two = spark.createDataFrame([(1, [3.0]), (2, [4.0])], "id int, vec array<double>")
    assert {r.id: r.fused for r in features.fuse({"deep": one, "glcm": two}, "id", ["glcm", "deep"]).collect()} == {1: [1.0, 3.0], 2: [2.0, 4.0]}
    for bad in (two.filter("id = 1"), two.unionByName(two)):
        with pytest.raises(Exception, match="missing or repeated"):
            features.fuse({"deep": one, "glcm": bad}, "id", ["deep", "glcm"]).collect()


def test_capped_issues_and_pair_evidence(spark):
    issues = spark.range(60)
    got = audit.capped(issues, "id", 50).orderBy("place").collect()
    assert len(got) == 51 and got[0].detail == "0" and (got[50].place, got[50].detail, got[50].n) == (51, "more", 10)
    assert audit.capped(issues.limit(0), "id").first().n == 0
    arms = spark.createDataFrame([("a",), ("b",), ("c",)], "arm string")
    pairs = spark.createDataFrame([("a", "b", 1, 2)], "arm_a string, arm_b string, n01 long, n10 long")
    assert {tuple(r) for r in significance.evidence(arms.filter("arm = 'b'"), arms, pairs).collect()} == {("b", "a", 1, 2), ("b", "c", None, None)}


def test_inference_stops_at_the_stage_that_fails(spark):
    model = inference.Frozen(lambda x: F.array(F.length(x).cast("double"), F.when(F.length(x) > 90, F.lit(float("nan"))).otherwise(F.lit(1.0))), [0.0, 0.0], [10.0, 1.0], [True, False], [[4.0], [8.0]], 1.0, 0.9, ["short", "long"])
    rows = spark.createDataFrame([(1, "ab" * 20), (2, "a b" * 27), (3, None), (4, "tiny"), (5, "a" * 40), (6, "ab" * 50), (7, "abc" * 20)], "id int, text string")
    reason = inference.invalid_reason(F.length("text") > 0, F.length("text"), F.length(F.replace(F.col("text"), F.substring("text", 1, 1))).cast("double"))
    got = {r.id: r for r in inference.infer(rows, "text", reason, model).collect()}
    assert {i: (r.stage, r.reason) for i, r in got.items()} == {1: ("status", None), 2: ("status", None), 3: ("validate", "MISSING"), 4: ("validate", "TOO_SMALL"), 5: ("validate", "UNIFORM"), 6: ("features", None), 7: ("status", None)}
    assert (got[1].label, got[1].prediction_set, got[1].status) == ("short", "short", "STANDARD_OUTPUT") and got[2].label == "long"
    assert got[7].prediction_set == "short;long" and got[7].status == "SPECIALIST_REVIEW_REQUIRED" and got[3].status == got[6].status == "INPUT_QUALITY_FAILURE"
    assert inference.infer_or_raise(rows.filter("id < 3"), "text", reason, model).count() == 2
    with pytest.raises(Exception, match="input 4: TOO_SMALL"):
        inference.infer_or_raise(rows, "text", reason, model).filter("id = 4").collect()


def test_descriptors_of_a_table_are_numpys_and_bad_rows_do_not_stop_it(spark):
    rng = np.random.default_rng(5)
    good = [rng.integers(0, 256, (64, 64, 3)).astype(np.uint8) for _ in range(3)]
    rows = [(i, 64, 64, bytearray(x.tobytes())) for i, x in enumerate(good)] + [(8, 64, 64, bytearray(b"x")), (9, 0, 3, bytearray()), (10, 4, 4, None)]
    out = descriptors.extract(spark.createDataFrame(rows, "id int, height int, width int, pixels binary"))
    got = {r.id: r for r in out.collect()}
    for i, x in enumerate(good):
        assert all(getattr(got[i], k) == pytest.approx(v) for k, v in images.describe(x).items())
    assert all(got[i].error and got[i].glcm is None for i in (8, 9, 10))
    r = descriptors.report(out).first()
    assert (r.n, r.n_failed, r.glcm_width, r.lbp_width, r.hog_width, r.color_lab_width) == (6, 3, 12, 18, 36, 6)
    steps = spark.createDataFrame([(0.05, 30.0, "conditional"), (0.05, 30.0, "standard"), (0.5, 50.0, "conditional")], "h double, s double, m string")
    assert [list(r.p) for r in steps.select(descriptors.preprocessing(F.col("h"), F.col("s"), F.col("m")).alias("p")).collect()] == [["hair_removal", "clahe"], [], []]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_close_pairs_do_not_depend_on_blocks(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 30, dtype=np.int64)
    words = {int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in (0, 2, 4, 5, 6)}
    reps = spark.createDataFrame([(i, "c", (w >> 32) & 0xFFFFFFFF, w & 0xFFFFFFFF) for i, w in enumerate(sorted(words))], "rep long, cls string, lo long, hi long")
    monkeypatch.setattr(dedup, "agreeing_blocks", lambda n, bits: k)
    got = sorted((r.a, r.b, r.distance) for r in dedup.close_pairs(reps, 5, within="cls").collect())
    w = sorted(words)
    assert got == [(i, j, bin(w[i] ^ w[j]).count("1")) for i in range(len(w)) for j in range(i + 1, len(w)) if bin(w[i] ^ w[j]).count("1") <= 5]


def test_files(spark, tmp_path):
    ok = jpeg()
    for rel in ("d/train/mixed/red-widget-1.jpg", "d/train/mixed/other.JPG", "d/test/mixed/x.txt", "f/K/1.png", "s/v1/Augmented/AD/1.jpg", "s/v1/Preprocessed/SD/2.jpg"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(ok)
    found = files.discover(spark, [
        {"name": "D", "root": f"{tmp_path}/d", "kind": "splits", "classes": ["red_widget"]},
        {"name": "F", "root": f"{tmp_path}/f", "kind": "unknown"},
        {"name": "S", "root": f"{tmp_path}/s", "kind": "versions", "labels": {"SD": "Seb"}},
    ])
    got = {(r.dataset, r.normalized_label, r.original_split, r.source_type, r.dataset_version) for r in found.collect()}
    assert got == {("D", "red_widget", "train", "original", ""), ("D", "mixed", "train", "original", ""), ("F", "K", "", "original", ""), ("S", "Seb", "", "original", "v1")}
    content = files.listing(spark, f"{tmp_path}/d", content=True).select(F.lit("L").alias("label"), "content").unionByName(spark.createDataFrame([("L", bytearray(b"junk")), ("M", None)], "label string, content binary"))
    assert {r.label: (r.n_readable, r.n_corrupt, r.status) for r in files.validate(content).collect()} == {"L": (2, 1, "WARNING"), "M": (0, 1, "FAIL")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan"), ["a"]), (1, 0.12345678, [])], "id int, x double, s array<string>")
    sinks.csv_report(df, f"{tmp_path}/r", ["id"])
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/r", header=True).orderBy("id").collect()] == [("1", "0.123457", "[]"), ("2", None, '["a"]')]
    assert sinks.metadata_digest(df).first() == sinks.metadata_digest(df.repartition(3)).first()


def test_manifests_and_saved_tables(spark, tmp_path):
    items = spark.createDataFrame([(1, "train", "x"), (2, "val", "x"), (3, "train", "y")], "id int, split string, cls string")
    one, two = (json.loads(sinks.dataset_manifest(x, Config(), run=7)) for x in (items, items.repartition(3)))
    assert one == two and one["counts"] == {"train/x": 1, "train/y": 1, "val/x": 1} and one["n"] == 3 and one["run"] == 7
    assert json.loads(sinks.dataset_manifest(items.filter("id < 3"), Config(), run=7))["sha256"] != one["sha256"]
    arm = spark.createDataFrame([("A", 0.5)], "arm string, macro_f1 double")
    tests = spark.createDataFrame([("A", "B", 1, 2)], "winner string, other string, n01 long, n10 long")
    assert json.loads(sinks.winner_json(arm, tests))["evidence"][0]["n10"] == 2
    with pytest.raises(ValueError):
        sinks.winner_json(arm.limit(0), tests)
    sinks.save_tables(f"{tmp_path}/m", items=items, arm=arm)
    assert {k: v.count() for k, v in sinks.load_tables(spark, f"{tmp_path}/m").items()} == {"items": 3, "arm": 1}
    arm.withColumn("macro_f1", F.lit(0.6)).write.mode("overwrite").parquet(f"{tmp_path}/m/arm")
    with pytest.raises(ValueError, match="arm"):
        sinks.load_tables(spark, f"{tmp_path}/m")


def test_running_counts_of_a_stream(spark, tmp_path):
    """What arrives in two files is counted as the batch operator counts it; a repeated item is new once."""
    schema = "id int, source string, cls string, ts timestamp, value int"
    rows = [(i, f"s{i % 2}", "xyz"[i % 3], datetime.datetime(2024, 1, 1, 0, i), i) for i in range(12)]
    spark.createDataFrame(rows[:7], schema).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[5:], schema).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    counts = run(incremental.running_inventory(arriving()), "inventory", "complete")
    batch = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, incremental.running_inventory(batch).collect()))
    new = run(incremental.new_items(arriving(), "id", "ts", "1 hour"), "fresh", "append")
    assert sorted(r.id for r in new.collect()) == list(range(12))
    windows = run(incremental.windowed_counts(arriving(), "ts", "source", "5 minutes", "1 hour"), "windows", "update")
    assert sum(r.n for r in windows.groupBy("window", "source").agg(F.max("n").alias("n")).collect()) == batch.count()


def test_composed_gates(spark):
    none, two = spark.range(0), spark.range(2)
    got = {r.gate: (r.n_violations, r.status) for r in gates.composed({"a": none, "b": two}).collect()}
    assert got == {"a": (0, "PASS"), "b": (2, "FAIL"), "all": (2, "FAIL")}


def test_config():
    assert Config().experiment_id("b") == Config().experiment_id("b") != Config(seed=1).experiment_id("b")
    check_domain(classifier="random_forest", selector="bda")
    with pytest.raises(ValueError):
        check_domain(selector="magic")


def test_descriptors():
    flat = np.full((224, 224, 3), 128, np.uint8)
    d = images.describe(flat)
    assert {k: len(v) for k, v in d.items()} == {"glcm": 12, "lbp": 18, "hog": 1296, "color_lab": 6}
    assert d["glcm"][:4].tolist() == [0, 0, 0, 0] and d["glcm"][6] == pytest.approx(1) and abs(d["hog"]).max() == 0
    assert d["color_lab"][1::2] == pytest.approx([0, 0, 0], abs=1e-6) and d["color_lab"][2] == pytest.approx(0, abs=0.02)
    board = (np.indices((224, 224)).sum(0) % 2 * 255).astype(np.uint8)
    assert images.glcm(board)[0] == pytest.approx(31**2 / 2) and images.sharpness(board) > images.sharpness(flat[..., 0])
    assert images.lbp(board).sum() == pytest.approx(1)
    noise = np.random.default_rng(0).integers(0, 256, (100, 80))
    assert bin(images.perceptual_hash(noise) ^ images.perceptual_hash(noise + 0)).count("1") == 0
    assert images.letterbox(448, 224) == (224, 112, 0, 56)
    assert images.preprocessing_steps(0.05, 30) == ["hair_removal", "clahe"] and images.preprocessing_steps(0.05, 30, "standard") == [] and images.preprocessing_steps(0.5, 50) == []


@pytest.mark.parametrize("how", [{"within": "cls"}, {"across": "cls"}])
def test_close_pairs_are_not_broadcast(spark, tmp_path, how):
    """Each hash has dozens of keys: sides that look small by the table's size are not."""
    spark.range(1000).select(F.col("id").alias("rep"), (F.col("id") % 3).cast("string").alias("cls"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("lo"), F.xxhash64("id", "id").bitwiseAND(0xFFFFFFFF).alias("hi")).write.parquet(f"{tmp_path}/reps")
    plan = dedup.close_pairs(spark.read.parquet(f"{tmp_path}/reps"), 5, **how)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
