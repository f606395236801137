"""The whole pipeline against plain Python, on the smallest table."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import ODD, docs

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from tessera.llm.queries import tokenizer_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(t):
    """Words, words in repeated 3-word windows, symbols, lines with a word, those equal to an earlier one."""
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines))


def good(texts, sources):
    """Documents that break no base rule, and no stricter rule that their host fails clearly more often than hosts do."""
    measured = {d: counts(t) for d, t in texts.items()}

    def broken(d, words, repeats, symbols, lines):
        w, r, s, n, dup = measured[d]
        return [w < words, 100 * r > repeats * w, 100 * s > symbols * w, 100 * dup > lines * n]

    hosts = collections.defaultdict(list)
    for d in texts:
        hosts[sources[d]].append(broken(d, 50, 50, 50, 50))
    suspect = {h: [False] * 4 for h in hosts}
    total, squares = len(texts), sum(len(x) ** 2 for x in hosts.values())
    for k in range(4):
        failed = {h: sum(x[k] for x in rows) for h, rows in hosts.items()}
        m = sum(failed.values()) / total
        spread = sum(f * f / len(hosts[h]) for h, f in failed.items()) - total * m * m
        chance, room = (len(hosts) - 1) * m * (1 - m), m * (1 - m) * (total - squares / total - (len(hosts) - 1))
        rho = (spread - chance) / room if room > 1e-9 else 0
        weight = max(1, (1 - rho) / rho) if rho > 1e-9 else total
        for h, f in failed.items():
            suspect[h][k] = (f + m * weight) / (len(hosts[h]) + weight) > 1.5 * m
    return {d: t for d, t in texts.items() if not any(broken(d, 50, 50, 50, 50)[:2]) and not any(x and y for x, y in zip(suspect[sources[d]], broken(d, 60, 35, 25, 35)))}


def unlined(texts):
    holders = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for d, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in texts.items()}


def unlike(texts):
    sets, label = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = WORD.findall(t.translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    return {d: t for d, t in texts.items() if label[d] == d}


def clean(texts, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").finditer
    windows = set()
    for t in items:
        w = [m[0] for m in find(t.translate(FOLD))]
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    out = {}
    for d, t in texts.items():
        m = list(find(t.translate(FOLD)))
        w, hit = [x[0] for x in m], set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        if 2 * len(hit) > len(w):
            continue
        gone = [False] * len(t)
        for i in hit:
            a, z = m[i].start(), m[i + 1].start() if i + 1 in hit else m[i].end()
            gone[a:z] = [True] * (z - a)
        out[d] = "".join(c for c, g in zip(t, gone) if not g)
    return out


def test_run_equals_brute_force(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts, sources = {r.doc_id: r.text for r in table}, {r.doc_id: r.source for r in table}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for d, t in clean(unlike(unlined(good(texts, sources))), items).items():
        ids = model.encode(t)
        want[d] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.same) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_stand_hard_texts(spark):
    table = docs(spark, [*ODD, None], ids=[*range(len(ODD)), None])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).columns == table.columns
        assert stage(spark, table.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_stages_carry_columns_of_any_name(spark):
    """Names that the operators use for themselves are the input's own here."""
    names = {c: F.lit(f"own {c}") for c in ("_id", "_text", "_lines", "_drop", "_mine", "host", "t", "node", "row", "gone", "kept", "component_id", "_spans", "body")}
    words = " ".join(f"w{i}" for i in range(80))
    table = docs(spark, [words, words + " and more", "short"]).withColumns(names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and all(out.first()[c] == f"own {c}" for c in names)


def test_near_copies_of_similarity_0_80_go(spark):
    """Four scattered words of 200 changed: 176 of 216 shingles shared, 0.815."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        texts += [" ".join(w), " ".join("changed" if i in (20, 70, 120, 170) else x for i, x in enumerate(w))]
    left = corpus_pipeline.near_duplicates(spark, docs(spark, texts), SF)
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 80, 2))


def test_near_dedup_stage_equals_brute_force_at_80(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets, label = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()}
    assert got == {d for d in texts if label[d] == d}
