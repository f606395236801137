import re

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import ODD, docs

from tessera.llm import near_dedup as nd
from tessera.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    sets, label = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    return {d: (len(sets[d]), label[d], label[d] == d) for d in texts}


def ours(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert ours(QUERIES["op7_near_dedup"](spark, SF)) == brute(texts)


@pytest.mark.parametrize("block", [512, 7])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """Copies of copies around the threshold, where leaders alone would miss links."""
    monkeypatch.setattr(nd, "TEXT_BLOCK", block)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(block)
    texts = {}
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 9999, 200)]
        for k in range(20):
            w = list(base)
            for at in rng.integers(0, 200, 1 + k % 6):
                w[at] = f"x{rng.integers(0, 9999)}"
            texts[100 * g + int(rng.integers(0, 3)) + 4 * k] = " ".join(w)
    for n, t in enumerate([*ODD, "a b c d e", "A b C d e", "a b", "A B"]):
        texts[1000 + n] = t
    assert ours(nd.near_duplicates(docs(spark, list(texts.values()), ids=list(texts)))) == brute(texts)


def test_rows_without_a_name_and_repeated_rows(spark):
    t = " ".join(map(str, range(50)))
    got = nd.near_duplicates(docs(spark, [t, t, t, None], ids=[None, 4, 4, None])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == [(4, 4, True), (4, 4, True), (None, None, True), (None, None, True)]
    assert nd.near_duplicates(docs(spark, [])).count() == 0


def test_keys_meet_by_pigeonhole():
    """Signatures with at most CHUNKS * 2 - 1 differing symbols share a key."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (50, nd.CHUNKS * nd.SIZE)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(len(row), nd.CHUNKS * 2 - 1, replace=False)] ^= 1
    ka, kb = nd.chunk_keys(a), nd.chunk_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


@pytest.mark.parametrize("percent", [85, 80, 70, 50])
def test_layout_follows_percent(percent):
    """Pairs of just that similarity share a key and lie within the limits; 0.85 keeps what op7 was built with."""
    assert nd.layout(85) == nd.Layout(nd.SIZE, 28, 33, 40)
    limits, rng, n = nd.layout(percent), np.random.default_rng(percent), 20_000
    a = rng.integers(0, 65536, (n, nd.CHUNKS * nd.SIZE)).astype("<u2")
    b = np.where(rng.random(a.shape) < percent / 100, a, rng.integers(0, 65536, a.shape)).astype("<u2")
    ka, kb = nd.chunk_keys(a, limits.size), nd.chunk_keys(b, limits.size)
    assert (ka == kb).any(1).all()
    assert ((a != b).sum(1) <= limits.near).all() and ((a & 3 != b & 3).sum(1) <= limits.close).all()


def test_percent_without_a_layout_is_an_error():
    with pytest.raises(ValueError):
        nd.layout(5)


def test_several_texts_under_one_doc_id(spark):
    """Each row goes or stays by its own text; columns with the operator's own names are carried along."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    near = b.replace("b30", "other")
    table = docs(spark, [b, a, near, c, c + " more", c], ids=[3, 5, 5, 7, 7, 7]).selectExpr("*", "doc_id AS t", "'x' AS node", "'y' AS row")
    got = {(r.doc_id, r.text) for r in nd.keep_one(table).collect()}
    assert {x for x in got if x[0] != 7} == {(3, b), (5, a)} and len([x for x in got if x[0] == 7]) == 1
    assert nd.keep_one(table).columns == table.columns
    labelled = sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(table).collect())
    assert labelled == [(3, 3), (5, 3), (5, 5), (7, 7), (7, 7), (7, 7)]


def test_doc_ids_that_are_no_integers_are_an_error(spark):
    with pytest.raises(TypeError):
        nd.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_words_of_bytes_are_the_rule_s():
    for t in ["A\x0bB\x1cC\x85 d\u3000É\tf\rg\x0c h\x00", *[t for t in ODD if t]]:
        assert [w.decode() for w in nd.words_of(t)] == re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD))


def test_a_very_long_text(spark):
    t = " ".join(f"w{i}" for i in range(400_000))
    got = nd.near_duplicates(docs(spark, [t, t + " end", "short"])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == [(0, 0, 399_996), (1, 0, 399_997), (2, 2, 1)]
