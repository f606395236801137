import hashlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import ODD, docs

from tessera.llm import suffix_dedup as sd
from tessera.llm.queries import QUERIES


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256) by (doc_id, text), with every window in a dictionary."""
    first, raws = {}, [(i, (t or "").encode()) for i, t in texts]
    for i, b in raws:
        for s in range(len(b) - 99):
            k, p = b[s : s + 100], (-(2**63) if i is None else i, s)
            if k not in first or p < first[k]:
                first[k] = p
    out = []
    for i, b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (-(2**63) if i is None else i, s):
                gone[s : s + 100] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert ours(QUERIES["op8_suffix_dedup"](spark, SF)) == brute(texts)


@pytest.mark.parametrize("hot, forms, rows", [(512, 64, 10**6), (3, 64, 10**6), (3, 2, 10**6), (512, 3, 50), (2, 2, 40)])
def test_hard_texts(spark, monkeypatch, hot, forms, rows):
    """Whatever is spread over shards, kept open within tasks, or compared in small parts."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "FORMS", forms)
    monkeypatch.setattr(sd, "OWN_ROWS", rows)
    rng = np.random.default_rng(hot)
    word = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    shared, other = word(180), word(130)
    texts = [*ODD, "ab" * 400, "ab" * 300 + "c", word(300) + "ab" * 100]
    texts += [word(int(rng.integers(0, 60))) + shared[: int(rng.integers(90, 180))] + word(int(rng.integers(0, 90))) + other + word(20) for _ in range(25)]
    texts += [shared + shared + shared, shared, shared, None, word(99), word(100)]
    texts += [texts[-2] + texts[-1]]
    ids = [*range(len(texts) - 2), 5, None]
    assert ours(sd.removals(docs(spark, texts, ids=ids))) == brute(list(zip(ids, texts)))


def test_repeated_rows_are_one_document(spark):
    t = "".join(f"{i:03d}" for i in range(84))[:250]
    got = ours(sd.removals(docs(spark, [t, t, t], ids=[1, 1, 2])))
    assert [g[:4] for g in got] == [(1, 250, 0, 0), (1, 250, 0, 0), (2, 250, 250, 1)]


def test_no_documents(spark):
    assert sd.removals(docs(spark, [])).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    text[300:500] = text[50:250]
    sa = sd.suffix_array(text)
    raw = text.tobytes()
    assert sorted(sa.tolist()) == list(range(700))
    assert all(raw[a : a + 128] <= raw[b : b + 128] for a, b in zip(sa[:-1], sa[1:]))
    shared = sd.common_prefixes(text, sa, np.array([0, 300, 350]))
    for k in range(1, 700):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        want = next((i for i in range(100) if i >= len(a) or i >= len(b) or a[i] != b[i]), 100)
        assert min(shared[k], 100) == want


def test_a_very_long_text_and_doc_ids_that_are_no_integers(spark):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefgh "), 1_300_000))
    got = ours(sd.removals(docs(spark, [long, "x" + long[600_000:600_300] + "y"])))
    assert [g[:4] for g in got] == [(0, 1_300_000, 0, 0), (1, 302, 300, 1)]
    with pytest.raises(TypeError):
        sd.removals(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_windows_of_a_hot_anchor_are_shipped_as_hashes(spark, monkeypatch):
    """A passage with 200 borders: what its spread windows take on disk is far less than their 100 bytes each."""
    monkeypatch.setattr(sd, "HOT", 20)
    monkeypatch.setattr(sd, "HOT_TIMES", 1)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(150)
    texts = [passage + word(120) for _ in range(200)]
    texts.append(texts[7][60:240])
    made, whole = [], sd.cut
    monkeypatch.setattr(sd, "cut", lambda df, name: made.append((name, whole(df, name))) or made[-1][1])
    assert ours(sd.removals(docs(spark, texts))) == brute(list(enumerate(texts)))
    spread = dict(made)["suffixes"].filter("bucket IS NOT NULL")
    windows = sum(len(sd.unpack(r.windows)[0]) for r in spread.select("windows").collect())
    size = sum(len(v) for r in spread.drop("v", "bucket").collect() for v in r if isinstance(v, (bytes, bytearray)))
    assert windows > 1000 and size < 50 * windows


def test_a_shard_keeps_a_share_of_a_task():
    assert [sd._hot(n, 50) for n in (0, 10**6, 10**9)] == [sd.HOT, 2500, sd.HOT * sd.HOT_TIMES]
