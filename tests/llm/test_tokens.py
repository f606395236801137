import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessera.llm import token_counts, token_store  # noqa: E402
from tessera.llm.queries import QUERIES  # noqa: E402

HARD = [*ODD, "it's <|endoftext|> don't <|ENDOFTEXT|>x", "x² ½ İstanbul ΣΑΣ naïve 你好 🙂     á", "  two  spaces \n\n tabs\t\t end  ", "A" * 3000, "1234567 12,345.67 _under_score_ <|startoftext|>"]


def test_counts_equal_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(HARD)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs(spark, HARD), P.path("byte_bpe_50k.json")).collect()}
    assert got == want


def test_counts_survive_a_full_memory():
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"), memory=3)
    text = " ".join(f"wrd{i}qx" for i in range(50)) * 2
    assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_whole_tables(spark):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    byte, word = (tokenizers.Tokenizer.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counts = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    stored = {r.doc_id: r for r in QUERIES["op3_token_store"](spark, SF).collect()}
    start = 0
    for d in sorted(documents):
        n = len(byte.encode(documents[d], add_special_tokens=False).ids)
        assert (counts[d].n_tokens, counts[d].over_limit, counts[d].n_bytes) == (n, n > 1024, len(documents[d].encode()))
        ids = word.encode(documents[d], add_special_tokens=False).ids + [2]
        assert (stored[d].start, stored[d].n_tokens, stored[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(stored) == len(counts) == len(documents)


def test_shards_hold_hard_texts(spark):
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    table = token_store.write_shards(docs(spark, HARD * 2, ids=[i % 5 for i in range(2 * len(HARD))]), P.path("word_bpe_49k.json"), shard_tokens=50)
    got = sorted((r.doc_id, r.ids_crc32, r.n_tokens) for r in token_store.read_documents(table).collect())
    want = [(i % 5, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in enumerate(HARD * 2)]
    assert got == sorted((d, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for d, x in want)
    assert table.count() > 2


def test_no_documents_no_shards(spark):
    assert token_store.read_documents(token_store.write_shards(docs(spark, []), P.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 513, 40_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49408).astype("<u2")
    shard = token_store.Shard(token_store.write_shard([7, None], ids, np.array([0, n // 2, n]), 16))
    assert (shard.ids() == ids).all() and shard.doc_ids == [7, None] and shard.starts.tolist() == [0, n // 2, n]
    for at in rng.integers(0, n, 5):
        assert shard.access(int(at)) == ids[at]
    for token in {int(ids[0]), int(ids[-1]), 49407, 65535, 1 << 20}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.count(token, n // 2) == (places < n // 2).sum()
        for k in range(0, len(places), max(1, len(places) // 4)):
            assert shard.find(token, k) == places[k]
        with pytest.raises(IndexError):
            shard.find(token, len(places))
