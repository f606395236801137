import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import ODD, docs

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tessera.llm import sentencepiece_wfst as wfst  # noqa: E402
from tessera.llm.queries import QUERIES  # noqa: E402

HARD = [*ODD, " ", "   ", "  a  b ", "▁x▁▁ y", "你好 世界 🙂", "a" * 100, "<0x41> <s> </s> <unk>", "\x00\x07", "é́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_ids_and_texts_equal_the_library(spark, library):
    encoded = wfst.encode(docs(spark, HARD), P.path("piece_bpe_32k.model"))
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert ids == {i: library.encode(t or "") for i, t in enumerate(HARD)}
    texts = {r.doc_id: r.text for r in wfst.decode(encoded, P.path("piece_bpe_32k.model")).collect()}
    assert texts == {i: library.decode(ids[i]) for i in ids}


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_sentencepiece"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = library.encode(t)
        assert (got[d].n_tokens, got[d].ids_crc32, got[d].same) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_neighbours_decide_as_merging_does():
    """The path through the composition is what merging the whole run gives, whatever was composed before it."""
    model = wfst.compiled(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    runs = sorted({"▁" + "".join(rng.choice(list("aeiounrstlhd▁é"), rng.integers(1, 25))) for _ in range(300)})
    for run, path in zip(runs, model.shortest_paths(runs)):
        assert [model.pieces[i][0] for i in path] == model.merges.merged(run)


def test_agreement_of_neighbours_is_merging_them():
    model = wfst.compiled(P.path("piece_bpe_32k.model"))
    rng, names = np.random.default_rng(4), list(model.id)
    short = [n for n in names if len(n) < 4]
    for u, v in [*rng.choice(names, (1500, 2)).tolist(), *rng.choice(short, (1500, 2)).tolist()]:
        assert model.merges.agree(u, v) == (model.merges.merged(u + v) == [u, v])


def _message(*fields):
    """A protocol-buffer message of (number, kind, value)."""
    out = b""
    for number, kind, value in fields:
        out += bytes([number << 3 | kind]) + (bytes([value]) if kind == 0 else value if kind == 5 else bytes([len(value)]) + value)
    return out


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_takes_the_lightest_path(tmp_path, fallback):
    """Real weights: a written model file, against the library and all segmentations."""
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.5, "ba": -5.0, "aba": -9.5, "bab": -5.5, "▁ab": -9.0, "abab": -11.0, "c": -4.0}
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback), *((p, s, 1) for p, s in scores.items())]
    pieces = [_message((1, 2, _message((1, 2, p.encode()), (2, 5, np.float32(s).tobytes()), (3, 0, k)))) for p, s, k in listed]
    trainer = _message((3, 0, 1)) + (b"\x98\x02\x01" if fallback else b"")  # unigram; byte fallback is field 35
    data = b"".join(pieces) + _message((2, 2, trainer), (3, 2, _message((1, 2, b"identity"), (3, 0, 1), (4, 0, 0), (5, 0, 1))))
    (tmp_path / "u.model").write_bytes(data)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), wfst.Transducer(str(tmp_path / "u.model"))
    rng = np.random.default_rng(1)
    for text in ["".join(rng.choice(list("aabbc é"), n)) for n in rng.integers(1, 14, 200)]:
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_defined_results(spark):
    model = wfst.compiled(P.path("piece_bpe_32k.model"))
    assert (model.encode(None), model.encode(""), model.decode(None), model.decode([])) == ([], [], None, "")
    table = docs(spark, ["a b", "a b", None]).selectExpr("*", "'x' AS ids", "0 AS same")
    got = wfst.round_trips(table, P.path("piece_bpe_32k.model")).collect()
    assert [(r.n_tokens, r.same) for r in got] == [(2, True), (2, True), (0, True)]


def test_a_very_long_text(library):
    model = wfst.compiled(P.path("piece_bpe_32k.model"))
    text = "word " * 200_000 + "x" * 20_000 + " é\n" * 100_000
    ids = model.encode(text)
    assert model.decode(ids) == text and len(ids) == len(library.encode(text))


def test_no_documents(spark):
    assert wfst.round_trips(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0
