"""The prefix-table encoder against the library itself, and its edge cases."""

import hashlib
import random

import public_tokenizers
import pytest

from quirelake.llm.piece_codec import REMEMBERED, Codec, digests, encode_decode


@pytest.fixture(scope="module")
def codec():
    return Codec(public_tokenizers.path("piece_bpe_32k.model"))


def test_random_strings_get_the_library_ids(codec):
    draw = random.Random(3)
    pieces = list(codec.id_of)
    odd = [" ", "  ", "▁", "▁▁▁", "\n", "\r\n", "\t", "\x00", "a", "t", "th", "the", "e", ".", "é", "é", "中", "\U0001f600", "", "</s>", "<0x41>", "=", "=="]
    for k in range(20_000):
        source = pieces if k % 2 else odd
        text = "".join(draw.choice(source) for _ in range(draw.randint(0, 40)))
        assert codec.encode(text) == codec.library.encode(text), repr(text)


@pytest.mark.parametrize("text", ["", " ", " " * 1000, "=" * 997, "ab" * 50_000, "the" * 3333 + " ", "x\n" * 999, "▁" * 35 + "t", "\U0001f600" * 500, "-" * 40 + " " * 40 + "-" * 3])
def test_long_runs(codec, text):
    assert codec.encode(text) == codec.library.encode(text)


def test_forgetting_changes_nothing(codec, corpus):
    from quirelake.llm import piece_codec

    texts = [r[0] or "" for r in corpus.select("text").collect()]
    before = [codec.encode(t) for t in texts]
    small = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    try:
        piece_codec.REMEMBERED, piece_codec.PAIRS_REMEMBERED = 8, 8
        assert [small.encode(t) for t in texts] == before
        assert len(small.known) <= 8 and len(small.known.older) <= 8 and len(small.beside) <= 8
    finally:
        piece_codec.REMEMBERED, piece_codec.PAIRS_REMEMBERED = REMEMBERED, 1 << 19


def expected(codec, text):
    ids = [*codec.library.encode(text or ""), 2]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_corpus_and_edge_cases(codec, docs, corpus, empty):
    for df in (docs, corpus):
        want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *expected(codec, r["text"])) for r in df.select("doc_id", "text").collect())
        got = digests(encode_decode(df)).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert digests(encode_decode(empty)).count() == 0


def test_round_trip(codec, corpus):
    """What is decoded is the text (this corpus holds no blank marks)."""
    both = encode_decode(corpus).join(corpus.select("doc_id", "text"), "doc_id")
    assert both.where("decoded <> coalesce(text, '')").count() == 0
