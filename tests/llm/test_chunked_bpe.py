"""The chunked encoder against the library that reads the same ranks."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest

from quaylens.llm import chunked_bpe
from quaylens.llm.tokens import PIECE_PATTERN

PARTS = ["a", "b", "'", "'l", "l", " ", "\n", "  ", "1", "23", ".", "!", "é", "漢", "　", "\t", "\U0001f600", "\x1c", " ", "ll", "x" * 40, " " * 30, "7" * 50]


@pytest.fixture(scope="module")
def library():  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    assert public_tokenizers.PATTERN == PIECE_PATTERN
    with open(chunked_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(ids):  # noqa: ANN001, ANN201
    return np.frombuffer(ids, dtype="<u4").tolist()


@pytest.mark.parametrize(("chunk", "overlap"), [(chunked_bpe.CHUNK, chunked_bpe.OVERLAP), (200, 24), (64, 1)])
def test_documents(documents, library, chunk, overlap):  # noqa: ANN001
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = chunked_bpe.decode(chunked_bpe.encode(documents, chunk=chunk, overlap=overlap)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert numbers(r.ids) == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id] and r.decimal == ",".join(map(str, numbers(r.ids))) and r.n_tokens == len(r.ids) // 4


def mixed(spark, parts, n):  # noqa: ANN001, ANN201
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(300))) for _ in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (50, 1), (100, 64)])
def test_chunks_of_any_size(spark, library, chunk, overlap):  # noqa: ANN001
    texts, df = mixed(spark, PARTS, 300)
    assert all(numbers(r.ids) == library.encode_ordinary(texts[r.doc_id]) for r in chunked_bpe.encode(df, chunk=chunk, overlap=overlap).collect())


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (100, 64)])
def test_chunks_that_never_agree(spark, chunk, overlap):  # noqa: ANN001
    """Digits by three stay out of step where a chunk starts within them."""
    texts, df = mixed(spark, ["a", " ", "5", "7" * 50, "11", "bc ", "7" * 33], 300)
    pattern = r"\p{N}{1,3}| ?\p{L}+|\s+"
    whole = chunked_bpe.ranks(chunked_bpe.default_ranks(), pattern)
    assert all(bytes(r.ids) == whole.encode(texts[r.doc_id]) for r in chunked_bpe.encode(df, pattern=pattern, chunk=chunk, overlap=overlap).collect())


def test_long_pieces_and_all_characters(library):  # noqa: ANN001
    r = chunked_bpe.ranks(chunked_bpe.default_ranks(), PIECE_PATTERN)
    for text in ("a" * 100_000, "ab" * 20_000, "é" * 5000, " " * 3000 + "x", " ".join(f"{chr(i)}x1{chr(i)}" for i in range(1, 0x33480) if not 0xD800 <= i < 0xE000)):
        assert numbers(r.encode(text)) == library.encode_ordinary(text)


def test_odd_rows(odd, none, library):  # noqa: ANN001
    got = chunked_bpe.encode(odd, chunk=1000, overlap=100).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or "")) for r in odd.collect()]
    assert sorted((repr(r.doc_id), numbers(r.ids)) for r in got) == sorted((repr(i), ids) for i, ids in want)
    assert chunked_bpe.decode(chunked_bpe.encode(none)).count() == 0
    with_names = chunked_bpe.decode(odd.selectExpr("word AS decoded", "cast(null AS binary) AS ids", "slot"))
    assert with_names.columns == ["ids", "slot", "decoded", "decimal"] and {bytes(r.decoded) for r in with_names.collect()} == {b""}


def test_ids_of_text(spark):  # noqa: ANN001
    df = spark.createDataFrame([("k", "word " * 400), ("k", "word"), (None, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in chunked_bpe.encode(df, chunk=100, overlap=20).collect()) == [("", 0), ("k", 1), ("k", 401)]
