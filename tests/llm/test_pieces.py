"""Piece encoding against the sentencepiece library: whole tables, random texts, long runs, any ids."""

import hashlib
import os
import random

import pytest

from rankloom.llm import pieces
from rankloom.llm.common import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ALPHABET = [*" ▁  abcdefthe\n\t\v<0x41>éüß漢字ab\x00😀́ａﬁ.,'-/§↘", "   ", "the", "ing", "    ", "▁▁"]


@pytest.fixture(scope="module")
def both():
    return pieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(both):
    ours, library = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 70))) for _ in range(4_000)]
    for text, ids, expected in zip(texts, ours.encode_all(texts), library.encode(texts, num_threads=1), strict=True):
        assert ids == expected, text
        assert ours.decode(ids) == library.decode(expected)


@pytest.mark.parametrize("text", ["", " ", "▁", "a" * 20_001, " " * 20_001, "the" * 9_000, "漢" * 3_000, "\0", "ab c" * 400_000])
def test_long_and_odd_texts(both, text):
    ours, library = both
    assert ours.encode(text) == library.encode(text)
    assert ours.decode(ours.encode(text)) == text.replace("▁", " ")


def test_any_ids(both):
    ours, library = both
    rng = random.Random(2)
    for _ in range(2_000):
        ids = [rng.randrange(32_000) if rng.random() < 0.7 else rng.randrange(260) for _ in range(rng.randint(0, 20))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_memory_is_bounded(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    rng = random.Random(3)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
        assert ours.encode(text) == library.encode(text)
        assert len(ours.known) <= 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_whole_table(spark):
    docs = documents(spark, SF)
    assert pieces.differences(docs, PATH).count() == 0
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0


def test_digests(spark, both):
    _, library = both
    rows = [(1, None), (2, ""), (2, ""), (None, "the  end ▁"), (4, "x" * 3_000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, ids int, n_tokens string")

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def expected(key, text):
        ids = library.encode(text or "")
        return key, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))

    got = [tuple(r) for r in pieces.digests(docs, PATH).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert pieces.digests(docs.limit(0), PATH).count() == 0
