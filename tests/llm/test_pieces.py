import random

import public_tokenizers
import pytest
import sentencepiece

from clientlens.llm import pieces
from clientlens.llm.common import documents
from tests.llm.odd import no_documents, odd_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(PATH)


def test_texts_of_the_table(spark, sf_dir, library):
    import hashlib

    from clientlens.llm.queries import op9

    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    found = op9(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_random_strings(library, codec):
    rng = random.Random(4)
    parts = ["th", "ing", " ", "  ", "ent", "\n", "é", "日", "111", "▁", "S", "der", "ion", "\x00", "und", "👍", "a", "e", "     "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        ids = codec.encode(text)
        assert ids == library.encode(text), repr(text)
        assert codec.decode(ids) == library.decode(ids)


def test_runs_of_spaces(library, codec):
    for n in range(120):
        for text in (" " * n, "a" + " " * n + "b", " " * n + "\n" + " " * n):
            assert codec.encode(text) == library.encode(text), repr(text)


def test_every_piece_that_merges_make_is_its_own_encoding(library, codec):
    for piece, rank in list(codec.rank_of.items())[::7]:
        text = piece.removeprefix("▁") if piece.startswith("▁") else None
        if text and "▁" not in text:
            assert codec.encode(text) == library.encode(text)
        assert codec.length[rank] == len(piece)


def test_odd_rows(spark, library):
    docs, rows = odd_documents(spark)
    found = pieces.encode_decode(docs, PATH).collect()
    expected = sorted((d is None, d or 0, library.encode(t or "")) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in found) == expected
    assert pieces.encode_decode(no_documents(spark), PATH).count() == 0
