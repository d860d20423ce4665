import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from clientlens.llm import packing
from clientlens.llm.common import documents
from tests.llm.odd import no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def hold(pieces, texts, library, context=2048):
    """Every id in one piece, sequences gapless, nothing padded."""
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    sequences, own = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        own[p.doc_id].append(p)
    assert set(own) == set(ids)
    for doc, parts in own.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            at += p.length
        assert at == len(ids[doc])
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= context
        padding += 0 if at & (at - 1) == 0 else context - at
    assert padding == 0
    return ids


def test_pieces_of_the_table(spark, sf_dir, library):
    from clientlens.llm.queries import op2

    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    pieces = op2(spark, sf_dir).collect()
    ids = hold(pieces, texts, library)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())


def test_ids_and_step_groups(spark, sf_dir, library):
    docs = documents(spark, sf_dir)
    pieces = packing.pack(docs.coalesce(1), PATH, context=512, tiers=(512, 128, 32), step_tokens=2048).collect()
    ids = hold(pieces, {r.doc_id: r.text for r in docs.collect()}, library, 512)
    tokens = defaultdict(int)
    for p in pieces:
        assert p.ids == ids[p.doc_id][p.start:p.start + p.length]
        tokens[p.step_group] += p.length
    assert sum(n != 2048 for n in tokens.values()) <= 1


def test_words_are_encoded_as_by_the_library(library):
    rng = random.Random(5)
    parts = ["th", "ing", " ", "  ", "\n", "é", "日", "'s", "12", "!", "\t", "Ünder", "\r\n", "▁", "<|endoftext|>", " the", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    found = packing.WordTokens(PATH).encode_all(texts)
    for text, data in zip(texts, found, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_rows(spark, library):
    docs, rows = odd_documents(spark)
    pieces = packing.pack(docs, PATH).collect()
    single = {d: t for d, t in rows if d not in (6, None)}
    counted = defaultdict(int)
    for p in pieces:
        counted[p.doc_id] += p.length
    for d, t in single.items():
        assert counted[d] == len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert counted[6] == 3 * (len(library.encode(rows[6][1], add_special_tokens=False).ids) + 1)
    assert counted[None] == len(library.encode("no id on this row at all", add_special_tokens=False).ids) + 2
    assert packing.pack(no_documents(spark), PATH).count() == 0
