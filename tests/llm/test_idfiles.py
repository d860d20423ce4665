"""Files of token ids: exact round trips, damage, order, and the coder alone."""

import zlib
from time import process_time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clientlens.llm import idfiles, mixing
from clientlens.llm.packing import WordTokens

from .odd import no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def round_trip(blocks):
    _, levels, numbers = mixing.alphabet_of(np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64))
    parts = np.split(numbers, np.cumsum([len(b) for b in blocks])[:-1])
    coded = mixing.encode_blocks(parts, levels)
    decoded = mixing.decode_blocks(coded, [len(b) for b in blocks], levels)
    assert all((a == b).all() for a, b in zip(parts, decoded, strict=True))
    # A block does not need the others.
    alone = mixing.decode_blocks(coded[-1:], [len(blocks[-1])], levels)
    assert (alone[0] == parts[-1]).all()
    return sum(map(len, coded))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=700), min_size=1, max_size=5))
def test_blocks_round_trip(blocks):
    round_trip([np.array(b, np.int64) for b in blocks])


def test_every_order_predicts():
    rng = np.random.default_rng(1)
    n = mixing.BLOCK_IDS
    uniform = round_trip([rng.integers(0, 1000, n) for _ in range(4)])
    skewed = round_trip([np.minimum(rng.zipf(1.5, n), 999) for _ in range(4)])
    pairs = round_trip([np.repeat(rng.permutation(1000)[:500], 2)[rng.integers(0, 500, n // 2)[:, None] * 2 + [0, 1]].ravel() for _ in range(4)])
    cycle = round_trip([np.tile(rng.permutation(40), n)[:n] for _ in range(4)])
    assert cycle < pairs < uniform and skewed < uniform
    assert uniform < 4 * n * 11 / 8  # nearly the 10 bits of an even choice
    assert cycle < 4 * n * 0.5 / 8


def test_segments_and_damage():
    rng = np.random.default_rng(2)
    lengths = [1, 0, 9000, 3]
    ids = rng.integers(0, 50257, sum(lengths)).astype(np.uint32)
    data = idfiles.write_segment([-5, None, 7, 2**62], lengths, ids)
    doc_ids, found_lengths, found = idfiles.read_segment(data)
    assert doc_ids == [-5, None, 7, 2**62] and found_lengths.tolist() == lengths and (found == ids).all()
    assert idfiles.read_segment(idfiles.write_segment([], [], ids[:0]))[0] == []
    for at in (0, 20, 60, len(data) // 2, len(data) - 400):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(idfiles.BrokenSegment):
            idfiles.read_segment(bytes(broken))


def test_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 3000)
    df, rows = odd_documents(spark)
    got = idfiles.read_ids(spark, idfiles.write_ids(df.repartition(5), PATH)).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    expected = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows),
                      key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in expected]
    by_id = {}
    for d, ids in expected:
        by_id.setdefault(d, []).append(ids)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in by_id[r.doc_id]
        at += r.n_tokens
    assert at == sum(len(ids) for _, ids in expected)
    sums = idfiles.read_ids(spark, idfiles.write_ids(df, PATH), ids="crc32").collect()
    assert sorted(r.ids_crc32 for r in sums) == sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in expected)
    assert idfiles.read_ids(spark, idfiles.write_ids(no_documents(spark), PATH)).collect() == []


def test_order_across_files(spark):
    rows = [((i * 7919) % 5000, f"text number {i}") for i in range(5000)] + [(17, "same id " + str(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = idfiles.write_ids(df, PATH)
    got = idfiles.read_ids(spark, path, ids="crc32").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_columns_equal_the_library():
    words, library = WordTokens(PATH), Tokenizer.from_file(PATH)
    texts = ["", "a", "two words", "\n", " ", "lines\nof words\nend", "break\n\nbreak", "é àé", "日本 語", "don't it's\n'll x", " before",
             "after ", "tab\tbed", "1 22 !?", "‧x y", "no-break space", "two words", *(f"{s} in a text" for s in words.special)]
    for column in (texts, texts[1:2], texts[3:4], texts[:3] * 50, texts[:1], []):
        ids, lengths = words.encode_column(pa.array(column, pa.string()))
        expected = [library.encode(t, add_special_tokens=False).ids for t in column]
        assert ids.tolist() == [i for e in expected for i in e] and lengths.tolist() == [len(e) for e in expected]
    cut = pa.array(texts)[4:9]
    assert words.encode_column(cut)[0].tolist() == [i for t in texts[4:9] for i in library.encode(t, add_special_tokens=False).ids]


def test_different_words_are_encoded_once(monkeypatch):
    words, encoded = WordTokens(PATH), []
    fast = words.fast
    monkeypatch.setattr(words, "fast", lambda text: encoded.append(text) or fast(text))
    words.encode_column(pa.array(["some words again and again\nsome words"] * 500))
    # "some" opens a text and a line, and each other word is there once.
    assert sum(map(len, encoded)) == len("\nsome words again and\n")


@pytest.mark.parametrize("damaged", [b"\0\0\0\0\0\0", b"\xff\xff\xff\xff\xff\xff"])
def test_damaged_strips(damaged):
    ids = np.random.default_rng(3).integers(0, 3000, 9000).astype(np.uint32)
    data = idfiles.write_segment([1], [len(ids)], ids)
    _, model, numbers = mixing.alphabet_of(ids)
    block = mixing.encode_blocks([numbers[:mixing.BLOCK_IDS]], model)[0]
    at = data.index(block)
    with pytest.raises(idfiles.BrokenSegment):
        idfiles.read_segment(data[:at] + damaged + data[at + len(damaged):])
    with pytest.raises(idfiles.BrokenSegment):
        idfiles.read_segment(data[:-3])


def test_seconds_of_a_segment():
    """Ids cost a few times what deflate takes, not tens of times: the check's budget of CPU seconds leaves no more."""
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.2, mixing.LANES * mixing.BLOCK_IDS), 20_000).astype(np.uint32)
    start = process_time()
    assert (idfiles.read_segment(idfiles.write_segment([1], [len(ids)], ids))[2] == ids).all()
    coded = process_time()
    zlib.compress(ids.astype("<u2").tobytes())
    assert coded - start < 4 * (process_time() - coded)


def test_strips_learn_while_they_are_coded():
    """What the segment as a whole does not tell: a strip learns which order is right, and what follows what, from its own ids."""
    rng = np.random.default_rng(5)
    # Every block repeats 60 pairs of its own, which are too few to be learned of the segment.
    blocks = [rng.integers(0, 50_000, (60, 2))[rng.integers(0, 60, mixing.BLOCK_IDS // 2)].ravel() for _ in range(60)]
    _, model, numbers = mixing.alphabet_of(np.concatenate(blocks))
    model.next2[:] = 0
    model.next1 &= ~15
    parts = np.split(numbers, len(blocks))
    coded = mixing.encode_blocks(parts, model)
    assert all((a == b).all() for a, b in zip(parts, mixing.decode_blocks(coded, [len(b) for b in blocks], model), strict=True))
    alone = mixing.encode_blocks([rng.permutation(numbers)[:mixing.BLOCK_IDS] for _ in range(60)], model)
    assert sum(map(len, coded)) < 0.75 * sum(map(len, alone))
    # Half of the strips follow the model, half never do: shares of one model suit neither.
    cycle = np.tile(np.arange(50), 400)[:4 * mixing.BLOCK_IDS]
    noise = rng.integers(0, 50, 4 * mixing.BLOCK_IDS)
    _, model, numbers = mixing.alphabet_of(np.concatenate([cycle, noise]))
    size = sum(map(len, mixing.encode_blocks(np.split(numbers, 8), model)))
    assert size < 1.1 * (len(noise) * np.log2(50) / 8) + 0.2 * len(cycle) / 8
