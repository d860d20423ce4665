"""Spelling variants: words one edit apart, found through a reduced alphabet.

1. Words are counted in each task and summed in a shuffle of partial counts.
2. Every word is written in a reduced alphabet: a hash of each letter gives one
   of SYMBOLS symbols. Words one edit apart have reduced words that are equal or
   one edit apart.
3. The one-edit neighbourhood of every different reduced word is generated as
   64-bit numbers and joined with the reduced vocabulary. Being neighbours goes
   both ways, so of two reduced words the one generates that is longer or has the
   larger symbol at the edit: deletions, replacements by smaller symbols, and
   itself are generated, and with the mirrored half nothing is missed.
4. The words behind a pair of reduced words are compared as they are spelled.

Numbers are polynomials of the symbols modulo 2**64; two reduced words with one
number only add a pair that step 4 rejects. No key holds more rows than words
share a reduced word or a neighbour of one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches, written

# Runs of these letters are words; A-Z are lower-cased first.
LETTERS = "[a-zÀ-ÿ]+"
# One run of a document in so many loses a letter.
LOSING = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form occurs so many times as often as its variant.
DOMINANCE = 10
SYMBOLS = 8

# Different words a task counts before it passes them on.
_HELD_WORDS = 200_000
# The base of the polynomials is odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _thinned(doc_id, run: str) -> str:
    """The run, less one letter where the hash of document and run says so."""
    spelled = f"{'' if doc_id is None else doc_id}:{run}"
    h = zlib.crc32(spelled.encode())
    if h % LOSING:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` letters and ``least_count`` occurrences.

    A null or empty text has no words; a null doc_id is spelled as nothing in
    the hash. Repeated rows count as often as they occur; an empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    def run(batches) -> Iterable:
        find = re.compile(LETTERS).findall
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # Bytes are lower-cased by A-Z alone.
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    if len(word) >= least_length:
                        word = _thinned(doc_id, word)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield [list(held), list(held.values())]
                    held = Counter()
        yield [list(held), list(held.values())]

    partial = map_batches(docs.where("text <> ''").select(F.col("doc_id").cast("string"), "text"), run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced_words(words: list[str]) -> list[str]:
    """Each letter as the digit of its symbol, 1 to SYMBOLS."""
    digits = {c: str(1 + (c * 0x9E3779B1 >> 16 & 0xFFFF) * SYMBOLS // 0x10000) for c in set(map(ord, set().union(*words)))}
    return [w.translate(digits) for w in words]


def _powers(n: int) -> np.ndarray:
    powers = np.empty(n, np.uint64)
    at = 1
    for i in range(n):
        powers[i] = at
        at = at * _BASE & _MASK
    return powers


def _rows_of(reduced: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols) of the reduced words of each length, symbols as a matrix."""
    symbols = np.frombuffer("".join(reduced).encode(), np.uint8) - np.uint8(48)
    lengths = np.array([len(w) for w in reduced], np.int64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        yield places, symbols[starts[places, None] + np.arange(length)].astype(np.uint64)


def reduced_numbers(reduced: list[str]) -> np.ndarray:
    """The number of each reduced word."""
    numbers = np.zeros(len(reduced), np.uint64)
    for places, symbols in _rows_of(reduced):
        numbers[places] = (symbols * _powers(symbols.shape[1])).sum(axis=1, dtype=np.uint64)
    return numbers


def reduced_neighbours(reduced: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, numbers): the generated half of every reduced word's one-edit neighbourhood, itself included."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    for places, symbols in _rows_of(reduced):
        length = symbols.shape[1]
        terms = symbols * _powers(length)
        whole = terms.sum(axis=1, dtype=np.uint64)
        yield places, whole
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        for at in range(length):
            # Deleting any symbol of a run of equal ones gives the same word.
            last = symbols[:, at] != symbols[:, at + 1] if at + 1 < length else np.ones(len(places), bool)
            left = (before[:, at] + (whole - before[:, at] - terms[:, at]) * inverse)[last]
            yield places[last], left
            step = _powers(at + 1)[at]
            for smaller in range(1, SYMBOLS):
                fits = symbols[:, at] > smaller
                yield places[fits], (whole[fits] - (symbols[fits, at] - np.uint64(smaller)) * step)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words that differ by one inserted, deleted or replaced letter, both ways.

    ``words`` has one row per (word, n).
    """
    def reduce(batches) -> Iterable:
        for batch in batches:
            reduced = reduced_words(batch.column(0).to_pylist())
            yield [pa.array(reduced_numbers(reduced).view(np.int64)), reduced, batch.column(0), batch.column(1)]

    def neighbours(batches) -> Iterable:
        for batch in batches:
            own, held, size = batch.column(0), [], 0
            for places, numbers in reduced_neighbours(batch.column(1).to_pylist()):
                held.append((places, numbers))
                size += len(places)
                if size >= 200_000:
                    yield _flat(held, own)
                    held, size = [], 0
            if held:
                yield _flat(held, own)

    def _flat(held: list, own: pa.Array) -> list:
        places, numbers = (np.concatenate(x) for x in zip(*held))
        return [pa.array(numbers.view(np.int64)), pc.take(own, pa.array(places))]

    coded = written(map_batches(words.select("word", "n"), reduce, "number long, reduced string, word string, n long"), "reduced-words")
    vocabulary = coded.select("number", "reduced").distinct()
    generated = map_batches(vocabulary, neighbours, "b long, a long")
    pairs = generated.join(vocabulary.select(F.col("number").alias("b")), "b", "left_semi").distinct()
    left = coded.select(F.col("number").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    right = coded.select(F.col("number").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    # A pair of one reduced word with itself meets every two of its words twice: one order is enough.
    found = (pairs.join(left, "a").join(right, "b")
             .where(((F.col("a") != F.col("b")) | (F.col("word_a") < F.col("word_b")))
                    & (F.abs(F.length("word_a") - F.length("word_b")) <= 1)
                    & (F.levenshtein("word_a", "word_b", 1) == 1))
             .select("word_a", "n_a", "word_b", "n_b"))
    both = F.explode(F.array(
        F.struct(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("word_b").alias("word"), F.col("n_b").alias("n"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n"))))
    return found.select(both.alias("p")).select("p.*")


def group_variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near, form, form_n, root.

    The form is the near word of largest n (ties: the smallest word) if it occurs
    ``dominance`` times as often as the word; the root is reached by following
    forms. Each form has ten times the occurrences of its variant, so chains end
    after a few steps; each round doubles the steps taken.
    """
    words = written(words, "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near").alias("near"))).alias("_best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("_best.col1") >= dominance * F.col("n"), F.struct(F.col("_best.near").alias("form"), (-F.col("_best.col1")).alias("form_n"))).alias("_form"))
    judged = written(judged.select("word", "n", "n_near", "_form.form", "_form.form_n"), "forms")
    links = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if links.join(further, "root", "left_semi").isEmpty():
            break
        links = written(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return judged.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of all whole texts with their forms and roots; see ``word_counts`` and ``group_variants``."""
    return group_variants(word_counts(docs))
