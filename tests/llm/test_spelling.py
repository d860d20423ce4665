"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

from clientlens.llm import spelling

from .odd import no_documents, odd_documents


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words):
    out = set()
    forms = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out.add((w, n, len(others), forms[w], words[forms[w]] if forms[w] else None))
    rooted = set()
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        rooted.add((*row, root))
    return rooted


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force_with_chains_and_ties(spark):
    words = {"aaaaaaa": 5000, "aaaaaab": 500, "aaaaabb": 50, "aaaabbb": 5, "aaaaaac": 500, "aaaaaaaa": 2, "zzéàÿöz": 40, "zzeàÿöz": 4,
             "aabaabaab": 30, "aababaab": 3, "abaabaab": 3, "aabaabaaba": 300, "x" * 3000: 20, "x" * 2999: 2, "onlyone": 2}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group_variants(given)) == brute(words)


def test_random_words_over_few_letters(spark):
    import random

    random.seed(4)
    words = {"".join(random.choice("abyéÿ") for _ in range(random.randint(7, 9))): random.choice([2, 20, 300]) for _ in range(700)}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group_variants(given)) == brute(words)


def test_texts_with_lost_letters_and_odd_rows(spark):
    df, rows = odd_documents(spark)
    more = [(i, "Wonderful SENTENCES about wonderfull sentences, ÀÉÎÕÜßÿ ×÷×÷×÷× " * 3) for i in range(100, 260)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    got = rows_of(spelling.spelling_variants(df.select("doc_id", "text").union(extra)))
    assert got == brute(counted([*rows, *more]))
    assert any(r[3] == "wonderful" for r in got)
    assert rows_of(spelling.spelling_variants(no_documents(spark))) == set()
