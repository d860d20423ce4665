"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule, so a policy (a named set of rules that decides) is
a bitwise test on the ledger, and what a rule contributes to a policy is a sum
over bits: neither reads a text again.

Everything is a Spark SQL expression on one row; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import let

# White space that ends a word, and the symbols that are counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# A rule fails where its condition over the measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "10 * n_exclaims > 5 * n_words",
}

# Which rules decide, by version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": tuple(RULES),
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _repeated_positions(windows: Column) -> Column:
    """Places of windows whose hash occurs twice or more, in order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(ordered: Column) -> Column:
        def place(e: Column, j: Column) -> Column:
            before, after = F.get(ordered, j - 1), F.get(ordered, j + 1)
            return F.when((before["h"] == e["h"]) | (after["h"] == e["h"]), e["i"])
        return F.transform(ordered, place)

    return F.sort_array(F.array_compact(let(placed, marked)))


def _covered(places: Column) -> Column:
    """Words inside the windows that begin at ``places``."""
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n))


def repeated_words(words: Column) -> Column:
    """Words in windows of eight words that are found twice or more, the first included."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0))
            .otherwise(_covered(_repeated_positions(w)))))


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit k is set where rule k fails.

    Measurements: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (lines with a word), n_exclaims. A null or empty text has none of
    anything and fails few_words. Repeated rows give repeated rows, an empty
    table gives none; columns other than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    lines = let(F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, SPACES)) > 0),
                lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")))
    measured = docs.select(
        "doc_id", words.alias("_words"), lines.alias("_lines"),
        F.length(_without(text, SPACES)).alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).alias("n_exclaims"),
    ).select(
        "doc_id", *(c.cast("long").alias(name) for name, c in {
            "n_words": F.col("_words.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
            "n_dup_lines": F.col("_lines.repeated"), "n_repeat_words": F.col("_words.repeated"),
            "n_lines": F.col("_lines.n"), "n_exclaims": F.col("n_exclaims")}.items()))
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.select("*", bits.alias("failed"))


def mask_of(names: tuple[str, ...], rules: Mapping[str, str] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(name) for name in set(names))


def passes(names: tuple[str, ...], rules: Mapping[str, str] = RULES) -> Column:
    """Whether no rule of a policy failed."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) == 0


def ablations(entries: DataFrame, names: tuple[str, ...], rules: Mapping[str, str] = RULES) -> DataFrame:
    """One row per rule of a policy: documents that fail it, and documents that only it rejects.

    Patterns of failed bits are counted first (two to the number of rules at
    most), so the texts and measurements take no part.
    """
    mask = F.lit(mask_of(names, rules)).cast("long")
    patterns = entries.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    order = list(rules)
    table = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << order.index(name)).cast("long").alias("bit"))
                                for name in names)))
    return (patterns.select("failed", "n", table.alias("r"))
            .groupBy("r.rule").agg(
                F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))
