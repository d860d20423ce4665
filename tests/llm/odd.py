"""Rows that every operator on documents must take, and brute-force helpers."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "One of the long lines that go on. " * 6000

ODD_TEXTS = [None, "", " ", "\n\n \t", "word", "Two words", "same text of a few words here", "same text of a few words here",
             "ends with space ", "  two  spaces\nand\r\nbreaks\x0b\x0c", "日本語のテキスト。", "é ü ß — “quoted”", "123 456 !!! ###", LONG,
             "<|endoftext|> <b>markup</b> &amp; ▁▁"]

# Columns whose names the operators also use inside.
CLASHING = ("score string, n int, key string, token string, tokens string, `set` string, root string, number string, "
            "word string, x string, lang_pred int, n_words string, failed string, row string, part string")


def odd_documents(spark, texts=None):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS if texts is None else texts)]
    rows += [(None, "no id on this row at all"), (None, None)] if texts is None else []
    rows += [rows[6], rows[6]] if texts is None else []  # repeated rows
    names = CLASHING.split(", ")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    filled = [(d, t, "en" if (d or 0) % 2 else None, None, len(t) if t else None,
               *(str(d) if "string" in n else 1 for n in names)) for d, t in rows]
    return spark.createDataFrame(filled, schema), rows


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORDS.findall(text or "")
