import random
import re

import numpy as np

from clientlens.llm import private
from clientlens.llm.boosting import BoostedTrees
from clientlens.llm.common import documents
from tests.llm.odd import no_documents, odd_documents


def by_definition(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "25", "+", "-", " ", "x.y", "@b.c", "4111 1111 1111 1111", "1.2.3.4", "é", "%", "\n", "+1 (23)", "@@", "00300."]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert private.base_spans(text) == by_definition(text), repr(text)


def test_tables_spans_and_found_secrets(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = private.fit(docs)
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find(docs, model).collect()}
    secrets = hits = extra = 0
    for r in docs.collect():
        base = by_definition(r.text or "")
        assert found[r.doc_id][:len(base)] == base
        values = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
        more = {(s, e) for k, s, e in found[r.doc_id][len(base):] if k == "secret"}
        secrets, hits, extra = secrets + len(values), hits + len(values & more), extra + len(more - values)
    assert secrets > 5 and hits >= 0.9 * secrets and extra <= 0.05 * secrets


def test_trees_learn_an_interaction_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(int)
    model = BoostedTrees().fit(x[:2500], y[:2500])
    chosen = model.probabilities(x[2500:]) >= model.threshold
    assert (y[2500:][chosen] == 1).mean() > 0.95 and chosen.sum() > 0.8 * y[2500:].sum()
    assert BoostedTrees().fit(x, np.zeros(len(x), int)).threshold > 1


def test_redaction():
    text = "mail a@b.co or c@d.org, card 4111 1111 1111 1111"
    spans = private.base_spans(text)
    assert private.redacted(text, spans) == "mail <EMAIL> or <EMAIL>, card <CARD>"
    assert private.redacted("abcdef", [("x", 1, 4), ("y", 2, 5)]) == "a<X>f"
    assert private.redacted(None, []) is None and private.redacted("", []) == ""


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    model = private.fit(docs)
    assert model.threshold > 1  # nothing to learn from
    found = private.find(docs, model).collect()
    assert len(found) == len(rows) and not any(r.spans for r in found)
    shown = docs.select("text", private.redact_text(model).alias("hidden")).collect()
    assert all(r.text == r.hidden for r in shown)
    assert private.find(no_documents(spark), private.fit(no_documents(spark))).count() == 0


def test_values_that_no_base_rule_takes_are_found(spark):
    filler = [f"order {i} shipped on 2024-0{i % 9 + 1}-1{i % 10}, part no {10 ** 9 + 7919 * i}, name = item{i}" for i in range(300)]
    known = [f"paid with 4111 1111 1111 {1111 + 0 * i} today; password = pa55word{i}; ssn: 219-09-{1000 + i}" for i in range(300)]
    model = private.fit(spark.createDataFrame(list(enumerate(filler + known)), "doc_id long, text string"))
    for text, kind, values in (
            ("password = hunter2", "secret", ["hunter2"]), ('set api_key: "correct horse"', "secret", ["correct horse"]),
            ("passwd=letmein now", "secret", ["letmein"]), ("his ssn: 219-09-9999.", "number", ["219-09-9999"]),
            ("send to GB82 WEST 1234 5698 7654 32 please", "number", ["GB82 WEST 1234 5698 7654 32"]),
            ("call (555) 123-4567 now", "number", ["(555) 123-4567"]),
            ("4111 1111 1111 1111 5500 0000 0000 0004", "number", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
            ("41111111111111115500000000000004", "number", ["4111111111111111", "5500000000000004"])):
        spans = private.spans_of(text, model)
        assert [text[s:e] for k, s, e in spans if k == kind] == values, text
        assert not [k for k, _, _ in spans if k in private.KINDS]
    for text in ("part no 1000791900", "name = item12", "shipped on 2024-01-11"):
        assert private.spans_of(text, model) == [], text
