"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm import (extraction, idfiles, language, negatives, neighbours, packing, pieces, private, quality, rules, scoring,
                            similarity, spelling)
from clientlens.llm.common import crc_remainder, documents, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


@query("op1_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(False))
    model, vocabulary = scoring.fit(docs.where(~held_out).select("text"))
    return scoring.score(docs, model, vocabulary).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids="crc32")


def _piece_digest(ids: list[int], decoded: str) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


@query("op3_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# The rules of the ledger are written out once more, so that the SQL does not depend on the operator.
_RULES_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT row, unnest(range(1, len(words) - 6)) AS i, words FROM parts WHERE len(words) >= 8),
spelled AS (SELECT row, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS w FROM windows),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM spelled) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY row),
measured AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
    FROM parts LEFT JOIN covered USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words
         OR 100 * n_dup_lines > 50 * n_lines OR 10 * n_exclaims > 5 * n_words) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
"""


@query("op4_rules", _RULES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.POLICIES["v1"])).alias("base_failed"),
        (rules.passes(rules.POLICIES["v1"]) & rules.passes(rules.POLICIES["v2"])).alias("kept"))


@query("op5_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def _private_digest(spans: list[private.Span]) -> tuple:
    spelled = [f"{kind}:{start}:{end}" for kind, start, end in spans]
    base = [text for text, span in zip(spelled, spans, strict=True) if span[0] in private.KINDS]
    return (*(sum(span[0] == kind for span in spans) for kind in private.KINDS),
            hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spelled))


@query("op6_private")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return private.find(docs, private.fit(docs), _private_digest,
                        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    network = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), network).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.statistics(documents(spark, sf_dir)), "quality-statistics")
    held_out = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(stats.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.select("doc_id", held_out.alias("held_out"), quality.score_statistics(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op9_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"),
                                _piece_digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op10_similarity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_documents(documents(spark, sf_dir))


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 as SQL: a byte's table entry is the exclusive or of the entries of its bits."""
    bits = []
    for i in range(8):
        entry = 1 << i
        for _ in range(8):
            entry = entry >> 1 ^ 0xEDB88320 * (entry & 1)
        bits.append(f"{entry}*((xor(c, b)>>{i})&1)")
    step = bits[0]
    for bit in bits[1:]:
        step = f"xor({step}, {bit})"
    spelled = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {spelled}), lambda c, b: xor(c>>8, {step})), 4294967295::BIGINT)"


_SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql("doc_id || ':' || run")} AS h FROM counted),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS less
    FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
    UNION ALL SELECT cut.word, words.word FROM cut JOIN words ON less = words.word
    UNION ALL SELECT words.word, cut.word FROM cut JOIN words ON less = words.word)),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form
    FROM near JOIN words o ON other = o.word GROUP BY near.word),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
    CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM judged
    UNION ALL SELECT walk.word, judged.form FROM walk JOIN judged ON walk.at = judged.word WHERE judged.form IS NOT NULL)
SELECT judged.*, walk.at AS root FROM judged JOIN walk USING (word) JOIN judged last ON walk.at = last.word WHERE last.form IS NULL
"""


@query("op11_spelling", _SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


@query("op12_idfiles")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idfiles.write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return idfiles.read_ids(spark, path, ids="crc32")


_NEGATIVES_SQL = """
WITH cells AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM cells a JOIN cells b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
