"""Queries over documents, vectors, the graph, audit records, conversations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.functions import keys, registry, text
from clientlens.functions.vectors import cosine
from clientlens.operators import admission, audit, conversations, documents, graph, search, similar_documents, text_index
from clientlens.session import scratch_path
from clientlens.sources import domain as d
from clientlens.sources.tables import load_table, stream_table
from clientlens.streaming import admission as stream_admission
from clientlens.streaming.alerts import stream_alerts
from clientlens.streaming.audit import stream_audit
from workload.oracle_views import UNI_WS
from workload.registry import flat, joined, query, stamp

AS_OF = d.AS_OF


def _documents(spark, directory):
    return load_table(spark, directory, "documents")


# --- text rules ------------------------------------------------------------------

def _mask_sql(table: str, key: str, column: str) -> str:
    patterns = [
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
        r"\b\d{3}-\d{2}-\d{4}\b",
        r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
        r"\b\d{10,12}\b",
    ]
    steps = [f"m0 AS (SELECT {key}, {column} AS t FROM {table})"]
    for i, p in enumerate(patterns):
        stars = "CASE WHEN length(h) <= 4 THEN repeat('*', length(h)) ELSE left(h, 2) || repeat('*', length(h) - 4) || right(h, 2) END"
        steps.append(f"""m{i + 1} AS (SELECT {key}, array_to_string(list_transform(range(1, len(g) + 1),
            lambda i: g[i] || coalesce(list_transform(hs, lambda h: {stars})[i], '')), '') AS t
            FROM (SELECT {key}, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS hs FROM m{i}))""")
    return f"WITH {', '.join(steps)} SELECT {key}, t AS masked FROM m{len(patterns)}"


@query("S1_mask_text", _mask_sql("documents", "doc_id", "text"))
def _(spark, directory):
    return _documents(spark, directory).select("doc_id", text.mask_text(F.col("text")).alias("masked"))


@query("S1_mask_finance_text", _mask_sql("finance_text", "doc_id", "text"))
def _(spark, directory):
    return d.finance_text(spark, directory).select("doc_id", text.mask_text(F.col("text")).alias("masked"))


@query("S2_mask_columns", """
    SELECT '***MASKED***' AS c_custkey, c_name, c_nationkey AS nation, '***MASKED***' AS secret_code, c_acctbal,
           left(mail, 2) || repeat('*', length(mail) - 4) || right(mail, 2) AS email
    FROM (SELECT *, 'client' || c_custkey || '@bank.com' AS mail FROM customer)""")
def _(spark, directory):
    mail = F.concat(F.lit("client"), F.col("c_custkey").cast("string"), F.lit("@bank.com"))
    c = load_table(spark, directory, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("nation"), "c_acctbal",
        F.struct(F.col("c_mktsegment").alias("secret_code"), mail.alias("email")).alias("inner"))
    return text.mask_columns(c).select("c_custkey", "c_name", "nation", "inner.secret_code", "c_acctbal", "inner.email")


_ENTITY_SQL = r"""
    found AS (SELECT doc_id, regexp_extract_all(text, '\$[\d,]+(?:\.\d{2})?') AS amounts,
              regexp_extract_all(text, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') AS dates,
              regexp_extract_all(text, '\d+(?:\.\d+)?%') AS percentages,
              regexp_extract_all(text, '\b[\w.-]+@[\w.-]+\.\w+\b') AS emails FROM {table})"""
_ENTITY_FIELDS = ["amounts", "dates", "percentages", "emails"]


def _entities_sql(table: str) -> str:
    return f"""WITH {_ENTITY_SQL.replace('{table}', table)}
    SELECT doc_id, {', '.join(f"array_to_string({f}, '|') AS {f}" for f in _ENTITY_FIELDS)},
           len(amounts) + len(dates) + len(percentages) + len(emails) AS entity_count,
           len(list_filter([amounts, dates, percentages, emails], lambda x: len(x) > 0)) / 4 AS extraction_confidence FROM found"""


def _entities(df):
    found = text.extract_entities(df.select("doc_id", "text"), "text")
    return flat(found, _ENTITY_FIELDS, drop=["text"])


@query("S3_extract_entities", _entities_sql("documents"))
def _(spark, directory):
    return _entities(_documents(spark, directory))


@query("S3_extract_entities_finance", _entities_sql("finance_text"))
def _(spark, directory):
    return _entities(d.finance_text(spark, directory))


@query("S3_entity_rows", f"""WITH {_ENTITY_SQL.replace('{table}', 'finance_text')}
    SELECT doc_id, entity_type, position, value FROM (
      {' UNION ALL '.join(f"SELECT doc_id, '{f}' AS entity_type, unnest({f}) AS value, generate_subscripts({f}, 1) - 1 AS position FROM found"
                          for f in _ENTITY_FIELDS)})""")
def _(spark, directory):
    return text.entity_rows(d.finance_text(spark, directory), "doc_id", "text")


@query("A11_entity_counts", f"""WITH {_ENTITY_SQL.replace('{table}', 'finance_text')}
    SELECT {', '.join(f"sum(len({f})) AS {f}" for f in _ENTITY_FIELDS)},
           sum(len(amounts) + len(dates) + len(percentages) + len(emails)) AS entity_count FROM found""")
def _(spark, directory):
    return text.entity_counts(d.finance_text(spark, directory), "text")


_COMPARED = """
    c AS (SELECT doc_a, doc_b, list_sort(list_intersect(words_a, words_b)) AS common,
                 list_sort(list_filter(words_a, lambda w: NOT list_contains(words_b, w))) AS only_a,
                 list_sort(list_filter(words_b, lambda w: NOT list_contains(words_a, w))) AS only_b FROM pair_words)"""


@query("S4_compare_documents", f"""WITH {_COMPARED},
    r AS (SELECT *, len(common) / greatest(len(common) + len(only_a) + len(only_b), 1)::DOUBLE AS s FROM c)
    SELECT doc_a, doc_b, round(s::DECIMAL(38, 7), 3)::DOUBLE AS similarity_score, len(common) AS common_terms_count,
           len(only_a) AS unique_to_a, len(only_b) AS unique_to_b, 'semantic' AS comparison_type,
           'Documents are ' || round((s * 100)::DECIMAL(38, 7), 1)::DECIMAL(38, 1)::VARCHAR || '% similar' AS summary FROM r""")
def _(spark, directory):
    return documents.compare_documents(d.doc_pairs(spark, directory), _documents(spark, directory))


_WORD_CLASSES = """
    ws AS (SELECT doc_id, list_sort(words) AS words FROM doc_words),
    m AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY words) END AS class_id,
                 len(words) AS n_words FROM ws),
    w AS (SELECT doc_id AS class_id, len(words) AS n, unnest(words) AS word FROM ws
          WHERE doc_id IN (SELECT class_id FROM m)),
    j AS (SELECT a.class_id AS doc_a, b.class_id AS doc_b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n
          FROM w a JOIN w b ON a.word = b.word AND a.class_id < b.class_id GROUP BY a.class_id, b.class_id),
    p AS (SELECT *, n / (n_a + n_b - n)::DOUBLE AS s FROM j WHERE 100 * n >= 80 * (n_a + n_b - n))"""


@query("S4_similar_classes", f"""WITH {_WORD_CLASSES}
    SELECT doc_a, doc_b, round(s::DECIMAL(38, 7), 3)::DOUBLE AS similarity_score, n AS common_terms_count,
           n_a - n AS unique_to_a, n_b - n AS unique_to_b, 'semantic' AS comparison_type,
           'Documents are ' || round((s * 100)::DECIMAL(38, 7), 1)::DECIMAL(38, 1)::VARCHAR || '% similar' AS summary FROM p""")
def _(spark, directory):
    return similar_documents.similar_classes(similar_documents.document_classes(_documents(spark, directory))[1])


@query("S4_similar_documents", f"""WITH {_WORD_CLASSES}
    SELECT doc_id, class_id, n_words, (SELECT count(*) FROM p WHERE class_id IN (doc_a, doc_b)) AS links FROM m""")
def _(spark, directory):
    return similar_documents.similar_documents(_documents(spark, directory))


@query("U1_word_set_operations", f"""WITH {_COMPARED}
    SELECT doc_a, doc_b, array_to_string(common, ' ') AS common, array_to_string(only_a, ' ') AS only_a,
           array_to_string(only_b, ' ') AS only_b, len(common) + len(only_a) + len(only_b) AS union_size FROM c""")
def _(spark, directory):
    sets = documents.word_set_operations(d.doc_pairs(spark, directory), _documents(spark, directory))
    return sets.select("doc_a", "doc_b", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("common", "only_a", "only_b")],
                       "union_size")


_CLASSES = """CASE WHEN contains(lower(text), 'unit trust') OR contains(lower(text), 'fund') THEN 'investment_product'
                   WHEN contains(lower(text), 'kyc') OR contains(lower(text), 'verification') THEN 'kyc_document'
                   WHEN contains(lower(text), 'transaction') THEN 'transaction_record'
                   WHEN contains(lower(text), 'risk') THEN 'risk_assessment' ELSE 'general' END"""


def _classify_sql(table: str) -> str:
    return f"""SELECT doc_id, document_type, 'banking' AS classification_scheme,
        document_type || '|financial_document' AS suggested_categories, array_to_string(found, '|') AS keywords_detected,
        CASE WHEN found = [] THEN 0 ELSE round((len(list_filter(found, lambda k: CASE document_type
            WHEN 'investment_product' THEN k IN ('unit trust', 'fund') WHEN 'kyc_document' THEN k IN ('kyc', 'verification')
            WHEN 'transaction_record' THEN k = 'transaction' ELSE k = 'risk' END)) / len(found))::DECIMAL(38, 7), 3)::DOUBLE END AS confidence
        FROM (SELECT doc_id, {_CLASSES} AS document_type, list_filter(['unit trust', 'fund', 'kyc', 'verification', 'transaction', 'risk'],
                lambda k: contains(lower(text), k)) AS found FROM {table})"""


def _classify(df):
    kinds = text.classify_document(df.select("doc_id", "text"), "text")
    return flat(kinds, ["suggested_categories", "keywords_detected"], drop=["text"])


@query("S5_classify_document", _classify_sql("documents"))
def _(spark, directory):
    return _classify(_documents(spark, directory))


@query("S5_classify_finance_text", _classify_sql("finance_text"))
def _(spark, directory):
    return _classify(d.finance_text(spark, directory))


def _summary_sql(target: int) -> str:
    return f"""SELECT doc_id, len(w) AS original_word_count, {target} AS summary_word_count,
        array_to_string(w[1:{target}], ' ') AS summary
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{UNI_WS}'), lambda x: x <> '') AS w FROM documents)"""


@query("S6_summarize", _summary_sql(50))
def _(spark, directory):
    brief = text.summarize(_documents(spark, directory).select("doc_id", "text"), "text")
    return brief.drop("text", "key_points", "focus_areas_addressed")


@query("S6_summarize_other_length", _summary_sql(100))
def _(spark, directory):
    other = text.summarize(_documents(spark, directory).select("doc_id", "text"), "text", "short")
    return other.drop("text", "key_points", "focus_areas_addressed")


@query("S9_extract_tables", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
                      generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents),
    f AS (SELECT *, CASE WHEN contains(line, '|') THEN string_split(regexp_replace(trim(line), '^\|(.*)\|$', '\1'), '|')
                         ELSE string_split(trim(line), ',') END AS cells FROM l),
    w AS (SELECT *, CASE WHEN contains(line, '|') THEN CASE WHEN len(cells) >= 2 THEN len(cells) ELSE 0 END
                         WHEN contains(line, ',') THEN -len(cells) ELSE 0 END AS width FROM f),
    b AS (SELECT *, sum(CASE WHEN width IS DISTINCT FROM pw THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
          FROM (SELECT *, lag(width) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM w)),
    t AS (SELECT doc_id, island, min(i) AS first, count(*) AS rows, any_value(abs(width)) AS columns,
                 string_agg(array_to_string(list_transform(cells, lambda c: trim(c)), ';'), '/' ORDER BY i) AS data
          FROM b WHERE width <> 0 GROUP BY doc_id, island HAVING count(*) >= 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS table_index, rows, columns, data FROM t""")
def _(spark, directory):
    tables = text.extract_tables(_documents(spark, directory), "doc_id", "text")
    body = F.array_join(F.transform("data", lambda r: F.array_join(r, ";")), "/")
    return tables.select("doc_id", "table_index", "rows", "columns", body.alias("data"))


@query("S10_cosine", """
    SELECT e.vec_id, c.query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding)::DECIMAL(38, 7), 5)::DOUBLE AS score
    FROM embeddings e JOIN label_centroids c ON c.query_id = e.label""")
def _(spark, directory):
    centroids = d.label_centroids(spark, directory).withColumnRenamed("embedding", "centroid")
    e = load_table(spark, directory, "embeddings")
    return (e.join(centroids, e["label"] == centroids["query_id"])
            .select("vec_id", "query_id", round_half_up(cosine(F.col("embedding"), F.col("centroid")), 5).alias("score")))


@query("S11_text_hash", "SELECT doc_id, md5(text) AS text_hash FROM documents")
def _(spark, directory):
    return _documents(spark, directory).select("doc_id", keys.text_hash(F.col("text")).alias("text_hash"))


@query("S12_request_key", """
    SELECT event_id, md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS request_key FROM events""")
def _(spark, directory):
    return keys.request_key(load_table(spark, directory, "events"), ["user_id", "event_type"]).select("event_id", "request_key")


@query("S13_summarize_result", "SELECT doc_id, left(text, 500) AS result_summary FROM documents")
def _(spark, directory):
    return _documents(spark, directory).select("doc_id", keys.summarize_result(F.col("text")).alias("result_summary"))


def _pii_sql(table: str) -> str:
    return rf"""SELECT *, email_count + phone_count + ssn_count + credit_card_count + account_number_count > 0 AS pii_found FROM (
        SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}')) AS email_count,
               len(regexp_extract_all(text, '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b')) AS phone_count,
               len(regexp_extract_all(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) AS ssn_count,
               len(regexp_extract_all(text, '\b\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}[-\s]?\d{{4}}\b')) AS credit_card_count,
               len(regexp_extract_all(text, '\b\d{{10,12}}\b')) AS account_number_count FROM {table})"""


@query("S14_detect_pii", _pii_sql("documents"))
def _(spark, directory):
    return text.detect_pii(_documents(spark, directory).select("doc_id", "text"), "text").drop("text")


@query("S14_detect_pii_finance", _pii_sql("finance_text"))
def _(spark, directory):
    return text.detect_pii(d.finance_text(spark, directory).select("doc_id", "text"), "text").drop("text")


def _route_sql(table: str, key: str) -> str:
    rules = {
        "customer_specialist": ("customer", "profile", "balance"),
        "product_specialist": ("product", "recommend", "unit trust", "fund"),
        "compliance_officer": ("kyc", "aml", "sanction", "compliance"),
        "analytics_expert": ("calculate", "analyze", "convert", "metric"),
        "document_analyst": ("document", "factsheet", "summar"),
    }
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in ps) + f" THEN '{n}' END"
                     for n, ps in rules.items())
    return f"""SELECT {key}, array_to_string(s, '|') AS specialists, s[1] AS specialist,
        CASE WHEN len(s) > 1 THEN 'sequential' WHEN len(s) = 1 THEN 'direct' ELSE 'none' END AS routing
        FROM (SELECT {key}, list_filter([{hits}], lambda x: x IS NOT NULL) AS s FROM {table})"""


@query("S15_route_turns", _route_sql("conversations", "conv_id, turn"))
def _(spark, directory):
    turns = load_table(spark, directory, "conversations").select("conv_id", "turn", "text")
    return flat(text.route_turns(turns, "text"), ["specialists"], drop=["text"])


@query("S15_route_finance_text", _route_sql("finance_text", "doc_id"))
def _(spark, directory):
    return flat(text.route_turns(d.finance_text(spark, directory).select("doc_id", "text"), "text"), ["specialists"], drop=["text"])


@query("S16_json_field", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, directory):
    return keys.json_field(load_table(spark, directory, "events"), "props", "$.k", "k", "bigint").select("event_id", "k")


# --- search ------------------------------------------------------------------------

_NEAR = """
    near AS (SELECT c.query_id, e.vec_id AS vector_id,
                    round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) AS score
             FROM label_centroids c CROSS JOIN embeddings e)"""


@query("H1_vector_search", f"""WITH {_NEAR}
    SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
    FROM near WHERE score >= 0.3 QUALIFY rank <= 5""")
def _(spark, directory):
    return search.vector_search(d.label_centroids(spark, directory), load_table(spark, directory, "embeddings"), 5, 0.3)


@query("O2_default_results", f"""WITH {_NEAR}
    SELECT query_id, count(*) AS results, max(score) AS best FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM near WHERE score >= 0
      QUALIFY rank <= 5) GROUP BY query_id""")
def _(spark, directory):
    found = search.vector_search(d.label_centroids(spark, directory), load_table(spark, directory, "embeddings"), threshold=0.0)
    return found.groupBy("query_id").agg(F.count("*").alias("results"), F.max("score").alias("best"))


@query("H2_hybrid_search", f"""WITH {_NEAR}
    SELECT query_id, vector_id, md5(d.text) AS content_hash, score AS vector_score, true AS keyword_match,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
    FROM near JOIN documents d ON d.doc_id = vector_id WHERE contains(lower(d.text), 'the') AND score >= 0.1 QUALIFY rank <= 5""")
def _(spark, directory):
    found = search.hybrid_search(d.label_centroids(spark, directory), load_table(spark, directory, "embeddings"),
                                 _documents(spark, directory), "The", 5, 0.1)
    return found.withColumn("content_hash", F.md5("content")).drop("content")


def _text_search_sql(table: str, terms: tuple[str, ...], key: str = "doc_id", tail: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""toks AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '{UNI_WS}'), lambda x: x <> '')) AS w FROM {table}),
    tf AS (SELECT {key}, w, count(*) AS tf FROM toks GROUP BY ALL),
    idf AS (SELECT w, ln((SELECT count(*) FROM {table}) / count(*)) AS idf FROM tf WHERE w IN ({listed}) GROUP BY w),
    dn AS (SELECT {key}, sqrt(sum(pow(1 + ln(tf), 2))) AS dn FROM tf GROUP BY 1),
    scores AS (SELECT {key}, round((sum((1 + ln(tf)) * idf) / any_value(dn) / (SELECT sqrt(sum(idf * idf)) FROM idf))::DECIMAL(38, 7), 6)::DOUBLE
                 AS relevance_score FROM tf JOIN idf USING (w) JOIN dn USING ({key}) GROUP BY {key})"""


@query("H3_text_search", f"""WITH {_text_search_sql('documents', ('ention', 'que', 'ther'))}
    SELECT doc_id, relevance_score FROM scores ORDER BY relevance_score DESC, doc_id LIMIT 10""")
def _(spark, directory):
    return search.text_search(_documents(spark, directory), "que ther ention", 10)


@query("H3_index_search", f"""WITH {_text_search_sql('documents', ('ention', 'que', 'ther'))}
    SELECT doc_id, relevance_score FROM scores ORDER BY relevance_score DESC, doc_id LIMIT 10""")
def _(spark, directory):
    docs, path = _documents(spark, directory), scratch_path(spark, "text-index")
    text_index.add_documents(docs.where("doc_id % 3 > 0"), path)
    text_index.add_documents(docs.where("doc_id % 3 = 0 OR doc_id IS NULL"), path)
    return text_index.index_search(spark, path, "que ther ention", 10)


@query("F4_index_scores", f"""WITH {_text_search_sql('finance_text', ('client', 'refund', 'note'))}
    SELECT doc_id, relevance_score FROM scores""")
def _(spark, directory):
    path = scratch_path(spark, "text-index")
    text_index.add_documents(d.finance_text(spark, directory), path)
    return text_index.index_scores(spark, path, "refund note client")


@query("O1_first_results", f"""WITH {_text_search_sql('finance_text', ('fund', 'refund'))}
    SELECT doc_id, relevance_score FROM scores ORDER BY relevance_score DESC, doc_id LIMIT 5""")
def _(spark, directory):
    return search.text_search(d.finance_text(spark, directory), "Refund fund")


@query("F4_search_documents", f"""WITH {_text_search_sql('finance_text', ('client', 'refund', 'note'))},
    hits AS (SELECT f.doc_id, f.source, {_CLASSES} AS document_type, s.relevance_score FROM finance_text f JOIN scores s USING (doc_id))
    SELECT doc_id, source, document_type, relevance_score,
           (SELECT count(*) FROM hits WHERE document_type = 'investment_product') AS total_results
    FROM hits WHERE document_type = 'investment_product' ORDER BY relevance_score DESC, doc_id LIMIT 7""")
def _(spark, directory):
    docs = d.finance_text(spark, directory)
    scores = search.text_scores(docs, "refund note client")
    typed = text.classify_document(docs, "text").select("doc_id", "source", "document_type")
    return search.search_documents(typed, scores, "investment_product", 7)


def _store(spark, directory):
    """One stored answer per label: its centroid under the text of the label's first document."""
    e = load_table(spark, directory, "embeddings")
    docs = _documents(spark, directory).select("doc_id", "text")
    # Only the first documents' texts take part, not all texts: one id a label is broadcast.
    least = e.join(docs.select("doc_id"), e["vec_id"] == F.col("doc_id")).groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    first = docs.join(F.broadcast(least), "doc_id").groupBy("label").agg(F.min_by("text", "doc_id").alias("text"))
    centroids = d.label_centroids(spark, directory)
    return centroids.join(first, centroids["query_id"] == first["label"]).select(
        F.col("query_id").cast("long").alias("insert_seq"), "text", "embedding",
        F.concat(F.lit("answer "), F.col("query_id").cast("string")).alias("response"))


@query("J10_semantic_match", """
    WITH store AS (SELECT c.query_id AS insert_seq, f.text, c.embedding, 'answer ' || c.query_id AS response
                   FROM label_centroids c JOIN (SELECT label, arg_min(text, doc_id) AS text FROM embeddings
                     JOIN documents ON doc_id = vec_id GROUP BY 1) f ON f.label = c.query_id),
    q AS (SELECT d.doc_id AS query_id, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
    exact AS (SELECT q.query_id, min(s.insert_seq) AS seq FROM q JOIN store s ON s.text = q.text GROUP BY 1),
    near AS (SELECT q.query_id, min(s.insert_seq) AS seq,
                    arg_min(round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding), 6), s.insert_seq) AS score
             FROM q JOIN store s ON round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding), 6) >= 0.2
             WHERE q.embedding IS NOT NULL AND q.query_id NOT IN (SELECT query_id FROM exact) GROUP BY 1)
    SELECT q.query_id, coalesce(x.seq, n.seq) AS insert_seq, 'answer ' || coalesce(x.seq, n.seq) AS response,
           CASE WHEN x.seq IS NOT NULL THEN 'exact' WHEN n.seq IS NOT NULL THEN 'semantic' ELSE 'none' END AS match_type,
           CASE WHEN x.seq IS NOT NULL THEN 1.0::DOUBLE ELSE n.score END AS score
    FROM q LEFT JOIN exact x USING (query_id) LEFT JOIN near n USING (query_id)""")
def _(spark, directory):
    e = load_table(spark, directory, "embeddings")
    docs = _documents(spark, directory)
    asked = docs.join(e, docs["doc_id"] == e["vec_id"], "left").select(F.col("doc_id").alias("query_id"), "text", "embedding")
    return search.semantic_match(asked, _store(spark, directory), 0.2)


# --- graph -------------------------------------------------------------------------

@query("G1_entity_neighbourhood", """
    WITH RECURSIVE seed AS (SELECT id FROM nodes WHERE type = 'product' AND contains(lower(name), 'red widget')),
    reach AS (SELECT id, 0 AS hop FROM seed UNION SELECT e.dst, r.hop + 1 FROM reach r JOIN edges e ON e.src = r.id WHERE r.hop < 2),
    near AS (SELECT id, min(hop) AS hop FROM reach GROUP BY 1)
    SELECT n.id, n.type, n.name, r.hop, e.rel AS relationship, e.dst AS target
    FROM near r JOIN nodes n USING (id) LEFT JOIN (SELECT DISTINCT * FROM edges) e ON e.src = n.id""")
def _(spark, directory):
    nodes, edges = d.nodes(spark, directory), d.edges(spark, directory)
    near = graph.entity_neighbourhood(nodes, edges, graph.find_entities(nodes, "product", "Red Widget"))
    return near.withColumn("properties", F.col("properties")["name"]).withColumnRenamed("properties", "name")


def _paths_sql(target: str, relations: str = "") -> str:
    """All shortest paths from C1, level by level from its own edges."""
    return f"""
    WITH RECURSIVE e AS (SELECT DISTINCT src, rel, dst FROM edges {relations}), goal AS (SELECT {target} AS id),
    walk AS (SELECT 0 AS length, 'C1' AS head, 'C1' AS nodes, '' AS relationships
             UNION ALL
             SELECT w.length + 1, e.dst, w.nodes || '>' || e.dst, CASE WHEN w.length = 0 THEN e.rel ELSE w.relationships || '>' || e.rel END
             FROM walk w JOIN e ON e.src = w.head WHERE w.length < 4 AND w.head <> (SELECT id FROM goal))
    SELECT length, nodes, relationships FROM walk WHERE head = (SELECT id FROM goal)
      AND length = (SELECT min(length) FROM walk WHERE head = (SELECT id FROM goal))"""


@query("G2_find_paths", _paths_sql("'S1'", "WHERE rel IN ('PLACED', 'CONTAINS', 'SUPPLIED_BY')"))
def _(spark, directory):
    paths = graph.find_paths(d.edges(spark, directory), "C1", "S1", ["PLACED", "CONTAINS", "SUPPLIED_BY"])
    return paths.select("length", joined("nodes", ">").alias("nodes"), joined("relationships", ">").alias("relationships"))


@query("G2_find_paths_any_relation", _paths_sql(
    "(SELECT 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1)"))
def _(spark, directory):
    c = load_table(spark, directory, "customer").where(F.col("c_custkey") == 1)
    region = c.join(load_table(spark, directory, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).first()["n_regionkey"]
    paths = graph.find_paths(d.edges(spark, directory), "C1", f"R{region}")
    return paths.select("length", joined("nodes", ">").alias("nodes"), joined("relationships", ">").alias("relationships"))


# --- audit ---------------------------------------------------------------------------

_ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END"


@query("SK1_write_audit", """
    SELECT strftime(timestamp, '%Y-%m-%d') AS date, action, status, count(*) AS records, count(DISTINCT user_id) AS users
    FROM audit_log GROUP BY ALL""")
def _(spark, directory):
    path = scratch_path(spark, "audit")
    audit.write_audit(d.audit_log(spark, directory), path)
    return (audit.read_audit(spark, path).groupBy(F.col("date").cast("string").alias("date"), "action", "status")
            .agg(F.count("*").alias("records"), F.count_distinct("user_id").alias("users")))


@query("SK2_to_audit_json", f"""
    SELECT '{{"timestamp":"' || {_ISO} || '","action":"' || action || '","user_id":"' || user_id || '","customer_id":"' || customer_id
           || '","details":' || replace(details, ' ', '') || ',"ip_address":null,"session_id":null,"status":"' || status || '"}}'
           AS audit_json
    FROM audit_log""")
def _(spark, directory):
    return audit.to_audit_json(d.audit_log(spark, directory)).select("audit_json")


@query("SK3_structured_json", f"""
    SELECT event_id, '{{"timestamp":"' || {_ISO} || '","message":"' || action || '","service":"audit","user_id":"' || user_id || '"}}' AS log_json
    FROM audit_log""")
def _(spark, directory):
    lines = audit.structured_json(d.audit_log(spark, directory), "timestamp", "action",
                                  {"service": "audit", "user_id": "nobody"}, ["user_id"])
    return lines.select("event_id", "log_json")


_THREADS = """
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations QUALIFY position <= 15)"""


@query("SK4_export_conversations", f"""WITH {_THREADS}
    SELECT '2001-08-01T00:00:00' AS exported_at, conv_id, count(*) AS messages, string_agg(role, '|' ORDER BY turn) AS roles,
           md5(string_agg(text, '|' ORDER BY turn)) AS content_hash FROM t GROUP BY conv_id""")
def _(spark, directory):
    path = scratch_path(spark, "export")
    conversations.export_conversations(load_table(spark, directory, "conversations"), path, "2001-08-01T00:00:00")
    back = spark.read.schema("exported_at string, conv_id long, messages array<struct<role string, content string>>").json(path)
    return back.select("exported_at", "conv_id", F.size("messages").alias("messages"), joined("messages.role").alias("roles"),
                       F.md5(joined("messages.content")).alias("content_hash"))


@query("F5_query_audit", """
    SELECT event_id, action, user_id, details FROM audit_log
    WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00' AND action = 'purchase'""")
def _(spark, directory):
    found = audit.query_audit(d.audit_log(spark, directory), "2024-01-05", "2024-01-20 12:00:00", "purchase", "")
    return found.select("event_id", "action", "user_id", "details")


@query("A10_audit_usage", """
    SELECT action, user_id, count(*) AS calls, count(DISTINCT customer_id) AS customers_accessed,
           round(avg(execution_time_ms)::DECIMAL(38, 7), 4)::DOUBLE AS avg_execution_time_ms FROM audit_log GROUP BY ALL""")
def _(spark, directory):
    usage = audit.audit_usage(d.audit_log(spark, directory))
    return usage.withColumn("avg_execution_time_ms", round_half_up(F.col("avg_execution_time_ms"), 4))


def _calls(spark, directory):
    log = d.audit_log(spark, directory)
    return log.withColumn("tool", F.col("action")).withColumn("arguments", F.col("details")).withColumn("result", F.repeat("action", 100))


_CALL = """'{"tool":"' || action || '","arguments":' || replace(details, ' ', '') || ',"result_summary":"' || left(repeat(action, 100), 500)
           || '","execution_time_ms":'"""


@query("SK1_tool_call_entries", f"""
    SELECT event_id, 'tool_call' AS action, user_id, {_CALL} AS details_start FROM audit_log""")
def _(spark, directory):
    entries = audit.tool_call_entries(_calls(spark, directory), ["event_id"])
    return entries.select("event_id", "action", "user_id", F.regexp_extract("details", '^(.*"execution_time_ms":)', 1).alias("details_start"))


@query("SK1_customer_access_entries", """
    SELECT event_id, 'customer_data_access' AS action, customer_id,
           '{"access_type":"' || action || '","data_fields":' || CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '["name","details"]' END || '}' AS details
    FROM audit_log""")
def _(spark, directory):
    fields = F.when(F.col("event_id") % 3 > 0, F.array(F.lit("name"), F.lit("details")))
    accesses = d.audit_log(spark, directory).withColumn("access_type", F.col("action")).withColumn("data_fields", fields)
    return audit.customer_access_entries(accesses, ["event_id"]).select("event_id", "action", "customer_id", "details")


@query("A10_audit_usage_of_tools", """
    SELECT action, user_id, count(*) AS calls, count(DISTINCT customer_id) AS customers_accessed,
           round(avg(execution_time_ms)::DECIMAL(38, 7), 4)::DOUBLE AS avg_execution_time_ms FROM audit_log GROUP BY ALL""")
def _(spark, directory):
    entries = audit.tool_call_entries(_calls(spark, directory))
    logged = keys.json_field(keys.json_field(entries, "details", "$.tool", "tool"), "details", "$.execution_time_ms", "execution_time_ms", "double")
    usage = audit.audit_usage(logged.withColumn("action", F.col("tool")))
    return usage.withColumn("avg_execution_time_ms", round_half_up(F.col("avg_execution_time_ms"), 4))


_ARGS_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}, "limit": {"type": "integer"}}, "required": ["k"]}


@query("F11_validate_json_args", """
    SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::BIGINT AS "limit", '' AS missing, true AS valid FROM events""")
def _(spark, directory):
    checked = audit.validate_json_args(load_table(spark, directory, "events").select("event_id", "props"), "props", _ARGS_SCHEMA)
    return checked.select("event_id", "args.k", "args.limit", joined("missing").alias("missing"), "valid")


@query("F11_validate_json_args_missing", """
    SELECT event_id, 'customer_id' AS missing, 'k' AS mistyped, false AS valid FROM events""")
def _(spark, directory):
    schema = {"properties": {"customer_id": {"type": "string"}, "k": {"type": "boolean"}}, "required": ["customer_id", "k"]}
    checked = audit.validate_json_args(load_table(spark, directory, "events").select("event_id", "props"), "props", schema)
    return checked.select("event_id", joined("missing").alias("missing"), joined("mistyped").alias("mistyped"), "valid")


# --- conversations -------------------------------------------------------------------

@query("T1_thread_stats", """
    SELECT conv_id, count(*) AS messages, count(*) FILTER (role <> 'assistant') AS input_messages,
           count(*) FILTER (role = 'assistant') AS output_messages FROM conversations GROUP BY 1""")
def _(spark, directory):
    return conversations.thread_stats(load_table(spark, directory, "conversations"))


@query("T2_last_reply", """
    SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS reply FROM conversations GROUP BY 1""")
def _(spark, directory):
    return conversations.last_reply(load_table(spark, directory, "conversations"))


@query("T3_assemble_threads", f"""WITH {_THREADS}
    SELECT conv_id, count(*) AS messages, string_agg(turn || ':' || role || ':' || md5(text), '|' ORDER BY turn) AS thread
    FROM t GROUP BY conv_id""")
def _(spark, directory):
    threads = conversations.assemble_threads(load_table(spark, directory, "conversations"))
    one = F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], F.md5(m["text"])))
    return threads.select("conv_id", F.size("messages").alias("messages"), joined(one).alias("thread"))


@query("O3_latest_message", """
    SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1""")
def _(spark, directory):
    return conversations.latest_message(load_table(spark, directory, "conversations"))


@query("O4_capped_turns", """
    SELECT conv_id, turn, role, position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations)
    WHERE position <= 4""")
def _(spark, directory):
    return conversations.capped_turns(load_table(spark, directory, "conversations"), 4).drop("text")


@query("U2_append_turns", """
    WITH h AS (SELECT conv_id, turn, role FROM conversations),
    l AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM conversations GROUP BY 1)
    SELECT conv_id, turn, role FROM h
    UNION ALL SELECT h.conv_id, h.turn - l.first + l.last + 1, h.role FROM h JOIN l USING (conv_id)""")
def _(spark, directory):
    turns = load_table(spark, directory, "conversations").select("conv_id", "turn", "role")
    return conversations.append_turns(turns, turns)


# --- order-dependent rules and streams --------------------------------------------------

# Two tokens, one back every 100,000 seconds: the users of the fixture run short.
_SLOW_BUCKET = {"max_tokens": 2, "refill_rate": "0.00001", "cost": 1}
_WEEK = 7 * 86_400

_BUCKET_SQL = """
    WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(timestamp) AS us,
                                row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn FROM audit_log),
    run AS (
      SELECT event_id, user_id, us, rn, 200000000000 - 100000000000 AS tokens, true AS admitted FROM o WHERE rn = 1
      UNION ALL
      SELECT event_id, user_id, us, rn, CASE WHEN t >= 100000000000 THEN t - 100000000000 ELSE t END, t >= 100000000000
      FROM (SELECT o.*, least(200000000000, r.tokens + (o.us - r.us)) AS t FROM run r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
    SELECT event_id, user_id, admitted, round((tokens / 100000000000.0::DOUBLE)::DECIMAL(38, 7), 4)::DOUBLE AS tokens_left FROM run"""


def _bucket_columns(df):
    return df.select("event_id", "user_id", "admitted", round_half_up(F.col("tokens_left"), 4).alias("tokens_left"))


@query("ST3_rate_limit", _BUCKET_SQL)
def _(spark, directory):
    events = d.audit_log(spark, directory).select("event_id", "user_id", "timestamp")
    return _bucket_columns(admission.rate_limit(events, "user_id", slot_seconds=_WEEK, **_SLOW_BUCKET))


@query("ST3_rate_limit_defaults", """
    SELECT user_id, count(*) AS requests, count(*) AS admitted FROM audit_log GROUP BY 1""")
def _(spark, directory):
    events = d.audit_log(spark, directory).select("event_id", "user_id", "timestamp")
    return (admission.rate_limit(events, "user_id").groupBy("user_id")
            .agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted")))


_TTL_SQL = """
    WITH RECURSIVE o AS (SELECT event_id, user_id, action, epoch_us(timestamp) AS us,
                                row_number() OVER (PARTITION BY user_id, action ORDER BY timestamp, event_id) AS rn FROM audit_log),
    run AS (
      SELECT event_id, user_id, action, us, rn, us AS opened, false AS hit FROM o WHERE rn = 1
      UNION ALL
      SELECT o.event_id, o.user_id, o.action, o.us, o.rn, CASE WHEN o.us - r.opened <= 259200000000 THEN r.opened ELSE o.us END,
             o.us - r.opened <= 259200000000
      FROM run r JOIN o ON o.user_id = r.user_id AND o.action = r.action AND o.rn = r.rn + 1)"""


@query("ST4_ttl_repeats", f"{_TTL_SQL} SELECT event_id, user_id, action, hit, opened AS opened_us FROM run")
def _(spark, directory):
    events = d.audit_log(spark, directory).select("event_id", "user_id", "action", "timestamp")
    marked = admission.ttl_repeats(events, ["user_id", "action"], ttl=3 * 86_400, slot_seconds=_WEEK)
    return marked.drop("timestamp")


@query("ST4_ttl_dedup", f"{_TTL_SQL} SELECT event_id, user_id, action FROM run WHERE NOT hit")
def _(spark, directory):
    events = d.audit_log(spark, directory).select("event_id", "user_id", "action", "timestamp")
    return admission.ttl_dedup(events, ["user_id", "action"], ttl=3 * 86_400, slot_seconds=_WEEK).drop("timestamp")


def _event_stream(spark, directory):
    schema = load_table(spark, directory, "events").schema
    return stream_table(spark, directory, schema, "events.parquet")


def _drain(df, label):
    """Run a stream to the end of what has arrived and read what it wrote."""
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    running = (df.writeStream.format("parquet").outputMode("append").option("path", path)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _with_rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("SC4_stream_table", "SELECT event_type, count(*) AS events, sum(event_id) AS ids FROM events GROUP BY 1")
def _(spark, directory):
    arrived = _drain(_event_stream(spark, directory).select("event_id", "event_type"), "stream-table")
    return arrived.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("ST1_stream_audit", """
    SELECT strftime(timestamp, '%Y-%m-%d') AS date, action, count(*) AS records, min(details) AS details FROM audit_log GROUP BY ALL""")
def _(spark, directory):
    path = scratch_path(spark, "stream-audit")
    records = d.audit_columns(_event_stream(spark, directory))
    stream_audit(records, path, scratch_path(spark, "stream-audit-checkpoint")).awaitTermination()
    return (audit.read_audit(spark, path).groupBy(F.col("date").cast("string").alias("date"), "action")
            .agg(F.count("*").alias("records"), F.min("details").alias("details")))


@query("ST1_stream_audit_masked", """
    WITH e AS (SELECT event_id, user_id, value, lpad((event_id % 10000)::VARCHAR, 4, '0') AS n, 'user' || user_id || '@bank.example' AS mail FROM events)
    SELECT event_id, left(mail, 2) || repeat('*', length(mail) - 4) || right(mail, 2) AS mail,
           'call' || chr(10) || '41********' || right(n, 2) AS note, '41***************' || right(n, 2) || chr(9) AS card,
           '***MASKED***' AS token, '***MASKED***' AS password, '12*******' || right(n, 2) AS listed, user_id AS kept
    FROM e""")
def _(spark, directory):
    n = F.lpad((F.col("event_id") % 10_000).cast("string"), 4, "0")
    phone, card = F.concat(F.lit("call\n415-555-"), n), F.concat(F.lit("4111-1111-1111-"), n, F.lit("\t"))
    details = F.to_json(F.struct(
        F.concat(F.lit("user"), "user_id", F.lit("@bank.example")).alias("mail"), phone.alias("note"),
        F.struct(card.alias("card"), F.array(F.concat(F.lit("123-45-"), n), F.lit("plain")).alias("listed")).alias("inner"),
        F.array(F.lit("abc123")).alias("access_token"), F.struct(F.lit("hunter2").alias("value")).alias("password"),
        F.col("user_id").alias("kept")))
    stream = _event_stream(spark, directory)
    records = d.audit_columns(stream.withColumn("props", details)).withColumn("session_id", F.col("event_id").cast("string"))
    path = scratch_path(spark, "stream-audit")
    stream_audit(records, path, scratch_path(spark, "stream-audit-checkpoint")).awaitTermination()
    shown = {"mail": "$.mail", "note": "$.note", "card": "$.inner.card", "token": "$.access_token", "password": "$.password",
             "listed": "$.inner.listed[0]"}
    return audit.read_audit(spark, path).select(
        F.col("session_id").cast("long").alias("event_id"), *[F.get_json_object("details", at).alias(c) for c, at in shown.items()],
        F.get_json_object("details", "$.kept").cast("long").alias("kept"))


_WINDOWED = """
    SELECT user_id AS customer_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS transactions,
           round(sum(value)::DECIMAL(38, 7), 2)::DOUBLE AS total_amount, count(*) FILTER (value >= 200) AS high_value_alerts,
           count(*) FILTER (value >= 100 AND value < 200) AS suspicious_alerts"""


def _window_columns(df):
    return df.select("customer_id", stamp("window_start").alias("window_start"), "transactions",
                     round_half_up(F.col("total_amount"), 2).alias("total_amount"), "high_value_alerts", "suspicious_alerts")


@query("ST2_stream_alerts", f"""{_WINDOWED}
    FROM (SELECT *, date_trunc('day', ts) AS s FROM events) WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    GROUP BY user_id, s""")
def _(spark, directory):
    stream = _event_stream(spark, directory).withColumnRenamed("user_id", "customer_id").withColumnRenamed("value", "amount")
    return _window_columns(_drain(stream_alerts(stream, high=200, suspicious=100), "stream-alerts"))


@query("ST2_alerts_sliding", f"""{_WINDOWED}
    FROM (SELECT e.*, date_trunc('day', ts) - to_days(k::INT) AS s FROM events e CROSS JOIN range(30) r(k))
    GROUP BY user_id, s""")
def _(spark, directory):
    events = (load_table(spark, directory, "events").withColumnRenamed("user_id", "customer_id")
              .withColumnRenamed("value", "amount"))
    return _window_columns(stream_alerts(events, "30 days", slide="1 day", high=200, suspicious=100))


@query("ST3_stream_rate_limit", _BUCKET_SQL)
def _(spark, directory):
    _with_rocksdb(spark)
    events = d.audit_columns(_event_stream(spark, directory)).select("event_id", "user_id", "timestamp")
    return _bucket_columns(_drain(stream_admission.stream_rate_limit(events, "user_id", **_SLOW_BUCKET), "stream-bucket"))


@query("ST4_stream_ttl_repeats", f"{_TTL_SQL} SELECT event_id, user_id, action, hit, opened AS opened_us FROM run")
def _(spark, directory):
    _with_rocksdb(spark)
    events = d.audit_columns(_event_stream(spark, directory)).select("event_id", "user_id", "action", "timestamp")
    marked = stream_admission.stream_ttl_repeats(events, ["user_id", "action"], ttl=3 * 86_400)
    return _drain(marked, "stream-ttl").drop("timestamp")


# --- function surface ---------------------------------------------------------------------

@registry.catalog_function(comment="Share of a price kept after a discount")
def kept_share(price: float, discount: float) -> float:
    return price * (1 - discount)


@query("X1_register_function", """
    SELECT l_returnflag, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount))::DECIMAL(38, 7), 2)::DOUBLE AS kept
    FROM lineitem GROUP BY 1""")
def _(spark, directory):
    registry.register_function(spark, kept_share)
    load_table(spark, directory, "lineitem", view="lineitem")
    return spark.sql("""
        SELECT l_returnflag, count(*) AS lines,
               CAST(round(CAST(sum(kept_share(l_extendedprice, l_discount)) AS DECIMAL(38, 7)), 2) AS DOUBLE) AS kept
        FROM lineitem GROUP BY l_returnflag""")


@query("X2_convert_to_usd", """
    SELECT product_id, round((nav / coalesce(f.rate, 1))::DECIMAL(38, 7), 2)::DOUBLE AS usd FROM unit_trust LEFT JOIN fx f USING (currency)""")
def _(spark, directory):
    registry.create_convert_to_usd(spark)
    d.unit_trust(spark, directory).createOrReplaceTempView("unit_trust")
    return spark.sql("SELECT product_id, convert_to_usd(nav, lower(currency)) AS usd FROM unit_trust")


@query("X3_lookup_customer_info", """
    SELECT customer_id, name, risk_rating, account_balance FROM customers WHERE name = 'Customer#000000042'""")
def _(spark, directory):
    d.customers(spark, directory).createOrReplaceTempView("customers")
    registry.create_lookup_customer_info(spark)
    return spark.sql("SELECT * FROM lookup_customer_info('Customer#000000042')")


@query("X4_lookup_ut_info", """
    SELECT product_id, product_name, risk_rating, currency, expense_ratio FROM unit_trust WHERE risk_rating = 3""")
def _(spark, directory):
    d.unit_trust(spark, directory).createOrReplaceTempView("unit_trust")
    registry.create_lookup_ut_info(spark)
    return spark.sql("SELECT * FROM lookup_ut_info(3)")


@query("X5_unit_trust_vector_search", """
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) AS score,
           row_number() OVER (ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) DESC, e.vec_id) AS rank
    FROM embeddings e CROSS JOIN (SELECT embedding FROM label_centroids WHERE query_id = 3) c QUALIFY rank <= 5""")
def _(spark, directory):
    load_table(spark, directory, "embeddings", view="embeddings")
    d.label_centroids(spark, directory).createOrReplaceTempView("label_centroids")
    registry.create_vector_search(spark)
    return spark.sql("""
        SELECT * FROM unit_trust_vector_search((SELECT embedding FROM label_centroids WHERE query_id = 3), 5)""")
