"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import ann, audit, chat, compression, factorization, katz, langid, mixing, packing, simhash, suffixes, warc, whitening
from fieldscope.llm.common import remainder, stored, table
from fieldscope.session import scratch_path


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), entropy_share=0.9, most_epochs=4.0)
    return mixed.withColumn("weight", F.round("weight", 6))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")), path)
    chunks = warc.read_chunks(spark, path, content=False)
    return warc.records_of(chunks)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factorization.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    scored = factorization.score(docs, machine)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs, "text", "lang", remainder(F.col("doc_id"), 4) != 2)
    found = langid.detect(docs, profiles)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)


def op9_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.conversation_digests(chat.expand(turns.unionByName(extra)))


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2, order=2)


def op11_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_repeats(table(spark, sf_dir, "documents"), least=400)
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"), components=32)
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_temperature_mixing,
        op3_compression_bands,
        op4_warc_chunks,
        op5_sum_of_squares_packing,
        op6_factorization_machine,
        op7_language_mixture,
        op8_collision_counting,
        op9_prefix_target,
        op10_katz_backoff,
        op11_repeat_intervals,
        op12_filter_diagrams,
        op13_polarisation_whitening,
        pipeline,
    )
}

# DuckDB statements, where SQL can express the operator.  They follow the operators' definitions,
# not their plans.  Not expressible: XXH64 (1), zstandard (3), the tokenizer (5), trained models
# (6, 7), an approximate search (8), and Good-Turing backoff over the whole corpus (10).

_MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '?') AS s,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 128 AS block,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
  FROM documents),
b AS (SELECT s, block, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY ALL),
l AS (SELECT list(tokens / total ORDER BY s) AS p FROM (SELECT *, sum(tokens) OVER () AS total FROM t WHERE tokens > 0)),
bisect(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END
  FROM (
    SELECT *, z_log - s_sum / z > 0.9 * ln(len(p)) OR r * c > 4.0 AS flat
    FROM (
      SELECT *, (low + high) / 2 AS mid,
        list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) AS z,
        ln(list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2)))) AS z_log,
        list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ((low + high) / 2) * ln(x))) AS s_sum,
        list_max(list_transform(p, lambda x: pow(x, (low + high) / 2) / x)) AS r,
        list_max(list_transform(p, lambda x: x / pow(x, (low + high) / 2))) AS c
      FROM bisect, l WHERE i < 40))),
alpha AS (SELECT CASE WHEN (SELECT count(*) FROM t WHERE tokens > 0) < 2 THEN 1.0 ELSE high END AS a FROM bisect WHERE i = 40),
w AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, a) ELSE 0 END AS raw FROM (SELECT *, sum(tokens) OVER () AS total FROM t), alpha),
w2 AS (SELECT s, tokens, raw / sum(raw) OVER () AS weight FROM w),
w3 AS (SELECT s, tokens, weight, max(CASE WHEN weight > 0 THEN tokens / weight END) OVER () AS size FROM w2),
w4 AS (SELECT s, tokens, weight, CASE WHEN weight > 0 THEN weight * size / tokens ELSE 1.0 END AS epochs FROM w3),
w5 AS (SELECT s, weight, CAST(floor(epochs + 1e-9) AS BIGINT) AS full_epochs, greatest(epochs - floor(epochs + 1e-9), 0.0) * tokens AS rest FROM w4),
e AS (SELECT b.s, b.block, b.tokens, weight, full_epochs, rest, unnest(range(1, full_epochs + 2)) AS epoch FROM b JOIN w5 USING (s)),
o AS (SELECT *, row_number() OVER q AS place, sum(tokens) OVER (q ROWS UNBOUNDED PRECEDING) - tokens AS before
  FROM e WINDOW q AS (PARTITION BY s, epoch ORDER BY md5(concat_ws('|', 7, epoch, s, block)), block)),
k AS (SELECT * FROM o WHERE epoch <= full_epochs OR (rest > 0 AND before + tokens / 2 <= rest))
SELECT doc_id, source, epoch, block, place, round(weight, 6) AS weight, n_tokens FROM d JOIN k USING (s, block)
"""

_WARC = """
WITH r AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
w AS (SELECT payload, max(page_id) AS winner FROM r WHERE octet_length(payload) >= 1000 GROUP BY payload HAVING count(*) > 1),
j AS (SELECT r.page_id, r.payload, CASE WHEN r.page_id < winner THEN winner END AS refers_to FROM r LEFT JOIN w ON r.payload = w.payload)
SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  CASE WHEN refers_to IS NULL THEN true END AS intact
FROM j
"""

_CHAT = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS size,
  length(replace(replace(replace(replace(role, '\', '\b'), ':', '\c'), '#', '\h'), '<', '\l')) + 4 + 2 + 8
  + length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) AS chars FROM all_turns),
x AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = size) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

_AUDIT = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN first ON d.text = first.text LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o(filter_order, step, f, bit, before) AS (
  SELECT f, 1, f, bit, 0 FROM f
  UNION ALL SELECT filter_order || f.f, step + 1, f.f, f.bit, before + o.bit FROM o JOIN f ON NOT contains(filter_order, f.f)),
s AS (
  SELECT whole.filter_order, o.step, o.f, o.bit, o.before
  FROM (SELECT filter_order FROM o WHERE step = 5) whole JOIN o ON starts_with(whole.filter_order, o.filter_order)),
r AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER ((mask & (before + bit)) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

ORACLES = {"op12_filter_diagrams": _AUDIT, "op2_temperature_mixing": _MIXING, "op4_warc_chunks": _WARC, "op9_prefix_target": _CHAT}
