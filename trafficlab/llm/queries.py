"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat, decontam, hard_negatives, html_template, imatch, minhash, mixing, resample, sharding, site_lines, suffix_dedup, token_counts,
    toxicity)
from .common import table


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated (document, benchmark item)."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.where("contaminated").select(
        "doc_id", F.explode("items").alias("item_id"), "contaminated", "coverage", "slot_share", "reparameterised")


def op2_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return toxicity.score(docs.select("doc_id", "text"), net, carry=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40, carry=["doc_id"])


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_lines.drop_site_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    out = chat.format_conversations(rows.unionByName(probe)).withColumn("formatted", chat.formatted())
    turns = chat.read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text()
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edits(table(spark, sf_dir, "documents"))


def op7_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(table(spark, sf_dir, "pages"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return pieces.groupBy("doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).withColumn("target", F.round("target", 6))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024, carry=["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), every=50, positives=5, negatives=3, low=50, high=95)


QUERIES = {f.__name__: f for f in (
    op1_template_decontamination, op2_toxicity_bigru, op3_byte_sharding, op4_site_line_dedup, op5_chat_format,
    op6_imatch_fingerprints, op7_html_template, op8_bbit_minhash, op9_mixing_tree, op10_suffix_dedup, op11_importance_resampling,
    op12_token_counts, op13_hard_negatives)}

_OP3 = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)) AS b
  FROM documents),
c AS (
  SELECT doc_id, size::BIGINT AS size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, tab),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32) AS rn FROM c),
s AS (SELECT *, least(39, ((2 * run - size) * 40) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

_OP4 = """
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS k FROM l WHERE trim(line) <> '' GROUP BY ALL),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
bad AS (SELECT f.source, f.line FROM f JOIN n ON f.source IS NOT DISTINCT FROM n.source WHERE k >= 3 AND k > 0.1 * n),
m AS (SELECT l.*, bad.line IS NOT NULL AS drop FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line) = bad.line),
g AS (SELECT doc_id, count(*) AS n_lines, sum(drop::INT)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '') AS kept FROM m GROUP BY ALL)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""

_OP5 = r"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('### : </turn>') + 1
    + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 6 + coalesce(2 * octet_length(encode(role)), 1) END
    + length(replace(replace(replace(text, '\', '\a'), '#', '\b'), '<', '\c')) AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') ELSE (before || '>' || role) IN ('system>user', 'user>assistant', 'assistant>user') END)
    AND bool_and(after IS NOT NULL OR role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""

_OP8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_OP9 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / w, rank)) FROM f WHERE cap >= w * level) * w, cap)) AS target FROM f),
p AS (SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(0, least(goal, start + size) - start) + greatest(0, least(goal, source_size + start + size) - source_size - start)
   + greatest(0, least(goal, 2 * source_size + start + size) - 2 * source_size - start))::BIGINT AS taken
FROM p
"""

_OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (
  SELECT true AS corpus, doc_id AS id, row_number() OVER () AS n, text FROM documents
  UNION ALL SELECT false, item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT corpus, id, n, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM src),
f AS (SELECT corpus, n, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), tab),
c AS (SELECT corpus, n, bucket FROM f JOIN b USING (feature)),
h AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM c GROUP BY bucket),
z AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM h),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (big_s + 10000))::DOUBLE / ((s + 1) * (big_t + 10000))::DOUBLE))::BIGINT AS gain FROM h, z),
m AS (SELECT n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE corpus GROUP BY n),
d AS (SELECT w.id AS doc_id, len(ws) AS n_words, len(ws) + greatest(len(ws) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(w.id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN m USING (n) WHERE corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS enough FROM d)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= enough * 25 // 100 THEN place END::BIGINT AS rank FROM r
"""

_OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_inner_product(a.q, b.q), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT n, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS nth
  FROM s WHERE same QUALIFY nth <= 5),
g AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.n, nth ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.n = p.n AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3
"""

ORACLE = {"op3_byte_sharding": _OP3, "op4_site_line_dedup": _OP4, "op5_chat_format": _OP5, "op8_bbit_minhash": _OP8, "op9_mixing_tree": _OP9,
          "op11_importance_resampling": _OP11, "op13_hard_negatives": _OP13}
