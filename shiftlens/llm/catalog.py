"""The registered queries of this package and, where SQL can express them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm.batches import saved
from shiftlens.llm.block_dedup import block_dedup
from shiftlens.llm.descent import nearest
from shiftlens.llm.gnat import hard_negatives, usable
from shiftlens.llm.merkle import document_manifest
from shiftlens.llm.quality_vote import score_quality
from shiftlens.llm.raking import mix
from shiftlens.llm.randomness import scan_secrets
from shiftlens.llm.signature_join import signature_join
from shiftlens.llm.site_template import extract_main_text
from shiftlens.llm.token_stream import read_tokens, write_tokens
from shiftlens.llm.url_words import judge_urls
from shiftlens.llm.warc_writer import read_warc, write_warc
from shiftlens.llm.winnowing import decontaminate
from shiftlens.plans.scratch import fresh_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_table(spark, folder, "pages"))


def op2_quality_vote(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(documents, _table(spark, folder, "labels"))
    return saved(scored.select("doc_id", "held_out", "score", "predicted"), "scores")


def op3_raking(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op4_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join(_table(spark, folder, "documents"))


def op5_url_words(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def op6_block_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return block_dedup(_table(spark, folder, "documents"), keep_text=False)


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"))


def op9_randomness(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(_table(spark, folder, "documents"))


def op10_warc_writer(spark: SparkSession, folder: str) -> DataFrame:
    archive = fresh_path(spark, "warc")
    write_warc(_table(spark, folder, "pages"), archive)
    return read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_bytes(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = fresh_path(spark, "tokens")
    write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, files, with_ids=False)


def op12_hyperplane_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = usable(_table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op13_path_copying(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    manifest = document_manifest(_table(spark, folder, "documents"), tampered, F.translate("text", "\n", ""))
    return manifest.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_quality_vote": op2_quality_vote,
    "op3_raking": op3_raking,
    "op4_signature_join": op4_signature_join,
    "op5_url_words": op5_url_words,
    "op6_block_dedup": op6_block_dedup,
    "op7_winnowing": op7_winnowing,
    "op8_nn_descent": op8_nn_descent,
    "op9_randomness": op9_randomness,
    "op10_warc_writer": op10_warc_writer,
    "op11_ranked_bytes": op11_ranked_bytes,
    "op12_hyperplane_tree": op12_hyperplane_tree,
    "op13_path_copying": op13_path_copying,
}

ORACLES: dict[str, str] = {
    "op3_raking": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CASE WHEN regexp_matches(text, '\\|[^|]+\\|[^|]+\\|') THEN 'listing' WHEN regexp_matches(text, '[*#$%&]{3}') THEN 'symbols'
         WHEN regexp_matches(text, '[A-Z]{2,}!!') THEN 'shouting' WHEN regexp_matches(text, '(?i:licen[cs]e|copyright)') THEN 'legal'
         WHEN regexp_matches(text, '[0-9]{6}') THEN 'figures' ELSE 'prose' END AS topic
  FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, sqrt(sum(tokens)) AS share FROM c GROUP BY ALL), l AS (SELECT lang, sqrt(sum(tokens)) AS share FROM c GROUP BY ALL),
t AS (SELECT topic, sqrt(sum(tokens)) AS share FROM c GROUP BY ALL),
ipf AS (
  SELECT 0 AS step, c.source, c.lang, c.topic, tokens, tokens AS weight, s.share / (SELECT sum(share) FROM s) AS ts,
         l.share / (SELECT sum(share) FROM l) AS tl, t.share / (SELECT sum(share) FROM t) AS tt
  FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens,
         CASE step % 3 WHEN 0 THEN weight * ts / sum(weight) OVER (PARTITION BY source) WHEN 1 THEN weight * tl / sum(weight) OVER (PARTITION BY lang)
              ELSE weight * tt / sum(weight) OVER (PARTITION BY topic) END, ts, tl, tt
  FROM ipf WHERE step < 36),
r AS (SELECT *, weight / tokens AS ratio FROM ipf WHERE step = 36 AND tokens > 0),
x AS (SELECT ratio, ((SELECT sum(tokens) FROM c) * 0.5 - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio DESC, tokens ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM r),
f AS (SELECT arg_max(scale, ratio) AS scale FROM x WHERE scale * ratio <= 1),
p AS (SELECT source, lang, topic, greatest(0, least(1, scale * ratio)) AS probability FROM r, f)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(probability, 0), 6) AS probability,
       CAST('0x' || substr(md5('3:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(probability, 0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
""",
    "op7_winnowing": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, l.n, array_to_string(w[p : p + l.n - 1], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT n FROM bw) AS l WHERE p + l.n - 1 <= len(w)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.run = bw.run AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op12_hyperplane_tree": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER best <= 3
""",
    "op13_path_copying": """
WITH RECURSIVE c AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, x: list_reduce(list_concat([xor(a, x)], [CAST(0 AS BIGINT) for i in range(8)]),
             lambda h, z: xor(h >> 1, CASE WHEN h % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS flipped
  FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND flipped % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS now, head FROM c),
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (
  SELECT 0 AS height, tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM p
  UNION ALL
  SELECT height + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 2) // 3
  FROM n WHERE size > 1 GROUP BY height, tree, pos // 3),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE size = 1),
m AS (
  SELECT 0 AS height, '*' AS tree, pos, subroot AS digest, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT height + 1, tree, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 2) // 3
  FROM m WHERE size > 1 GROUP BY height, tree, pos // 3),
w AS (
  SELECT height, tree, pos, coalesce(lag(digest, 2) OVER run, '') || coalesce(lag(digest) OVER run, '') AS lefts,
         coalesce(lead(digest) OVER run, '') || coalesce(lead(digest, 2) OVER run, '') AS rights
  FROM (FROM n WHERE size > 1 UNION ALL FROM m WHERE size > 1) AS x WINDOW run AS (PARTITION BY tree, height, pos // 3 ORDER BY pos)),
f AS (
  SELECT doc_id, leaf, now, p.tree, p.pos, p.tree AS part, 0 AS height, p.pos AS spot, now AS folded, '' AS proof, FALSE AS done FROM p
  UNION ALL
  SELECT doc_id, leaf, now, f.tree, f.pos, CASE WHEN w.pos IS NULL THEN '*' ELSE part END, CASE WHEN w.pos IS NULL THEN 0 ELSE f.height + 1 END,
         CASE WHEN w.pos IS NULL THEN s.pos ELSE spot // 3 END, CASE WHEN w.pos IS NULL THEN folded ELSE sha256(lefts || folded || rights) END,
         proof || coalesce(lefts || rights, ''), w.pos IS NULL AND part = '*'
  FROM f JOIN s ON s.tree = f.tree LEFT JOIN w ON w.tree = f.part AND w.height = f.height AND w.pos = f.spot WHERE NOT done)
SELECT doc_id, leaf, s.subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM f JOIN s USING (tree), (SELECT digest FROM m WHERE size = 1) AS r WHERE done
""",
}
