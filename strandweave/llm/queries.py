"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import ann, bpe, decision_list, empirical_bayes, langid, line_dedup, merkle, mixing, simhash, token_counts
from strandweave.runtime import cut, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=4)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = empirical_bayes.fit(docs, table(spark, sf_dir, "labels"))
    return empirical_bayes.classify(docs, evidence, "doc_id", "text", F.col("source"), F.col("lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.held_in(docs))
    return langid.identify(docs, model)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.apply_rules(docs, rules)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.count_tokens(table(spark, sf_dir, "documents"), bpe.load(spark, RANKS), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def _damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults: some payloads end in another byte, some are cut to half, some records are gone."""
    fault = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    html = F.coalesce("html", F.lit(""))
    flipped = F.concat(F.expr("substring(coalesce(html, ''), 1, greatest(char_length(coalesce(html, '')) - 1, 0))"), F.lit("~"))
    halved = F.expr("substring(coalesce(html, ''), 1, char_length(coalesce(html, '')) div 2)")
    return pages.where((fault != "02") | fault.isNull()).withColumn("html", F.when(fault == "00", flipped).when(fault == "01", halved).otherwise(html))


def _damaged_index(leaf: DataFrame) -> DataFrame:
    """The replica's stored offsets: those of the original, some of them off by a byte."""
    fault = F.substring(F.md5(F.col("slot").cast("string").cast("binary")), 1, 2)
    return leaf.select("slot", (F.col("first") + F.when(fault == "03", 1).otherwise(0)).alias("first"), "last")


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours = cut(merkle.leaves(merkle.records(pages)))
    theirs = cut(merkle.leaves(merkle.records(_damaged(pages)), _damaged_index(ours)))
    found = merkle.audit_leaves(ours, theirs)
    return found.select(F.col("slot").alias("page_id"), "archive", F.col("first").alias("first_byte"), F.col("last").alias("end_byte"), "status")


_OP6 = r"""
WITH r AS (
  SELECT page_id, page_id // 1000 AS archive, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS fault, coalesce(html, '') AS html,
    strlen('WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:record:') + strlen(CAST(page_id AS VARCHAR)) + strlen('>..WARC-Target-URI: ')
      + strlen(coalesce(url, '')) + strlen('..Content-Length: ') + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS size
  FROM pages),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_byte FROM r)
SELECT page_id, CAST(archive AS BIGINT) AS archive, CAST(end_byte - size AS BIGINT) AS first_byte, end_byte,
  CASE fault WHEN '02' THEN 'missing' WHEN '03' THEN 'moved' ELSE 'changed' END AS status
FROM o
WHERE fault IN ('02', '03') OR fault = '00' AND right(html, 1) != '~' OR fault = '01' AND length(html) > 0
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) != ''),
windows AS (
  SELECT doc_id, j, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
later AS (
  SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, j) AS k FROM windows WHERE l3 IS NOT NULL) WHERE k > 1),
gone AS (
  SELECT DISTINCT w.doc_id, w.i FROM worded w JOIN (SELECT doc_id, j + unnest([0, 1, 2]) AS j FROM later) g USING (doc_id, j)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), bpe.load(spark, RANKS), public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x != '')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / weight AS level, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS asked FROM w),
f AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM l WINDOW o AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max((asked - filled) / weight_left) OVER () * weight) AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann": op8_ann,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
}
ORACLE = {"op6_merkle_fixity": _OP6, "op7_line_dedup": _OP7, "op10_mixing": _OP10}
