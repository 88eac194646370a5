"""Registered queries of the training-data operators (production parameters)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.llm import (bpe, divergence, importance, jaccard_join, langid, nn_descent, packing, quality, secret_scan,
                            sharding, substring_dedup, toxicity, url_cascade)
from orderpulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def fold(of: int, key: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.sample_text(docs.where(fold(3) != 1))
    return langid.identify(docs, samples).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query
def op4_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), 3, 90, 100)


@query
def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(table(spark, sf_dir, "documents"), 20)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Trained on the labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    return toxicity.fit(toxicity.labelled_sample(docs, labels))


@query
def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query
def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op10_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")


#: The rules of the url filter, and the words in a host's labels that put it on the list.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
HOST_WORDS = ["adult", "ads", "bets", "casino", "pills", "spam"]


@query
def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "key string, verdict string")
    host, _ = url_cascade.parts(F.col("url"))
    listed = pages.select(host.alias("key")).distinct().where(
        F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, HOST_WORDS))))
    return url_cascade.judge(pages, rules, listed)


@query
def op12_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1)


_LISTED = "|".join(HOST_WORDS)
ORACLE["op11_bloom_cascade"] = f"""
WITH cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1) AS h,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
low AS (SELECT page_id, translate(h, '{url_cascade.UPPER}', '{url_cascade.LOWER}') AS host, path FROM cut),
fit AS (
  SELECT *, CASE
    WHEN starts_with(path, '/en/') AND ends_with('.' || host, '.example.net') THEN 'example.net/en/'
    WHEN starts_with(path, '/de/') AND ends_with('.' || host, '.example.com') THEN 'example.com/de/'
    WHEN starts_with(path, '/fr/') AND ends_with('.' || host, '.org') THEN 'org/fr/'
    WHEN starts_with(path, '/') AND ends_with('.' || host, '.net') THEN 'net/' END AS rule
  FROM low)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.-])({_LISTED})([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM fit
"""
ORACLE["op12_count_bitmaps"] = f"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{url_cascade.UPPER}', '{url_cascade.LOWER}') AS text
  FROM documents),
word AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM word GROUP BY ALL HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce(u.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT w.lang, w.source, count(*) AS n FROM word w JOIN kept k USING (lang, term) GROUP BY ALL) u
    USING (lang, source)),
used AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM word w JOIN kept k USING (lang, term) GROUP BY ALL),
prob AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (g.n + 5 * g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (g.lang_n + 5 * g.v)::HUGEINT AS q
  FROM grp g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
             FROM prob x JOIN prob y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
             GROUP BY ALL) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
both_parts AS (
  SELECT * FROM pair UNION ALL
  SELECT lang, source, 'term', term, p - q FROM prob WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= 50
"""
