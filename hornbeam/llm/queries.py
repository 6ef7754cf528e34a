"""The queries of the corpus operators, and SQL where it can state the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import bpe, decontaminate, importance, langid, lm, media_ogg, mixing, simhash, substring, tokens, toxicity, urlfilter, vectorcodes
from hornbeam.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.digests(media_ogg.encode_texts(table(spark, sf_dir, "documents")))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


ORACLES["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath, n) AS (VALUES ('allow', 'org', '/', 0), ('block', 'example.org', '/es/', 1), ('block', 'example.org', '/en/1', 2), ('allow', 'com', '/fr/', 3), ('block', 'com', '/de/', 4)),
won AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, n) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM won
"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op2_mix_sources"] = mixing.SQL


@query
def op5_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train_on_folds(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train_on_folds(docs, labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontaminate"] = decontaminate.SQL


@query
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_folds(table(spark, sf_dir, "documents"))


@query
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find(table(spark, sf_dir, "documents"))


@query
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


ORACLES["op12_vector_codes"] = vectorcodes.SQL


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = importance.SQL
