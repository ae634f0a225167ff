"""The thin queries over the operators of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe_fst, editwalk, exact, packing, parityjoin, perplexity, pii, quality, sstable, substring, urlfilter, variants
from .shared import documents, settle

QUERIES: dict = {}
ORACLES: dict = {}

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _query(f):
    QUERIES[f.__name__] = f
    return f


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_query
def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(documents(spark, sf_dir))


@_query
def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.classify(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)


@_query
def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parityjoin.link_documents(documents(spark, sf_dir), parityjoin.Spec(words=3, percent=90))


@_query
def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(documents(spark, sf_dir))


@_query
def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.train(docs, labels(spark, sf_dir)))


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(documents(spark, sf_dir))


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(documents(spark, sf_dir))


@_query
def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editwalk.near_classes(settle(editwalk.fingerprint_documents(documents(spark, sf_dir)), "walk-prints"))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLES["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
