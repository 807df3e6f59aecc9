"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import (alignment, byte_bpe, decontaminate, fingerprints, jaccard_join, langid, packing,
                           ppm, prefix_trie, quality, token_store, toxicity, url_filter)
from lapsewise.llm.common import fold, table
from lapsewise.session import scratch_path

# Fixed values of the URL query: the five rules, and two listed hosts.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))
URL_LISTED = ("cheap-pills.example.com/", "spam-farm.example.org/")
#: Two words in capitals with exclamation marks: the address of such a page is listed.
SHOUTING = "[A-Z]{2,}!! [A-Z]{2,}!!"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN, ["doc_id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out)
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), ~held_out)
    out = langid.identify(table(spark, sf_dir, "documents", "doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    out = ppm.score(table(spark, sf_dir, "documents", "doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    token_store.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"),
                             public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_store.digests(spark, out)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(
        [(h, p, v, 1) for h, p, v in URL_RULES]
        + [(x[: x.index("/")], x[x.index("/"):], "block", 0) for x in URL_LISTED],
        "host string, prefix string, verdict string, rank int")
    host, path = url_filter.split_url(F.col("url"))
    addresses = (table(spark, sf_dir, "pages", "url", "html").where(F.col("html").rlike(SHOUTING))
                 .select(host.alias("host"), path.alias("path"), F.lit("block").alias("verdict"),
                         F.lit(0).alias("rank")))
    out = url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), listed, addresses)
    return out.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("entry")).alias("rule"),
                      "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.drop("rejected_by", "rules_tried")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"),
                           public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.nodes(prefix_trie.rebuilt(turns))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_lm_scores": op6_lm_scores,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontamination": op11_decontamination,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}
