"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Rows with null or empty texts are dropped by the
language stage (no letter); repeated rows count as copies, of which the
near-duplicate stage keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import jaccard_join, langid, packing, toxicity
from lapsewise.llm.common import fold, table
from lapsewise.session import scratch_path

#: A document whose toxicity reaches this goes; so does one whose language is less certain than that.
TOXIC_FROM, LANGUAGE_FROM = 0.5, 0.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not score as toxic. It learns from the labels of four folds of five."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"),
                         fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model, docs.columns, name="__toxic")
    return scored.where(F.col("__toxic") < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised."""
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    named = langid.identify(docs, model, docs.columns, ("__lang", "__sure"))
    return named.where((F.col("__lang") != "und") & (F.col("__sure") >= LANGUAGE_FROM)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; of its repeated rows one."""
    groups = jaccard_join.join_groups(docs)
    kept = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__kept")).distinct())
    return (docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
            .dropDuplicates(["doc_id", "text"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
