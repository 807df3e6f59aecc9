"""S-6 … S-10: fold files, feature names, importance table, models.

Folds are one Parquet dataset partitioned by ``fold`` (reading one fold prunes
the other's files); the feature list is a small ordered table; models use
Spark ML persistence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_folds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-6: the keyed feature frame with its ``fold`` column."""
    df.write.mode(mode).partitionBy("fold").parquet(path)


def read_fold(spark: SparkSession, path: str, fold: str | None = None) -> DataFrame:
    """S-7: one fold (partition-pruned) or both."""
    df = spark.read.parquet(path)
    return df.where(F.col("fold") == fold) if fold else df


def write_feature_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    spark.createDataFrame(list(enumerate(names)), "position int, feature string") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("position").collect()]


def write_table(df: DataFrame, path: str) -> None:
    """S-8 / S-9: importance ranking or scored-with-attribution table."""
    df.write.mode("overwrite").parquet(path)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """S-8: the importance ranking, best first (one row a feature)."""
    return spark.read.parquet(path).orderBy("rank")


def save_model(model: PipelineModel, path: str) -> None:
    """S-10."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
