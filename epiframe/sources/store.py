"""Normalizer parameters with their coverage, metrics and predictions, kept as Parquet and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NORM_PARAMS

VERSION = 1


def save_parameters(params: DataFrame, path: str, coverage: DataFrame | None = None) -> None:
    """Parameters, one row to a key and dimension, and beside them the shards and rows that they were fitted on."""
    params.select(*NORM_PARAMS.names).coalesce(1).write.parquet(f"{path}/parameters")
    if coverage is not None:
        coverage.withColumn("schema_version", F.lit(VERSION)).coalesce(1).write.json(f"{path}/coverage")


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NORM_PARAMS).parquet(f"{path}/parameters")


def load_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The coverage beside parameters; another version of it is an error."""
    found = spark.read.json(f"{path}/coverage")
    return found.withColumn("schema_version", F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown version of coverage")).cast("long")))


def save_metrics(document: DataFrame, path: str) -> None:
    """One nested row as JSON."""
    document.coalesce(1).write.json(path)


def save_predictions(pred: DataFrame, path: str) -> None:
    """Long rows (sample_id, step, dim, gt, pred, valid), nearby samples together."""
    pred.select("sample_id", "step", "dim", "gt", "pred", "valid").write.parquet(path)
