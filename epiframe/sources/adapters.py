"""The driver's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blend import with_next

LINE_DIMENSIONS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: A total order of the lines of an order: order and line number alone are not unique.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("dataset_name"), F.col("user_id").alias("episode_index"), "ts", "event_id", "event_type", F.col("value").alias("payload"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("high_quality"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and the next one of its label."""
    return with_next(vectors(spark, sf_dir), "label", "vec_id", "v").where("nxt IS NOT NULL")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, their lines as steps: the price, and the catalogue's price for the quantity."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    return joined.select(F.col("l_orderkey").alias("sample_id"), step.alias("step"), F.lit(0).alias("dim"), (F.col("l_extendedprice") * 1e-5).alias("gt"), (F.col("p_retailprice") * F.col("l_quantity") * 1e-5).alias("pred"), (F.col("l_returnflag") != "R").alias("valid"))


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that an assistant's turn follows, with three ratings."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"reply": F.lead("text").over(w), "by": F.lead("role").over(w)}).where("role = 'user' AND by = 'assistant'")
    long = F.char_length("text")
    return c.select("conv_id", "turn", "text", "reply", F.when(long % 11 != 0, long % 6).alias("formatting"), (F.char_length("reply") % 6).alias("visual"), (F.col("turn") % 6).cast("int").alias("relevance"))
