"""From documents to packed token files in five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialize, shared_path, small_side
from epiframe.llm.decontaminate import mark_contaminated
from epiframe.llm.mixing import mix
from epiframe.llm.quality import judge_quality
from epiframe.llm.simhash import with_component, with_fingerprint
from epiframe.llm.tokens import tokenize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language's reference let pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id, once if its row repeats. Of a group
    without any id one row stays for each fingerprint."""
    prints = materialize(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "prints")
    found = with_component(prints)
    keep = F.col("doc_id") == F.col("component_id")
    # rows to drop, and ids of which only one row may stay; both are empty or small against the documents
    drop = materialize(found.where(~F.coalesce(keep, F.lit(False)) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    repeated = materialize(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "repeated")
    df = docs.select(*COLUMNS).join(small_side(drop), F.col("doc_id") == F.col("_id"), "left_anti")
    if repeated.isEmpty():
        return df
    once = df.join(small_side(repeated), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    once = _lone(with_fingerprint(once), found).dropDuplicates(["doc_id", "fp"])
    some = once.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(once.where("doc_id is null"))
    rest = df.join(small_side(repeated), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return rest.select(*COLUMNS).unionByName(some.select(*COLUMNS))


def _lone(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(doc_id, fp) without those of a null id whose group has an id."""
    taken = materialize(found.where("doc_id is null and component_id is not null").select(F.col("fp").alias("_fp")).distinct(), "taken")
    return rows.join(small_side(taken), F.col("doc_id").isNull() & (F.col("fp") == F.col("_fp")), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_contaminated(docs.select(*COLUMNS), benchmark).where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens follow the raked weights of sources, languages and topics."""
    return mix(docs.select(*COLUMNS)).where("sampled").select(*COLUMNS)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back: per document its place, number of ids and checksum."""
    return tokenize(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("token binary", token_binary)]
#: Near-duplicate components and tokenization can't be put in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
