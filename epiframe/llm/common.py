"""Shared folder, binary files in it, and joins that broadcast only a side of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was written out and counted at no more rows than this.
BROADCAST_ROWS = 400_000
#: A key is hot if it has more than this part of a table's rows; so fewer keys than this number are.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="epiframe-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_side(df: DataFrame, weight: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df (materialized, so that counting is cheap) has few rows, and few items by weight if rows
    hold arrays; else df, for a shuffled join."""
    n, items = df.agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and items <= 4 * rows else df


def spread_join(df: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """df joined with side, which has one row to a key (never null) and in column n how many of df's ``total`` rows have it.

    Rows of hot keys stay where they are and meet their fewer than ``HOT_KEYS`` side rows by broadcast, so that no
    task gets all rows of such a key; the rest join by shuffle.
    """
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    few = F.broadcast(side.where(hot))
    cold = df.join(F.broadcast(side.where(hot).select(key)), key, "left_anti").join(side.where(~hot), key)
    return df.join(few, key).unionByName(cold).drop(n)


def own_name(taken: Iterable[str], name: str) -> str:
    """A name for a working column that clashes with none of the caller's, whatever their case."""
    low = {c.lower() for c in taken}
    while (name := f"_{name}").lower() in low:
        pass
    return name


def open_out(uri: str):
    """A binary output stream on any file system that pyarrow knows; parent folders are made."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(uri))
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A seekable binary input file on any file system that pyarrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_uri(uri))
    return system.open_input_file(path)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of a text column each, a longer text being a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _uri(uri: str) -> str:
    """Hadoop writes file:/a, pyarrow reads file:///a."""
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
