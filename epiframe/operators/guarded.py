"""User functions over rows, with an error channel.

A function takes a row as a dictionary and returns one, or raises ``Skip``: the row is then left out and listed with its
locator, reason and detail. Any other error ends the job and names the locator. Rows pass once; what came out and what
was skipped are written together in the shared folder, so that both agree, and are counted by the way.

Defined cases: a function that returns None skips the row as ``none``; fields that the result lacks are null, others
than those of the schema are dropped; null locators are listed as null; an empty table gives empty results and zero
counts; a retried task counts once, as counts are those of the job that wrote the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.files import shared_path

#: Rows that are Python objects at a time.
SLICE = 256


class Skip(Exception):
    """Leave this row out: a reason to count by, and what was found."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


class Guarded(NamedTuple):
    rows: DataFrame
    #: Locator, reason and detail of the rows left out.
    skipped: DataFrame
    #: Rows that came in, came out and were skipped.
    counts: dict[str, int]


def located(locator: Sequence[str], row: dict) -> str:
    return ", ".join(f"{c}={row.get(c)}" for c in locator)


def map_rows(df: DataFrame, f: Callable[[dict], dict | None], schema: str | T.StructType, locator: Sequence[str]) -> Guarded:
    """f over the rows of df; results have ``schema``, skipped rows the columns of ``locator``."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = T.StructType([df.schema[c] for c in locator])
    whole = T.StructType([T.StructField("_row", out), T.StructField("_at", kept), T.StructField("_reason", T.StringType()), T.StructField("_detail", T.StringType())])
    arrow, names = to_arrow_schema(whole), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                found = []
                for row in batch.slice(k, SLICE).to_pylist():
                    at = {c: row[c] for c in locator}
                    try:
                        result = f(dict(row))
                        if result is None:
                            raise Skip("none")
                        found.append({"_row": {c: result.get(c) for c in names}, "_at": None, "_reason": None, "_detail": None})
                    except Skip as e:
                        found.append({"_row": None, "_at": at, "_reason": e.reason, "_detail": e.detail})
                    except Exception as e:
                        raise RuntimeError(f"data error on {located(locator, row)}") from e
                yield pa.RecordBatch.from_pylist(found, arrow)

    seen, path = Observation("guarded"), shared_path(df.sparkSession, "guarded")
    skipped = F.count_if(F.col("_reason").isNotNull())
    df.mapInArrow(run, whole).observe(seen, F.count(F.lit(1)).alias("rows_in"), (F.count(F.lit(1)) - skipped).alias("rows_out"), skipped.alias("skipped")).write.parquet(path)
    table = df.sparkSession.read.schema(whole).parquet(path)
    return Guarded(table.where("_reason IS NULL").select("_row.*"), table.where("_reason IS NOT NULL").select("_at.*", F.col("_reason").alias("reason"), F.col("_detail").alias("detail")), dict(seen.get))


def by_reason(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def collect_dropped(handler: Callable[[DataFrame, int], None], log: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch whose failures are logged and don't end the stream: the recorder's batch is lost, the
    stream goes on."""

    def run(df: DataFrame, batch: int) -> None:
        try:
            handler(df, batch)
        except Exception as e:  # the stream must survive any failure of the recorder
            log(f"batch {batch} dropped: {e}")

    return run
