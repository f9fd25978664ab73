"""Batches of a fixed number of rows with ragged arrays padded to the batch's longest, and masks.

Rows are numbered by ranges of their order (``blend.number_rows``); a row's batch is its number over the batch size,
and only a batch's rows ever meet in one group. Everything runs as DataFrame functions.

Defined cases: the last batch may be short, or is left out with ``drop_last``; a null array is one of no values; a
batch whose arrays are all empty has width 0 and empty masks; ``width`` fixes a column's width, and a longer array is
then an error; rows that tie in order may stand in any order among themselves; an empty table gives no batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blend import number_rows


def _padded(rows: Column, name: str, fill: Column, width: int | None, kind: str) -> tuple[Column, Column, Column]:
    """Values, masks and lengths of a ragged column over a batch's rows."""
    values = lambda r: F.coalesce(r[name], F.array().cast(kind))
    sizes = F.transform(rows, lambda r: F.size(values(r)))
    most = F.array_max(sizes)
    if width is not None:
        most = F.when(most > width, F.raise_error(F.lit(f"{name} is longer than {width}")).cast("int")).otherwise(F.lit(width))
    padded = F.transform(rows, lambda r: F.concat(values(r), F.array_repeat(fill, most - F.size(values(r)))))
    masks = F.transform(sizes, lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), most - n)))
    return padded, masks, sizes


def collate(df: DataFrame, order: Sequence[str], size: int, ragged: Mapping[str, Column], stacked: Sequence[str] = (), width: Mapping[str, int] | None = None, drop_last: bool = False) -> DataFrame:
    """(batch, n, columns..): ``stacked`` columns as arrays, ``ragged`` ones (with their fill) as equally long arrays with
    ``<name>_mask`` and ``<name>_length``."""
    if size < 1:
        raise ValueError(f"a batch needs at least one row: {size}")
    columns = [*stacked, *ragged]
    numbered = number_rows(df.select(*dict.fromkeys([*order, *columns])), order, "_n")
    slot = F.struct((F.col("_n") % size).alias("slot"), *(F.col(c).alias(c) for c in columns))
    rows = numbered.groupBy(F.floor(F.col("_n") / size).alias("batch")).agg(F.array_sort(F.collect_list(slot), lambda a, b: (a["slot"] - b["slot"]).cast("int")).alias("_rows"))
    rows = rows.withColumn("n", F.size("_rows"))
    if drop_last:
        rows = rows.where(F.col("n") == size)
    field = lambda c: F.transform("_rows", lambda r: r[c])
    out = {c: field(c) for c in stacked}
    for c, fill in ragged.items():
        out[c], out[f"{c}_mask"], out[f"{c}_length"] = _padded(F.col("_rows"), c, fill, (width or {}).get(c), df.schema[c].dataType.simpleString())
    return rows.select("batch", "n", *(x.alias(c) for c, x in out.items()))
