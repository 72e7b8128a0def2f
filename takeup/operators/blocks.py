"""Wide numeric rows as matrices inside tasks.

Spark scans, filters, partitions and shuffles; a task sees its rows as Arrow batches, each turned into one
matrix (rows x columns, NaN where a cell is null, NaN or infinite). Plans stay small however many columns there are:
the columns are one array expression, and fitted numbers are data, not SQL text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from takeup.functions.rowwise import values_of

#: bytes of an Arrow batch
BATCH_BYTES = 16 << 20


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x ``width`` doubles from an array column without null rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
    return np.where(np.isfinite(flat), flat, np.nan)


def with_matrix(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "_x") -> DataFrame:
    """The columns as one array column beside those to keep."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.selectExpr(*[f"`{c}`" for c in keep], f"{values_of(cols)} as {name}")


def int_matrix(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Add small whole-number columns as one array column; null becomes -1."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in cols]))


def map_matrix(df: DataFrame, cols: Sequence[str], keep: Sequence[str], out: Sequence[str],
               change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keep`` and one double column per name in ``out``, the columns of ``change(matrix)``; NaN becomes null."""
    width = len(cols)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.ascontiguousarray(change(matrix(batch.column(len(keep)), width)).T)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(keep))], *[pa.array(v, mask=np.isnan(v)) for v in made]],
                names=[*keep, *out])

    return with_matrix(df, cols, keep).mapInArrow(run, ", ".join([*kinds, *[f"`{c}` double" for c in out]]))
