"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from takeup.session import stage

__all__ = ["stage", "read_table", "row_key", "source_key", "bounded_batches", "WORD"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Two 64-bit hashes that identify a row by its id and its whole text.

    Rows with the same key have the same id and text, so whatever is derived
    from id and text holds for all of them; nulls have a key as well.
    """
    return [F.xxhash64(id_column).alias("_k1"), F.xxhash64(F.lit("text"), text_column).alias("_k2")]


def source_key(column: str) -> Column:
    """Join key of a nullable text column: never null, null apart from all texts."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound the Arrow batches that leave the JVM by their bytes, so that very long
    texts do not meet by the thousand in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
