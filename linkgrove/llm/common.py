"""Shared plumbing of the training-data operators: tables, stage files, key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.storage import few_files, free_shuffles, maybe_broadcast, new_path, passing, shared_dir, staged, unstage

#: ASCII white space, 0x09-0x0D and 0x20; words are runs of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once, even when `use` names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def crc32(col: Column) -> Column:
    return F.crc32(col.cast("binary"))


__all__ = [
    "LOWER", "SPACE_CLASS", "UPPER", "bind", "crc32", "few_files", "free_shuffles", "maybe_broadcast", "new_path", "passing",
    "shared_dir", "staged", "table", "unstage", "words",
]
