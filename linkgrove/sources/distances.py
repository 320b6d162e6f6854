"""Sparse distance relations from text files, tables and streams.

A line holds two ids and a distance, parted by any white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.config import FileDistance


def _fields(value: Column) -> list[Column]:
    parts = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    return [F.get(parts, k) for k in range(3)]


def parse_lines(lines: DataFrame, by_name: bool = False) -> DataFrame:
    """(id1, id2, dist) of text lines; blank lines are skipped, ids are 0-based numbers or names."""
    a, b, d = _fields(F.col("value"))
    kind = "string" if by_name else "long"
    return lines.where(F.length(F.trim("value")) > 0).select(a.cast(kind).alias("id1"), b.cast(kind).alias("id2"), d.cast("double").alias("dist"))


def read_distances(spark: SparkSession, path: str, by_name: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), by_name)


def stream_distances(spark: SparkSession, folder: str, by_name: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """The same over files as they arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(folder)
    return parse_lines(lines, by_name)


def check_relation(df: DataFrame, by_name: bool) -> DataFrame:
    """A table as a relation: three columns, ids of one kind, then a number."""
    if len(df.columns) != 3:
        raise ValueError(f"a distance table has 3 columns, not {len(df.columns)}")
    a, b, d = df.columns
    kinds = dict(df.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    if by_name and (kinds[a], kinds[b]) != ("string", "string") or not by_name and not {kinds[a], kinds[b]} <= whole:
        raise ValueError(f"ids have types {kinds[a]}, {kinds[b]}")
    kind = "string" if by_name else "long"
    return df.select(F.col(a).cast(kind).alias("id1"), F.col(b).cast(kind).alias("id2"), F.col(d).cast("double").alias("dist"))


def by_index(named: DataFrame, seqs: DataFrame) -> DataFrame:
    """Names to places; rows with a name that the set doesn't hold are left out."""
    a = seqs.select(F.col("seq_id").alias("id1"), F.col("seq_idx").alias("_1"))
    b = seqs.select(F.col("seq_id").alias("id2"), F.col("seq_idx").alias("_2"))
    return named.join(a, "id1").join(b, "id2").select(F.col("_1").alias("id1"), F.col("_2").alias("id2"), "dist")


def load(spark: SparkSession, config: FileDistance, seqs: DataFrame) -> DataFrame:
    """A configured file as (id1, id2, dist) over the places of a sequence set."""
    rows = read_distances(spark, config.filename, config.by_name)
    if config.by_name:
        return by_index(rows, seqs)
    places = seqs.select(F.col("seq_idx").alias("id1"))
    return rows.join(places, "id1", "left_semi").join(places.withColumnRenamed("id1", "id2"), "id2", "left_semi").select(
        "id1", "id2", "dist"
    )


def file_pairs(spark: SparkSession, config: FileDistance, seqs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the set within a threshold, (seq_idx1, seq_idx2, dist2), the lower place first."""
    rows = load(spark, config, seqs).where(f"id1 <> id2 AND dist <= {threshold!r}")
    return rows.select(F.least("id1", "id2").alias("seq_idx1"), F.greatest("id1", "id2").alias("seq_idx2"), F.col("dist").alias("dist2"))


def file_hits(spark: SparkSession, config: FileDistance, query: DataFrame, ref: DataFrame) -> DataFrame:
    """(seq_id, ref_id, dist) of a file's rows between two named sets, in either direction."""
    rows = read_distances(spark, config.filename, True)
    q, r = query.select("seq_id").distinct(), ref.select(F.col("seq_id").alias("ref_id")).distinct()
    both = rows.select(F.col("id1").alias("seq_id"), F.col("id2").alias("ref_id"), "dist").unionByName(
        rows.select(F.col("id2").alias("seq_id"), F.col("id1").alias("ref_id"), "dist")
    )
    return both.join(q, "seq_id", "left_semi").join(r, "ref_id", "left_semi").select("seq_id", "ref_id", "dist").distinct()
