"""Sequence sets: FASTA and FASTQ readers and writers, in-memory sources, selection.

A sequence set is a DataFrame (seq_id string, seq string), with seq_idx, the 0-based
place in the input, where order matters: cluster labels are least places.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgrove.storage import maybe_broadcast, staged

# File names of both formats, and column names in order of preference.
FASTA = re.compile(r"\.(fas?|fasta)(\.gz)?$", re.I)
FASTQ = re.compile(r"\.f(ast)?q(\.gz)?$", re.I)
NAME_COLUMNS = ("seq_id", "name", "ASV", "OTU")
SEQ_COLUMNS = ("seq", "sequence")


def find_name_column(columns: Sequence[str]) -> str:
    """The id column: a known name, or what the sequence column leaves of two."""
    for c in NAME_COLUMNS:
        if c in columns:
            return c
    rest = [c for c in columns if c not in SEQ_COLUMNS]
    if len(columns) == 2 and len(rest) == 1:
        return rest[0]
    raise ValueError(f"no id column among {list(columns)}")


def find_seq_column(columns: Sequence[str]) -> str:
    """The sequence column: a known name, or what the id column leaves of two."""
    for c in SEQ_COLUMNS:
        if c in columns:
            return c
    rest = [c for c in columns if c not in NAME_COLUMNS]
    if len(columns) == 2 and len(rest) == 1:
        return rest[0]
    raise ValueError(f"no sequence column among {list(columns)}")


def with_index(df: DataFrame, order_by: Sequence[str], name: str = "seq_idx") -> DataFrame:
    """Number rows from 0 in the order of these columns, with no task that holds all rows.

    Rows are range-partitioned and written; each partition numbers its own rows after
    the counts of the partitions before.
    """
    placed = staged(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_part", F.spark_partition_id()), "indexed"
    )
    counts = placed.groupBy("_part").count()
    # one row a partition
    starts = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by)) - 1
    return placed.withColumn("_at", at).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop(
        "_part", "_start", "_at"
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq, description) of FASTA files; seq_id is the header up to white space.

    Records are split on lines that start with '>', so sequences may span lines;
    gzipped files are read whole by one task each.
    """
    records = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace(F.col("value"), r"^\s*>", "")
    header = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", "")
    return records.select(F.split(header, r"\s+")[0].alias("seq_id"), seq.alias("seq"), header.alias("description"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq, quality, description) of FASTQ files with four lines a record.

    Files are read in byte splits, so their size has no bound: a line's number is its
    place in its split after the lines of the splits before, and four lines in a row are
    a record, whatever they begin with. A record that lacks its '@' or '+' line, such as
    blank lines at the end, is left out.
    """
    lines = staged(
        spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "fastq-lines",
    )
    splits = lines.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "fastq-splits")
    number = F.col("_at") - F.col("_first") + F.col("_before")
    placed = lines.join(maybe_broadcast(starts, starts.count()), ["_file", "_split"]).select(
        "_file", F.floor(number / 4).alias("_record"), (number % 4).alias("_line"), F.rtrim("value").alias("value")
    )
    line = lambda k: F.max(F.when(F.col("_line") == k, F.col("value")))
    records = placed.groupBy("_file", "_record").agg(*[line(k).alias(c) for k, c in enumerate(("_head", "seq", "_plus", "quality"))])
    whole = records.where(F.col("_head").startswith("@") & F.col("_plus").startswith("+") & F.col("quality").isNotNull())
    head = F.substring("_head", 2, 1 << 30)
    return whole.select(F.split(head, r"\s+")[0].alias("seq_id"), "seq", "quality", head.alias("description"))


def fastq_names(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id) of FASTQ records."""
    return read_fastq(spark, path).select("seq_id")


def read_sequences(spark: SparkSession, source, seq_col: str | None = None, name_col: str | None = None) -> DataFrame:
    """A sequence set from a path, a mapping of ids, a list of pairs, or a DataFrame."""
    if isinstance(source, str):
        if FASTA.search(source):
            return read_fasta(spark, source).select("seq_id", "seq")
        if FASTQ.search(source):
            return read_fastq(spark, source).select("seq_id", "seq")
        raise ValueError(f"{source!r} has no FASTA or FASTQ name")
    if isinstance(source, DataFrame):
        name, seq = name_col or find_name_column(source.columns), seq_col or find_seq_column(source.columns)
        return source.select(F.col(name).cast("string").alias("seq_id"), F.col(seq).cast("string").alias("seq"), *(
            ["seq_idx"] if "seq_idx" in source.columns else []
        ))
    rows = list(source.items()) if isinstance(source, Mapping) else [tuple(r) for r in source]
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(rows)], "seq_idx long, seq_id string, seq string")


def indexed(seqs: DataFrame) -> DataFrame:
    """The set with seq_idx; without one, ids are numbered in byte order."""
    return seqs if "seq_idx" in seqs.columns else with_index(seqs, ["seq_id"])


def check_ids(seqs: DataFrame) -> None:
    """Raise unless ids are present and unique."""
    bad = seqs.groupBy("seq_id").count().where("seq_id IS NULL OR count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"sequence id {bad[0]['seq_id']!r} is missing or repeated")


def write_fasta(seqs: DataFrame, path: str, compress: bool = False) -> str:
    """Write a set as FASTA part files; the path is given back."""
    out = seqs.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), F.col("seq")).alias("value"))
    out.write.mode("overwrite").text(path, compression="gzip" if compress else "none")
    return path


def write_fastq(seqs: DataFrame, path: str, compress: bool = False) -> str:
    record = F.concat(F.lit("@"), F.col("seq_id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality"))
    seqs.select(record.alias("value")).write.mode("overwrite").text(path, compression="gzip" if compress else "none")
    return path


def select_sequences(seqs: DataFrame, which, negate: bool = False) -> DataFrame:
    """Rows by id DataFrame (seq_id), list of ids, list of 0-based places, boolean Column; or all others."""
    if isinstance(which, Column):
        return seqs.where(~F.coalesce(which, F.lit(False)) if negate else which)
    if isinstance(which, DataFrame):
        return seqs.join(which.select("seq_id").distinct(), "seq_id", "left_anti" if negate else "left_semi")
    values = list(which)
    column = "seq_idx" if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values) else "seq_id"
    chosen = F.col(column).isin(values)
    return seqs.where(~chosen if negate else chosen)


def sequence_size(seqs: DataFrame) -> int:
    return seqs.count()


def seq_names(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id")


def rename_sequences(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """Replace ids by those of `names` (seq_idx, seq_id)."""
    return seqs.drop("seq_id").join(names, "seq_idx")


def check_members(members: DataFrame, seqs: DataFrame, column: str = "seq_id") -> None:
    """Raise if a subset names what the set doesn't hold."""
    missing = members.select(column).join(seqs.select(column), column, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"{missing[0][0]!r} is not in the sequence set")


def memberships(spark: SparkSession, seqs: DataFrame, which) -> DataFrame:
    """(subset, obj) of a list of subsets, each a list of ids or places; or of one True, all rows."""
    if which is True:
        return seqs.select(F.lit(0).cast("long").alias("subset"), F.col("seq_idx").alias("obj"))
    rows = [(k, str(v)) for k, own in enumerate(which) for v in own]
    by_place = all(isinstance(v, int) for own in which for v in own)
    wanted = spark.createDataFrame(rows, "subset long, key string")
    key = F.col("seq_idx").cast("string") if by_place else F.col("seq_id")
    keyed = seqs.select(key.alias("key"), F.col("seq_idx").alias("obj"))
    check_members(wanted, keyed, "key")
    return wanted.join(keyed, "key").select("subset", "obj").distinct()
