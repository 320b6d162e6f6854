"""Line dedup by overlapping three-line windows.

Windows run over the lines that hold a word; blank lines are skipped when windows
are formed and always stay. Every window but the globally first of its kind (least
doc_id, then position) covers its three lines, and covered lines go. Windows are
counted with map-side partial aggregation, so one passage in a third of all
documents costs one row a map task; only windows that do repeat are joined back.

Native: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import bind, staged, table

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _key() -> Column:
    """Stands for a row: doc_id, then a hash that orders different texts of one doc_id."""
    return F.struct(F.col("doc_id").alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"))


def windows(docs: DataFrame) -> DataFrame:
    """(key, at, h1, h2) of each window: `at` counts the lines with words, h1 and h2 are its hash."""
    full = bind(_lines(F.col("text")), lambda x: F.filter(x, _has_word))
    hashes = bind(
        full,
        lambda x: F.transform(
            F.when(F.size(x) >= LINES, F.sequence(F.lit(1), F.size(x) - (LINES - 1))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: bind(
                F.concat_ws("\n", *[F.element_at(x, i + k) for k in range(LINES)]),
                lambda w: F.struct(i.alias("at"), F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(7), w).alias("h2")),
            ),
        ),
    )
    return docs.select(_key().alias("key"), F.explode(hashes).alias("w")).select(
        "key", F.col("w.at").alias("at"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """(key, starts): where windows that repeat an earlier one start, for documents with any."""
    all_windows = windows(docs)
    first = staged(
        all_windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first"),
        "line-windows",
    )
    later = all_windows.join(first.hint("merge"), ["h1", "h2"]).where(F.struct("key", "at") > F.col("first"))
    return later.groupBy("key").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, `text` without its covered lines, plus n_lines, n_removed.

    Null text stays null with zero lines. Texts under three lines with words have no
    window and stay. Rows equal in doc_id and text are one document and get one
    result; other rows of one doc_id are ordered by a hash of the text; a null doc_id
    comes first. Windows inside one document count as well. Own columns of the names
    n_lines and n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the input's columns travel as one struct, so none can clash with ours
    gone = staged(covered_lines(docs), "line-removals")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _key().alias("own"))
    joined = keyed.join(gone.hint("merge"), F.col("own") == F.col("key"), "left")
    split = joined.select("row", "starts", F.col("row")["text"].alias("body")).withColumn("lines", _lines(F.col("body")))
    at_words = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _has_word(F.get("lines", i)))
    numbers = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(LINES)]))))
    removed = split.withColumn(
        "removed",
        F.when(
            F.col("starts").isNotNull(),
            bind(at_words, lambda a: F.transform(numbers, lambda k: F.element_at(a, k))),
        ),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(
        F.col("removed").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    ).otherwise(F.col("body"))
    return removed.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in names],
        F.when(F.col("body").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
