"""Taxon names, ranks, threshold units and small order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")

# What marks a name that stands for no known taxon.
PLACEHOLDER_STARTS = ("dummy", "unclassified", "unknown", "uncultured", "environmental", "unassigned", "none")
PLACEHOLDER_SP = r"[_ ][Ss]p(\b|_|[A-Z0-9])"
PLACEHOLDER_INCERTAE = r"(?i)incertae[_ ]sedis"


def is_placeholder(taxon: Column) -> Column:
    return (
        taxon.isNull()
        | taxon.rlike("(?i)^(" + "|".join(PLACEHOLDER_STARTS) + ")")
        | taxon.rlike(PLACEHOLDER_SP)
        | taxon.rlike(PLACEHOLDER_INCERTAE)
    )


def clean_taxonomy(taxonomy: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """Placeholder names become null in every rank column."""
    missing = {"seq_id", *ranks} - set(taxonomy.columns)
    if missing:
        raise ValueError(f"taxonomy has no columns {sorted(missing)}")
    return taxonomy.withColumns({r: F.when(~is_placeholder(F.col(r)), F.col(r)) for r in ranks})


def rank_place(rank: str, ranks: Sequence[str]) -> int:
    if rank not in ranks:
        raise ValueError(f"{rank!r} is no rank of {list(ranks)}")
    return list(ranks).index(rank)


def superranks(rank: str, ranks: Sequence[str] = RANKS) -> list[str]:
    """Ranks that include this one, most inclusive first."""
    return list(ranks[: rank_place(rank, ranks)])


def subranks(rank: str, ranks: Sequence[str] = RANKS) -> list[str]:
    """Ranks inside this one, most inclusive first."""
    return list(ranks[rank_place(rank, ranks) + 1 :])


def rank_order(rank: Column, ranks: Sequence[str] = RANKS) -> Column:
    """Ordinal of a rank name: the least inclusive rank is smallest, 1; null for other names."""
    at = F.array_position(F.array(*[F.lit(r) for r in reversed(ranks)]), rank)
    return F.when(at > 0, at).cast("int")


def threshold_as_dist(df: DataFrame, column: str) -> DataFrame:
    """One unit for the whole column, by its largest value: percent or share, similarity or distance.

    Above 50: percent similarity; above 1: percent distance; above 0.5: similarity.
    """
    most = df.agg(F.max(F.when(~F.isnan(column), F.col(column))).alias("_most"))  # one row
    t = F.col(column)
    unit = (
        F.when(F.col("_most") > 50, 1 - 0.01 * t)
        .when(F.col("_most") > 1, 0.01 * t)
        .when(F.col("_most") > 0.5, 1 - t)
        .otherwise(t)
    )
    return df.crossJoin(F.broadcast(most)).withColumn(column, unit).drop("_most")


def strict_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The lower middle of `value` in each group: an element, never a mean."""
    w = Window.partitionBy(*by)
    placed = df.where(F.col(value).isNotNull()).select(
        *by, value, F.row_number().over(w.orderBy(value)).alias("_at"), F.count(F.lit(1)).over(w).alias("_of")
    )
    return placed.where(F.col("_at") == F.ceil(F.col("_of") / 2)).drop("_at", "_of")


def make_seq_names(n: int, prefix: str) -> list[str]:
    """prefix and 1-based numbers, zero-padded to one width."""
    width = len(str(n))
    return [f"{prefix}{k:0{width}d}" for k in range(1, n + 1)]


def numbered_names(index: Column, count: Column, prefix: str) -> Column:
    """The same as a column: `index` from 0, `count` names in all."""
    return F.concat(F.lit(prefix), F.lpad((index + 1).cast("string"), F.length(count.cast("string")), F.lit("0")))


def pad_strings(seq: Column, width: int, letter: str = "X") -> Column:
    """Sequences padded on the right to one width."""
    return F.rpad(seq, width, letter)
