"""Subsets and true partitions of a taxonomy: one for each pair of ranks and each taxon of the upper one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.functions.taxa import RANKS, rank_order


def rank_pairs(taxonomy: DataFrame, ranks: Sequence[str] = RANKS, id_col: str = "seq_id", keep: Sequence[str] = ()) -> DataFrame:
    """(superrank, rank, supertaxon, taxon, seq_id, keep…): a row for each pair of ranks known for a sequence."""
    pairs = [(a, b) for i, a in enumerate(ranks) for b in ranks[i + 1 :]]
    rows = F.array(*[
        F.struct(F.lit(a).alias("superrank"), F.lit(b).alias("rank"), F.col(a).alias("supertaxon"), F.col(b).alias("taxon"))
        for a, b in pairs
    ])
    own = taxonomy.select(F.col(id_col).alias("seq_id"), *keep, F.inline(rows))
    return own.where("supertaxon IS NOT NULL AND taxon IS NOT NULL")


def true_partitions(pairs: DataFrame) -> DataFrame:
    """Add c, the 0-based number of the taxon inside its supertaxon, by byte order.

    Distinct taxa are numbered, not sequences, so a supertaxon with very many
    sequences costs as much as its taxa.
    """
    keys = ["superrank", "rank", "supertaxon"]
    taxa = pairs.select(*keys, "taxon").distinct()
    numbered = taxa.withColumn("c", F.row_number().over(Window.partitionBy(*keys).orderBy("taxon")) - 1)
    return pairs.join(numbered, [*keys, "taxon"])


def summarize_by_rank(taxonomy: DataFrame, ranks: Sequence[str] = RANKS, id_col: str = "seq_id", order_by: str | None = None) -> DataFrame:
    """(supertaxon, superrank, rank, n_taxa, n_seq, seq_id, true_partition), lists in the order of `order_by` or of the ids."""
    keep = [order_by] if order_by and order_by != id_col else []
    found = true_partitions(rank_pairs(taxonomy, ranks, id_col, keep))
    place = F.col(order_by) if keep else F.col("seq_id")
    members = F.sort_array(F.collect_list(F.struct(place.alias("o"), F.col("seq_id").alias("s"), F.col("c").alias("c"))))
    return found.groupBy("supertaxon", "superrank", "rank").agg(
        F.countDistinct("taxon").cast("int").alias("n_taxa"),
        F.count(F.lit(1)).cast("int").alias("n_seq"),
        F.transform(members, lambda m: m["s"]).alias("seq_id"),
        F.transform(members, lambda m: m["c"]).alias("true_partition"),
    )


def rank_sorted(df: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """Rows by superrank, rank (most inclusive first) and supertaxon."""
    return df.orderBy(rank_order(F.col("superrank"), ranks).desc(), rank_order(F.col("rank"), ranks).desc(), "supertaxon")
