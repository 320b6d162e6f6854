"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrove.storage import staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v) edges, each given once.

    The least neighbour of a node, itself included, is a partial aggregation, so a
    hub with a third of all links is no task of its own; the links are then joined
    to that least neighbour.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that each linked node reaches.

    `links` has two long columns u, v in any direction; self links and repeats are
    harmless. The least node of a component itself has no row. Alternating large-star
    and small-star steps end in stars, after about the logarithm of the longest path;
    every round is written to the shared folder, so a lost executor costs one round's
    tasks, and the round before is dropped.
    """
    now = staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        name,
    )

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    mark = signature(now)
    while mark[0]:
        after = staged(_star(_star(now, True), False), name, mark[0])
        unstage(now)
        now, before, mark = after, mark, signature(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
