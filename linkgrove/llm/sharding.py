"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random draw; the shard with the best weighted
draw owns the record. Another shard only takes rows into itself, and a changed
weight only moves rows to or from that shard. All expressions are built in; the
texts stay out of the shuffle, which carries four short columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgrove.llm.common import crc32, staged, table

#: Largest prime below 2**28: products of two residues stay within 64 bits.
PRIME = 268435399
SHARDS = 40
#: Rows of one slot-numbering group; groups, and so tasks, follow the row count.
ROWS_A_GROUP = 8192


def shard_constants(shard: int) -> tuple[int, int, int, int]:
    """Four fixed multipliers of a shard, from its number alone."""
    digest = hashlib.md5(f"shard:{shard}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 7], 16) % (PRIME - 1) + 1 for k in range(4))


def key_halves(key: Column) -> tuple[Column, Column]:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 9))


def draw(h1: Column, h2: Column, consts: Column) -> Column:
    """Residue in [0, PRIME) of this key for the shard with these constants."""
    line = (h1 * consts["a"] + h2 * consts["b"] + consts["c"]) % F.lit(PRIME)
    return (line * line + h2 * consts["d"]) % F.lit(PRIME)


def _constants(shard: int, weight: float = 1.0) -> Column:
    values = [F.lit(x).cast("long").alias(n) for n, x in zip("abcd", shard_constants(shard), strict=True)]
    return F.struct(*values, F.lit(shard).alias("shard"), F.lit(float(weight)).alias("weight"))


def weighted_choice(h1: Column, h2: Column, weights: Sequence[float]) -> Column:
    """Struct (cost, shard) of the owner: least -ln(u)/weight, ties to the lower shard.

    Equal weights keep the draw itself as cost: same order, integers only. The
    shards are one constant array, so the plan's code doesn't grow with them.
    """
    equal = len(set(weights)) == 1

    def option(s: Column) -> Column:
        d = draw(h1, h2, s)
        cost = -d.cast("double") if equal else -F.log((d + 0.5) / F.lit(float(PRIME))) / s["weight"]
        return F.struct(cost.alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(F.array(*[_constants(s, w) for s, w in enumerate(weights) if w > 0]), option))


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the owning shard of each row; a null key counts as the empty string.

    Other columns pass through; an own column named `out` is replaced.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    h1, h2 = key_halves(F.col(key))
    return df.withColumn(out, weighted_choice(h1, h2, weights)["shard"])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, text CRC, shard, slot in it, and shard with one more.

    Null text: size 16, CRC of no bytes. Null doc_id: key of the empty string.
    Repeated rows share a shard and get neighbouring slots. Slots count from 0 in
    each shard without gaps. Texts are read and shards drawn once, into a table of
    short columns; its small hashed groups are numbered apart, then offset by the
    counts of the groups before, so no task holds a whole shard.
    """
    h1, h2 = key_halves(F.col("doc_id"))
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    keyed = base.withColumn("best", weighted_choice(F.col("h1"), F.col("h2"), [1.0] * shards))
    newcomer = -draw(F.col("h1"), F.col("h2"), _constants(shards)).cast("double")
    drawn = staged(
        keyed.select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("best.shard").alias("shard"),
            F.when(newcomer < F.col("best.cost"), shards).otherwise(F.col("best.shard")).alias("grown_shard"),
            "h2",
        ),
        "shard-draws",
    )
    groups = max(1, -(-drawn.count() // (shards * ROWS_A_GROUP)))
    keyed = drawn.withColumn("grp", F.col("h2") % groups)
    counts = keyed.groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "grp").orderBy("doc_id", "text_crc32", "size")
    placed = keyed.withColumn("at", F.row_number().over(order) - 1)
    return placed.join(starts, ["shard", "grp"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("at")).cast("long").alias("slot"),
        "grown_shard",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
