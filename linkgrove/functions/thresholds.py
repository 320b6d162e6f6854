"""Distances to threshold indexes and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.config import EPS, Thresholds


def threshold_index(distance: Column, thresholds: Thresholds) -> Column:
    """Least index whose threshold reaches the distance, tolerance included; the threshold count or more if none does.

    Indexes run over the distinct thresholds. The tolerance is EPS steps for uniform
    thresholds and EPS in the distance's own unit for sets.
    """
    if thresholds.kind == "uniform":
        steps = (distance - F.lit(thresholds.start)) / F.lit(thresholds.step) - F.lit(EPS)
        return F.greatest(F.ceil(steps), F.lit(0).cast("long")).cast("int")
    values = thresholds.distinct
    if thresholds.kind == "lookup":
        cell = F.round((distance - F.lit(values[0])) / F.lit(thresholds.precision))
        distance = F.lit(values[0]) + cell * F.lit(thresholds.precision)
    table = F.array(*[F.lit(v) for v in values])
    found = F.array_position(F.transform(table, lambda x: x >= distance - F.lit(EPS)), True) - 1
    return F.when(distance > F.lit(values[-1]), F.lit(len(values))).otherwise(found).cast("int")


def threshold_at(index: Column, thresholds: Thresholds) -> Column:
    """The threshold of an index; sets clamp indexes to their ends."""
    if thresholds.kind == "uniform":
        return F.lit(thresholds.start) + index * F.lit(thresholds.step)
    values = thresholds.distinct
    clamped = F.least(F.greatest(index, F.lit(0)), F.lit(len(values) - 1))
    return F.get(F.array(*[F.lit(v) for v in values]), clamped.cast("int"))


def threshold_table(spark: SparkSession, thresholds: Thresholds) -> DataFrame:
    """(t_order, t_idx, threshold, t_name): every given threshold with the index of its distinct value."""
    at = {v: i for i, v in enumerate(thresholds.distinct)}
    names = thresholds.names or (None,) * len(thresholds)
    rows = [(k, at[v], float(v), n) for k, (v, n) in enumerate(zip(thresholds.values, names, strict=True))]
    return spark.createDataFrame(rows, "t_order int, t_idx int, threshold double, t_name string")


def with_thresholds(clusters: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Add t_order, threshold and t_name to rows of t_idx; repeated thresholds repeat their rows.

    The threshold table is a setting of the caller, so its broadcast is bounded.
    """
    return clusters.join(F.broadcast(threshold_table(clusters.sparkSession, thresholds)), "t_idx")
