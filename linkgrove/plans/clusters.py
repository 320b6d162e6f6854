"""Sequences to clusters, in one plan: pairs by blocks, their forest, the sweep over thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrove.config import ClusterMethod, FileDistance, Parallelism, Thresholds, Wfa2Distance
from linkgrove.functions.thresholds import with_thresholds
from linkgrove.operators.distances import seq_distmx
from linkgrove.operators.linkage import cluster, distmx_cluster, hclust
from linkgrove.sources import distances as files
from linkgrove.sources.sequences import check_ids, indexed, memberships, read_sequences


def _relation(seqs: DataFrame, config, thresholds: Thresholds) -> DataFrame:
    if isinstance(config, FileDistance):
        return files.load(seqs.sparkSession, config, seqs)
    found = seq_distmx(seqs, thresholds.top, config, by_index=True)
    return found.select(F.col("seq_idx1").alias("id1"), F.col("seq_idx2").alias("id2"), F.col("dist2").alias("dist"))


def seq_cluster(
    source,
    thresholds: Thresholds,
    config=None,
    which=True,
    output_type: str = "matrix",
    method: ClusterMethod | None = None,
    parallel: Parallelism | None = None,
    spark=None,
) -> DataFrame:
    """Cluster a sequence set, given in any form that read_sequences takes.

    matrix: (subset, t_idx, obj, cluster, obj_id, t_order, threshold, t_name) rows, one
    clustering for each list of ids in `which`. hclust: the dendrogram of the whole set.
    """
    spark = spark or source.sparkSession
    seqs = indexed(read_sequences(spark, source))
    check_ids(seqs)
    config = config or Wfa2Distance()
    pairs = _relation(seqs, config, thresholds)
    objects = seqs.select(F.col("seq_idx").alias("obj"))
    if output_type == "hclust":
        return hclust(pairs, objects, thresholds)
    if output_type != "matrix":
        raise ValueError(f"unknown output type {output_type!r}")
    members = None if which is True else memberships(spark, seqs, which)
    found = cluster(pairs, objects, thresholds, members, method, parallel)
    named = found.join(seqs.select(F.col("seq_idx").alias("obj"), F.col("seq_id").alias("obj_id")), "obj", "left")
    return with_thresholds(named, thresholds)


__all__ = ["distmx_cluster", "seq_cluster"]
