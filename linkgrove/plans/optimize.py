"""Thresholds that best reproduce a known taxonomy, and their use for any taxon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.config import Thresholds, threshold_uniform
from linkgrove.functions.taxa import RANKS, subranks, superranks
from linkgrove.functions.thresholds import threshold_table
from linkgrove.operators.distances import seq_distmx
from linkgrove.operators.linkage import cluster
from linkgrove.operators.metrics import MEASURES, best_thresholds, cluster_measures
from linkgrove.operators.ranks import rank_pairs, true_partitions
from linkgrove.sources.sequences import indexed, with_index
from linkgrove.storage import staged

NO_TAXON = "_NA_"


def subset_table(taxonomy: DataFrame, ranks: Sequence[str], id_col: str, min_taxa: int, min_refseq: int) -> DataFrame:
    """(superrank, rank, supertaxon, seq_id, c) of subsets that are large enough, or of the root."""
    pairs = true_partitions(rank_pairs(taxonomy, ranks, id_col))
    sizes = pairs.groupBy("superrank", "rank", "supertaxon").agg(
        F.count(F.lit(1)).alias("n_seq"), F.countDistinct("taxon").alias("n_taxa")
    )
    roots = taxonomy.select(F.col(ranks[0]).alias("supertaxon")).where("supertaxon IS NOT NULL").distinct().withColumn("root", F.lit(True))
    large = (
        sizes.join(roots, "supertaxon", "left")
        .where(((F.col("n_seq") >= min_refseq) & (F.col("n_taxa") >= min_taxa)) | F.col("root"))
        .select("superrank", "rank", "supertaxon")
    )
    return pairs.join(large, ["superrank", "rank", "supertaxon"])


def optimize_from_pairs(
    pairs: DataFrame,
    taxonomy: DataFrame,
    ranks: Sequence[str] = RANKS,
    thresholds: Thresholds | None = None,
    min_taxa: int = 5,
    min_refseq: int | None = None,
    id_col: str = "seq_id",
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """(rank, superrank, supertaxon, measure, threshold, value) from a distance relation.

    `taxonomy` has id_col, seq_idx and the ranks; `pairs` is (id1, id2, dist) over
    seq_idx. All subsets are clustered in one job, whatever their number.
    """
    thresholds = thresholds or threshold_uniform(0.0, 0.4, 0.001)
    wanted = subset_table(taxonomy, ranks, id_col, min_taxa, 2 * min_taxa if min_refseq is None else min_refseq)
    keys = ["superrank", "rank", "supertaxon"]
    placed = wanted.join(taxonomy.select(F.col(id_col).alias("seq_id"), F.col("seq_idx").alias("obj")), "seq_id")
    numbers = with_index(placed.select(*keys).distinct(), keys, "subset")
    owned = staged(placed.join(numbers, keys).select("subset", *keys, "obj", "c"), "subsets")
    objects = taxonomy.select(F.col("seq_idx").alias("obj"))
    clusters = cluster(pairs, objects, thresholds, owned.select("subset", "obj"))
    measured = cluster_measures(
        clusters.withColumnRenamed("cluster", "k"), owned.select("subset", "obj", "c"), ["subset", "t_idx"], measures
    )
    best = best_thresholds(measured, threshold_table(pairs.sparkSession, thresholds), ["subset"])
    names = owned.select("subset", *keys).distinct()
    return best.join(names, "subset").select("rank", "superrank", "supertaxon", "measure", "threshold", "value")


def optimize_thresholds(
    taxonomy: DataFrame, seqs: DataFrame, ranks: Sequence[str] = RANKS, config=None, thresholds: Thresholds | None = None, **settings
) -> DataFrame:
    """The same from sequences: each pair is aligned once, whatever the number of subsets that hold it."""
    thresholds = thresholds or threshold_uniform(0.0, 0.4, 0.001)
    numbered = indexed(seqs)
    pairs = staged(
        seq_distmx(numbered, thresholds.top, config, by_index=True).select(
            F.col("seq_idx1").alias("id1"), F.col("seq_idx2").alias("id2"), F.col("dist2").alias("dist")
        ),
        "reference-pairs",
    )
    id_col = settings.get("id_col", "seq_id")
    placed = taxonomy.join(numbered.select(F.col("seq_id").alias(id_col), "seq_idx"), id_col)
    return optimize_from_pairs(pairs, placed, ranks, thresholds, **settings)


def chosen_optima(optima: DataFrame, measure: str | None = None, metric: str | None = None, conf_level=None) -> DataFrame:
    """Optima of one measure and confidence level; `measure` looks in the column `metric` if there is one."""
    if measure is not None and metric is not None:
        raise ValueError("give measure or metric, not both")
    out = optima
    if conf_level is not None:
        out = out.where(F.col("conf_level") == conf_level)
    if (name := measure or metric) is not None:
        out = out.where(F.col("metric" if "metric" in optima.columns else "measure") == name)
    return out


def _lookup(optima: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first optimum of each (rank, superrank, supertaxon)."""
    w = Window.partitionBy("rank", "superrank", "supertaxon").orderBy(*order)
    return optima.withColumn("_at", F.row_number().over(w)).where("_at = 1").select("rank", "superrank", "supertaxon", "threshold")


def _with_thresholds(taxa: DataFrame, optima: DataFrame, rank: str, child: str, ranks: Sequence[str], name: str) -> DataFrame:
    """Add the threshold for `child` of each taxon: that of the taxon itself, else of its nearest known ancestor."""
    found = []
    for k, level in enumerate([rank, *reversed(superranks(rank, ranks))]):
        own = optima.where((F.col("rank") == child) & (F.col("superrank") == level)).select(
            F.col("supertaxon").alias(level), F.col("threshold").alias(f"_t{k}")
        )
        taxa = taxa.join(own, level, "left")
        found.append(f"_t{k}")
    return taxa.withColumn(name, F.coalesce(*found)).drop(*found)


def _default(optima: DataFrame, child: str, default: Sequence[str] | DataFrame, order: Sequence[str]) -> DataFrame:
    """One row, the first optimum for `child` of a default supertaxon; null if none."""
    own = optima.where(F.col("rank") == child)
    if isinstance(default, DataFrame):
        own = own.join(default, "supertaxon", "left_semi")
    else:
        own = own.where(F.col("supertaxon").isin(list(default)))
    return own.orderBy(*order).limit(1).agg(F.max("threshold").alias("threshold"))


def _prepare(taxon_table, optima, rank, ranks, default, measure, metric, conf_level):
    chosen = chosen_optima(optima, measure, metric, conf_level)
    order = ["_place"] if "_place" in chosen.columns else ["superrank", "supertaxon", "threshold"]
    if default is None:
        default = taxon_table.select(F.col(ranks[0]).alias("supertaxon")).where("supertaxon IS NOT NULL").distinct()
    taxa = taxon_table.select(*[*superranks(rank, ranks), rank]).where(F.col(rank).isNotNull()).distinct()
    first = Window.partitionBy(rank).orderBy(*[F.col(r) for r in superranks(rank, ranks)] or [F.col(rank)])
    taxa = taxa.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")
    return chosen, order, default, taxa


def calc_taxon_thresholds(
    rank: str, taxon_table: DataFrame, optima: DataFrame, ranks: Sequence[str] = RANKS, conf_level=None, measure: str | None = None,
    default: Sequence[str] | None = None, metric: str | None = None,
) -> DataFrame:
    """(taxon, threshold) for the next rank below `rank`; the taxon '_NA_' has the default's.

    A taxon without an optimum of its own takes that of its nearest ancestor. No rows if
    the table knows no taxon at `rank`. `default` is the root's taxa unless given.
    """
    child = subranks(rank, ranks)[0]
    chosen, order, default, taxa = _prepare(taxon_table, optima, rank, ranks, default, measure, metric, conf_level)
    known = _with_thresholds(taxa, _lookup(chosen, order), rank, child, ranks, "threshold").select(F.col(rank).alias("taxon"), "threshold")
    other = _default(chosen, child, default, order).select(F.lit(NO_TAXON).alias("taxon"), "threshold")
    some = taxa.limit(1).select(F.lit(1).alias("_some"))
    return known.unionByName(other.join(some).drop("_some"))


def calc_subtaxon_thresholds(
    rank: str, taxon_table: DataFrame, optima: DataFrame, ranks: Sequence[str] = RANKS, conf_level=None, measure: str | None = None,
    default: Sequence[str] | None = None, metric: str | None = None,
) -> DataFrame:
    """(taxon, rank, threshold) for all ranks below `rank`, never falling towards more inclusive ones.

    Going up from the least inclusive rank, a threshold is the largest so far; after a
    missing one all further ones are missing.
    """
    children = subranks(rank, ranks)
    chosen, order, default, taxa = _prepare(taxon_table, optima, rank, ranks, default, measure, metric, conf_level)
    lookup = _lookup(chosen, order)
    known = taxa
    for c in children:
        known = _with_thresholds(known, lookup, rank, c, ranks, f"_of_{c}")
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("rank"), F.col(f"_of_{c}").alias("t")) for i, c in enumerate(children)])
    long = known.select(F.col(rank).alias("taxon"), F.inline(rows))
    some = taxa.limit(1).select(F.lit(1).alias("_some"))
    for i, c in enumerate(children):
        other = _default(chosen, c, default, order)
        long = long.unionByName(
            other.join(some).select(F.lit(NO_TAXON).alias("taxon"), F.lit(i).alias("place"), F.lit(c).alias("rank"), F.col("threshold").alias("t"))
        )
    w = Window.partitionBy("taxon").orderBy(F.col("place").desc())
    missing = F.max(F.col("t").isNull().cast("int")).over(w)
    return long.select("taxon", "rank", F.when(missing == 0, F.max("t").over(w)).alias("threshold"))
