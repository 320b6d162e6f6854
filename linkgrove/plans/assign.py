"""New sequences into a known taxonomy: closed-reference waves, then de novo clusters, rank by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.config import Wfa2Distance, threshold_set
from linkgrove.functions.taxa import RANKS, subranks
from linkgrove.operators.distances import seq_distmx
from linkgrove.operators.linkage import cluster
from linkgrove.operators.search import one_hit, seq_search
from linkgrove.plans.optimize import NO_TAXON, calc_subtaxon_thresholds, calc_taxon_thresholds
from linkgrove.sources.sequences import indexed, with_index
from linkgrove.storage import staged, unstage


def closed_ref_from_pairs(pairs: DataFrame, query: DataFrame, ref: DataFrame, threshold: float) -> DataFrame:
    """(seq_id, ref_id, wave): queries that a chain of steps within the threshold joins to a reference.

    `pairs` is (seq_id, other_id, dist) among queries and references, in any direction.
    Each wave takes, for every open query, the nearest sequence found in the last wave,
    the least id on ties, and hands on that one's original reference. The loop runs on
    the driver, its tables in the shared folder.
    """
    near = staged(
        pairs.where(F.col("dist") <= threshold)
        .select("seq_id", "other_id", "dist")
        .unionByName(pairs.where(F.col("dist") <= threshold).select(F.col("other_id").alias("seq_id"), F.col("seq_id").alias("other_id"), "dist")),
        "near-pairs",
    )
    open_ = query.select("seq_id").distinct()
    last = ref.select(F.col("seq_id").alias("other_id"), F.col("seq_id").alias("ref_id")).distinct()
    found: DataFrame | None = None
    wave = 0
    while True:
        wave += 1
        w = Window.partitionBy("seq_id").orderBy("dist", "other_id")
        hits = (
            near.join(open_, "seq_id", "left_semi")
            .join(last, "other_id")
            .withColumn("_at", F.row_number().over(w))
            .where("_at = 1")
            .select("seq_id", "ref_id", F.lit(wave).alias("wave"))
        )
        hits = staged(hits, f"closed-wave-{wave}")
        if hits.limit(1).count() == 0:
            break
        found = hits if found is None else found.unionByName(hits)
        open_ = staged(open_.join(hits, "seq_id", "left_anti"), "closed-open")
        last = hits.select(F.col("seq_id").alias("other_id"), "ref_id")
    out = found if found is not None else hits
    return out


def closed_ref_cluster(query: DataFrame, ref: DataFrame, threshold: float, config=None, **search) -> DataFrame:
    """(seq_id, ref_id): the same with searches instead of known distances; each wave's hits are the next one's references."""
    config = config or Wfa2Distance()
    open_, now = query.select("seq_id", "seq"), ref.select("seq_id", "seq")
    origin = ref.select(F.col("seq_id").alias("via"), F.col("seq_id").alias("ref_id"))
    found: DataFrame | None = None
    while True:
        hits = one_hit(seq_search(open_, now, threshold, config, **search)).select("seq_id", F.col("ref_id").alias("via"))
        wave = staged(hits.join(origin, "via").select("seq_id", "ref_id"), "closed-hits")
        if wave.limit(1).count() == 0:
            return wave if found is None else found
        found = wave if found is None else found.unionByName(wave)
        now = staged(open_.join(wave, "seq_id", "left_semi"), "closed-refs")
        open_ = staged(open_.join(wave, "seq_id", "left_anti"), "closed-open")
        origin = wave.select(F.col("seq_id").alias("via"), "ref_id")


def known_taxa(tax_prob: DataFrame, rank: str, prob_thresh: float | None) -> DataFrame:
    """(seq_id, taxon) of sequences whose taxon at this rank is known well enough."""
    own = tax_prob.where((F.col("rank") == rank) & F.col("taxon").isNotNull())
    if "prob" in tax_prob.columns and prob_thresh is not None:
        own = own.where(F.col("prob") >= prob_thresh)
    w = Window.partitionBy("seq_id").orderBy("taxon")
    return own.withColumn("_at", F.row_number().over(w)).where("_at = 1").select("seq_id", "taxon")


def assign_taxa(
    seqs: DataFrame,
    tax_prob: DataFrame,
    optima: DataFrame,
    ranks: Sequence[str] = RANKS,
    measure: str | None = None,
    prob_thresh: float | None = None,
    config=None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(seq_id, ranks…): a taxon or a pseudotaxon at every rank for every sequence.

    At each rank, in a parent with both known and unknown sequences the unknown ones
    join known taxa by closed-reference waves at the parent's threshold. Those that
    stay unknown are clustered among themselves, at this and all lower ranks, and their
    clusters are named pseudo<rank>_<number>, by the first id in each. `pairs` (seq_id,
    other_id, dist) replaces alignment; else all pairs within the largest threshold are
    aligned once and every rank and parent joins to that table.
    """
    numbered = staged(indexed(seqs).select("seq_idx", "seq_id", "seq"), "assign-seqs")
    root = ranks[0]
    top = optima.agg(F.coalesce(F.max("threshold"), F.lit(0.0))).first()[0]
    if pairs is None:
        pairs = seq_distmx(numbered, top, config or Wfa2Distance()).select(
            F.col("seq_id1").alias("seq_id"), F.col("seq_id2").alias("other_id"), F.col("dist2").alias("dist")
        )
    # no threshold of a rank or parent is above the largest
    pairs = staged(pairs.where(F.col("dist") <= top), "assign-pairs")
    first = known_taxa(tax_prob, root, prob_thresh).withColumnRenamed("taxon", root)
    table = staged(numbered.select("seq_id").join(first, "seq_id"), "assign-table")
    pseudo: DataFrame | None = None
    for parent_rank, rank in zip(ranks, ranks[1:], strict=False):
        known = known_taxa(tax_prob, rank, prob_thresh)
        placed = staged(table.join(known.withColumnRenamed("taxon", rank), "seq_id", "left"), "assign-placed")
        limits = calc_taxon_thresholds(parent_rank, placed, optima, ranks, measure=measure)
        cut = _cut_of(placed.select("seq_id", F.col(parent_rank).alias("parent")), limits)
        placed = staged(_closed_reference(placed, pairs, cut, rank), "assign-closed")
        unknown = placed.where(F.col(rank).isNull())
        lower = [rank, *subranks(rank, ranks)]
        sub = calc_subtaxon_thresholds(parent_rank, placed, optima, ranks, measure=measure)
        fresh = _de_novo(unknown, pairs, sub, numbered, parent_rank, lower)
        pseudo_now = _name(fresh, parent_rank, rank, lower)
        kept = None if pseudo is None else pseudo
        own = unknown.select(*[c for c in ranks[: ranks.index(rank)]], "seq_id").join(pseudo_now, "seq_id")
        pseudo = staged(own if kept is None else kept.unionByName(own), "assign-pseudo")
        table = staged(placed.where(F.col(rank).isNotNull()), "assign-table")
    columns = ["seq_id", *ranks]
    done = table.select(*columns)
    return (done if pseudo is None else done.unionByName(pseudo.select(*columns))).orderBy("seq_id")


def _cut_of(members: DataFrame, limits: DataFrame) -> DataFrame:
    """(seq_id, parent, cut): each sequence's parent and the parent's threshold, else the default."""
    own = limits.where(F.col("taxon") != NO_TAXON).select(F.col("taxon").alias("parent"), F.col("threshold").alias("_own"))
    other = limits.where(F.col("taxon") == NO_TAXON).agg(F.max("threshold").alias("_any"))  # one row
    return (
        members.join(own, "parent", "left").crossJoin(F.broadcast(other)).select("seq_id", "parent", F.coalesce("_own", "_any").alias("cut"))
    )


def _closed_reference(placed: DataFrame, pairs: DataFrame, cut: DataFrame, rank: str) -> DataFrame:
    """`placed` with `rank` filled in along chains inside a parent, each at the parent's threshold."""
    a = cut.select("seq_id", "parent", "cut")
    b = cut.select(F.col("seq_id").alias("other_id"), F.col("parent").alias("_parent"))
    inside = pairs.join(a, "seq_id").join(b, "other_id").where((F.col("parent") == F.col("_parent")) & (F.col("dist") <= F.col("cut")))
    ref, query = placed.where(F.col(rank).isNotNull()), placed.where(F.col(rank).isNull())
    found = closed_ref_from_pairs(inside.select("seq_id", "other_id", "dist"), query, ref, float("inf"))
    taxa = ref.select(F.col("seq_id").alias("ref_id"), F.col(rank).alias("_taxon"))
    filled = found.join(taxa, "ref_id").select("seq_id", "_taxon")
    return placed.join(filled, "seq_id", "left").withColumn(rank, F.coalesce(rank, "_taxon")).drop("_taxon")


def _de_novo(unknown: DataFrame, pairs: DataFrame, limits: DataFrame, numbered: DataFrame, parent_rank: str, lower: Sequence[str]) -> DataFrame:
    """(seq_id, parent, cluster labels at `lower`): clusters inside each parent at its own thresholds.

    Every rank is one clustering with a single threshold: a pair counts if it is within
    the parent's threshold of the rank. A missing threshold keeps sequences apart.
    """
    members = unknown.select("seq_id", F.col(parent_rank).alias("parent")).join(numbered.select("seq_id", "seq_idx"), "seq_id")
    members = staged(members, "denovo-members")
    out = members
    for r in lower:
        cut = _cut_of(members.select("seq_id", "parent"), limits.where(F.col("rank") == r).drop("rank"))
        a = members.join(cut.select("seq_id", "cut"), "seq_id").select("seq_id", "parent", "cut", F.col("seq_idx").alias("id1"))
        b = members.select(F.col("seq_id").alias("other_id"), F.col("parent").alias("_p"), F.col("seq_idx").alias("id2"))
        near = (
            pairs.join(a, "seq_id")
            .join(b, "other_id")
            .where((F.col("parent") == F.col("_p")) & (F.col("dist") <= F.col("cut")))
            .select("id1", "id2", F.lit(0.0).alias("dist"))
        )
        labels = cluster(near, members.select(F.col("seq_idx").alias("obj")), threshold_set([0.0]))
        out = out.join(labels.select(F.col("obj").alias("seq_idx"), F.col("cluster").alias(f"_c_{r}")), "seq_idx")
    return staged(out, "denovo-clusters")


def _name(fresh: DataFrame, parent_rank: str, rank: str, lower: Sequence[str]) -> DataFrame:
    """(seq_id, lower…): cluster labels as names, numbered over all parents by the first id of each cluster.

    Distinct clusters are numbered, one row each.
    """
    out = fresh
    for r in lower:
        label = f"_c_{r}"
        firsts = fresh.groupBy("parent", label).agg(F.min("seq_id").alias("_first"))
        total = firsts.count()
        width = max(3, len(str(total)))
        number = F.lpad((F.col("_number") + 1).cast("string"), width, "0")
        named = with_index(firsts, ["_first", "parent"], "_number").select("parent", label, F.concat(F.lit(f"pseudo{r}_"), number).alias(r))
        out = out.join(named, ["parent", label])
    return out.select("seq_id", *lower)


__all__ = ["assign_taxa", "closed_ref_cluster", "closed_ref_from_pairs", "known_taxa", "unstage"]
