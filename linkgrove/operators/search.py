"""Best hits of query sequences among references: all ties at the least distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.config import FileDistance, HammingDistance, Wfa2Distance
from linkgrove.functions import alignment as al
from linkgrove.functions import hamming as hm
from linkgrove.operators.distances import BATCH, CELLS, Kernel, group_size, on_tiles, tiles
from linkgrove.sources import distances as files

#: Least queries and references of a task's groups.
QUERY_BLOCK, REF_BLOCK = 256, 1024
_HITS = "seq_id string, ref_id string, dist double, cigar string"


def _best(config, threshold: float, span: str, cigar: bool):
    kernel = Kernel(config, threshold, span)

    def run(table: pa.Table) -> pa.Table:
        is_ref = table.column("is_ref").to_numpy(zero_copy_only=False)
        ids, seqs = table.column("id").to_pylist(), table.column("seq").to_pylist()
        queries, refs = np.flatnonzero(~is_ref), np.flatnonzero(is_ref)
        out: list[tuple] = []
        ref_len = np.array([len(seqs[k]) for k in refs])
        for at, q in enumerate(queries):
            dist = np.full(len(refs), np.inf)
            own = np.flatnonzero(kernel.possible(np.full(len(refs), len(seqs[q])), ref_len))
            for k in range(0, len(own), BATCH):
                part = own[k : k + BATCH]
                dist[part] = kernel.rows([seqs[q]] * len(part), [seqs[refs[r]] for r in part])[0]
            if len(dist) and (least := dist.min()) <= threshold:
                for r in np.flatnonzero(dist == least):
                    ref = refs[r]
                    text = None
                    if cigar:
                        pair = sorted((seqs[q], seqs[ref]), key=len)
                        text = al.cigar(*pair, config, span)
                    out.append((ids[q], ids[ref], float(least), text))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["seq_id", "ref_id", "dist", "cigar"])

    return run


def _best_hamming(config: HammingDistance, threshold: float):
    def run(one: pa.Table, two: pa.Table) -> Iterator[tuple]:
        grid = hm.encode([*one.column("seq").to_pylist(), *two.column("seq").to_pylist()])
        bits = hm.planes(grid)
        queries, refs = bits[:, :, : len(one)], bits[:, :, len(one) :]
        ids = [t.column("seq_id").combine_chunks() for t in (one, two)]
        for i, j, wrong, compared in hm.near_pairs(queries, refs, threshold, config, CELLS, False):
            # a query's pairs with all references of the group come at once
            dist = hm.as_distance(wrong, compared, config)
            least = np.full(len(one), np.inf)
            np.minimum.at(least, i, dist)
            best = dist == least[i]
            yield ids[0].take(pa.array(i[best])), ids[1].take(pa.array(j[best])), dist[best]

    return run


def best_hits(hits: DataFrame) -> DataFrame:
    """All hits of each query at its least distance."""
    w = Window.partitionBy("seq_id")
    return hits.withColumn("_least", F.min("dist").over(w)).where("dist = _least").drop("_least")


def seq_search(
    query: DataFrame,
    ref: DataFrame,
    threshold: float,
    config=None,
    return_cigar: bool = False,
    span: str = "global",
) -> DataFrame:
    """(seq_id, ref_id, dist[, cigar]): every reference at the least distance of each query, if within the threshold.

    Queries without a hit have no row. Pairs of blocks are compared in one task each,
    which sends on its own best hits only; the best of those are found among hits.
    """
    config = config if config is not None else Wfa2Distance()
    if isinstance(config, FileDistance):
        return best_hits(files.file_hits(query.sparkSession, config, query, ref).where(F.col("dist") <= threshold))
    if isinstance(config, HammingDistance) and (return_cigar or span != "global"):
        raise ValueError("Hamming distance has neither CIGAR nor extension")
    if isinstance(config, HammingDistance):
        pairs = tiles(query.select("seq_id", "seq"), ref.select("seq_id", "seq"), key="seq_id")
        schema = "seq_id string, ref_id string, dist double"
        return best_hits(pairs.mapInArrow(on_tiles(_best_hamming(config, threshold), schema), schema))
    rows = query.count(), ref.count()
    nq, nr = (max(1, -(-n // group_size(n, least))) for n, least in zip(rows, (QUERY_BLOCK, REF_BLOCK), strict=True))

    def dealt(df: DataFrame, own: int, other: int, is_ref: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("seq_id"), F.lit(own))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        block = df.select(F.lit(is_ref).alias("is_ref"), F.col("seq_id").alias("id"), "seq", mine.alias("mine"), theirs.alias("theirs"))
        q, r = ("theirs", "mine") if is_ref else ("mine", "theirs")
        return block.select("is_ref", "id", "seq", F.col(q).alias("q"), F.col(r).alias("r"))

    pairs = dealt(query, nq, nr, False).unionByName(dealt(ref, nr, nq, True))
    found = best_hits(pairs.groupBy("q", "r").applyInArrow(_best(config, threshold, span, return_cigar), _HITS))
    return found if return_cigar else found.drop("cigar")


def one_hit(hits: DataFrame, seed: int | None = None) -> DataFrame:
    """One reference a query: the least id, or by a seeded hash."""
    order = F.col("ref_id") if seed is None else F.xxhash64(F.lit(seed), "ref_id")
    w = Window.partitionBy("seq_id").orderBy(order, "ref_id")
    return hits.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
