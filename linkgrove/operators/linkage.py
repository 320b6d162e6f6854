"""Single-linkage clustering of a sparse distance relation at many thresholds at once.

Contract: at threshold index t an object's cluster is the least object that it reaches
over pairs whose own index is at most t. Pairs may come in any order, repeatedly and in
either direction; absent pairs are too far, self pairs mean nothing.

A minimum spanning forest of the pairs, by (index, i, j), keeps all of this in at most
n - 1 pairs, and the forest of two forests' union is that of all their pairs. So every
partition reduces its own pairs first (partial aggregation), partial forests are merged
in rounds by hash of the subset and a shrinking number of parts, and what is left is
swept once; the sweep hands out how long each object kept which label, and built-in
expressions write the rows of every threshold, so a task holds objects, never objects
times thresholds. Over FOREST_PAIRS objects the sweep runs as DataFrame steps, one
contraction for each threshold that has pairs, and a dendrogram is built from runs of
FOREST_PAIRS merges; no task holds the whole forest then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrove.config import ClusterMethod, Parallelism, Thresholds
from linkgrove.functions.thresholds import threshold_at, threshold_index, with_thresholds
from linkgrove.operators.components import components
from linkgrove.sources.sequences import with_index
from linkgrove.storage import staged, unstage

#: Objects, and so forest pairs, of one subset that one task may hold: about 200 MB.
FOREST_PAIRS = 1_000_000
#: Pairs that a partial reduction gathers before it reduces them.
GATHER = 500_000
#: Partial forests that one merge task takes in.
FAN_IN = 8


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def spanning_forest(i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Places of the pairs that form the minimum spanning forest, in (t, i, j) order."""
    order = np.lexsort((j, i, t))
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)].tolist(), at[len(i) :].tolist()
    forest = Forest(len(nodes))
    return np.array([k for k in order.tolist() if forest.join(a[k], b[k])], np.int64)


def canonical(pairs: DataFrame, thresholds: Thresholds, subset: bool) -> DataFrame:
    """(subset, i, j, t): i < j, only pairs that some threshold reaches."""
    own = F.col("subset") if subset else F.lit(0).cast("long")
    return (
        pairs.where("id1 <> id2")
        .select(
            own.alias("subset"),
            F.least("id1", "id2").cast("long").alias("i"),
            F.greatest("id1", "id2").cast("long").alias("j"),
            threshold_index(F.col("dist"), thresholds).alias("t"),
        )
        .where(F.col("t") < len(thresholds.distinct))
    )


_PAIRS = "subset long, i long, j long, t int"
_ARROW = pa.schema([("subset", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("t", pa.int32())])


def _reduce_table(table: pa.Table) -> pa.Table:
    """The forest of each subset of a table."""
    subset, i, j, t = (table.column(k).to_numpy() for k in range(4))
    order = np.argsort(subset, kind="stable")
    cuts = np.flatnonzero(np.diff(subset[order], prepend=subset[order[0]] - 1)) if len(order) else []
    keep = []
    for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[low:high]
        keep.append(own[spanning_forest(i[own], j[own], t[own])])
    return table.take(pa.array(np.concatenate(keep) if keep else np.empty(0, np.int64)))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of all pairs of a partition, reduced again whenever it has doubled."""
    held: list[pa.RecordBatch] = []
    kept = rows = 0
    for batch in batches:
        held.append(pa.RecordBatch.from_arrays(batch.columns, schema=_ARROW))  # Spark may call columns not null
        rows += batch.num_rows
        if rows >= max(GATHER, 2 * kept):
            held = _reduce_table(pa.Table.from_batches(held, _ARROW)).combine_chunks().to_batches()
            kept = rows = sum(b.num_rows for b in held)
    if held:
        yield from _reduce_table(pa.Table.from_batches(held, _ARROW)).to_batches()


def forest(pairs: DataFrame) -> DataFrame:
    """Minimum spanning forest of canonical pairs, staged; a forest of forests in rounds.

    Each round groups by (subset, part), so a large subset is split and small ones meet
    at once. Rounds stop when one part is left or a part's forests would be too large.
    """
    now = staged(pairs.mapInArrow(_partial, _PAIRS), "forest")
    parts = len(now.inputFiles())
    rows = now.count()
    while parts > 1 and rows:
        parts = -(-parts // FAN_IN)
        if parts == 1:
            largest = now.groupBy("subset").agg(F.countDistinct("j").alias("n")).agg(F.max("n")).first()[0]
            if largest > FOREST_PAIRS:
                break
        keyed = now.groupBy("subset", (F.xxhash64("i") % parts).alias("part"))
        after = staged(keyed.applyInArrow(lambda table: _reduce_table(table), _PAIRS), "forest")
        unstage(now)
        now, rows = after, after.count()
    return now


def merge_forests(*forests: DataFrame) -> DataFrame:
    """The forest of several forests: what two states of a stream, or two files, add up to."""
    out = forests[0]
    for f in forests[1:]:
        out = out.unionByName(f)
    return forest(out)


def sweep(
    i: np.ndarray, j: np.ndarray, t: np.ndarray, objects: np.ndarray, count: int
) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(places, first, last, labels): objects that had these least reachable members from index first to last.

    Given out as labels change, so what is held is in proportion to the objects, which rise.
    """
    order = np.argsort(t, kind="stable")
    a, b = np.searchsorted(objects, i)[order], np.searchsorted(objects, j)[order]
    ends = np.searchsorted(t[order], np.arange(count), "right").tolist()
    f = Forest(len(objects))
    label = np.arange(len(objects))
    since = np.zeros(len(objects), np.int32)
    at = 0
    for k, end in enumerate(ends):
        if end == at:
            continue
        for x, y in zip(a[at:end].tolist(), b[at:end].tolist(), strict=True):
            f.join(x, y)
        at = end
        now = np.array(f.parent)
        while True:  # roots are least members, so jumping only falls
            up = now[now]
            if (up == now).all():
                break
            now = up
        places = np.flatnonzero(now != label)
        if k:
            yield places, since[places], k - 1, objects[label[places]]
        since[places] = k
        label = now
    yield np.arange(len(objects)), since, count - 1, objects[label]


_RUNS = "subset long, first int, last int, obj long, cluster long"


def _sweep_group(count: int):
    """Sweep of one subset: rows of objects (t is null) and forest pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        subset = table.column("subset")[0].as_py()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        is_object = table.column("t").is_null().to_numpy(zero_copy_only=False)
        t = table.column("t").fill_null(0).to_numpy()
        objects = np.unique(i[is_object])
        del table
        for places, first, last, labels in sweep(i[~is_object], j[~is_object], t[~is_object], objects, count):
            n = len(places)
            yield pa.record_batch({
                "subset": pa.array(np.full(n, subset), pa.int64()), "first": pa.array(first, pa.int32()),
                "last": pa.array(np.full(n, last, np.int32)), "obj": pa.array(objects[places], pa.int64()), "cluster": pa.array(labels, pa.int64()),
            })

    return run


def _each_threshold(runs: DataFrame) -> DataFrame:
    return runs.select("subset", F.explode(F.sequence("first", "last")).alias("t_idx"), "obj", "cluster")


def sweep_frames(pairs: DataFrame, objects: DataFrame, count: int) -> DataFrame:
    """The same sweep with no task that holds a forest: one contraction for each threshold that has pairs.

    Every member of a subset gets a number of its own; components of numbers are found,
    and a component's label is its least object, whatever the ids and subsets are.
    """
    from functools import reduce

    labels = staged(
        objects.select("subset", "obj", F.monotonically_increasing_id().alias("node"), F.col("obj").alias("cluster")), "sweep-labels"
    )
    levels = sorted(r.t for r in pairs.select("t").distinct().collect())  # thresholds at most
    out, since = [], 0
    for k in levels:
        if k > since:
            out.append(labels.withColumn("first", F.lit(since)).withColumn("last", F.lit(k - 1)))
        a = labels.select("subset", F.col("obj").alias("i"), F.col("node").alias("u"))
        b = labels.select("subset", F.col("obj").alias("j"), F.col("node").alias("v"))
        links = pairs.where(F.col("t") == k).join(a, ["subset", "i"]).join(b, ["subset", "j"]).where("u <> v").select("u", "v")
        reach = components(links, "sweep-links")
        moved = labels.join(reach, "node", "left").withColumn("node", F.coalesce("component", "node"))
        least = moved.groupBy("node").agg(F.min("cluster").alias("cluster"))
        labels = staged(moved.drop("cluster", "component").join(least, "node").select(*labels.columns), "sweep-labels")
        since = k
    out.append(labels.withColumn("first", F.lit(since)).withColumn("last", F.lit(count - 1)))
    return _each_threshold(reduce(DataFrame.unionByName, out))


def cluster(
    pairs: DataFrame,
    objects: DataFrame,
    thresholds: Thresholds,
    members: DataFrame | None = None,
    method: ClusterMethod | None = None,
    parallel: Parallelism | None = None,
    forest_pairs: int | None = None,
) -> DataFrame:
    """(subset, t_idx, obj, cluster) for every distinct threshold and object.

    `pairs` has id1, id2 (long) and dist; `objects` has obj. `members` (subset, obj)
    asks for several subsets, which may overlap; a pair then goes to every subset that
    holds both ends, and labels are objects, not places in the subset. `method` and
    `parallel` are checked settings that don't change the result.
    """
    del method, parallel
    count = len(thresholds.distinct)
    base = canonical(pairs, thresholds, False)
    if members is None:
        owned = objects.select(F.lit(0).cast("long").alias("subset"), F.col("obj").cast("long").alias("obj"))
        known = base
    else:
        owned = members.select(F.col("subset").cast("long"), F.col("obj").cast("long"))
        known = (
            base.drop("subset")
            .join(owned.withColumnRenamed("obj", "i"), "i")
            .join(owned.withColumnRenamed("obj", "j"), ["subset", "j"])
            .select("subset", "i", "j", "t")
        )
    owned = owned.distinct()
    tree = forest(known)
    largest = owned.groupBy("subset").count().agg(F.max("count")).first()[0] or 0
    if largest > (FOREST_PAIRS if forest_pairs is None else forest_pairs):
        return sweep_frames(tree, owned, count)
    return _swept(owned, tree, count)


def _swept(owned: DataFrame, tree: DataFrame | None, count: int) -> DataFrame:
    """One task for each subset: its objects, as rows without t, and its forest."""
    rows = owned.select("subset", F.col("obj").alias("i"), F.col("obj").alias("j"), F.lit(None).cast("int").alias("t"))
    if tree is not None:
        rows = rows.unionByName(tree)
    return _each_threshold(rows.groupBy("subset").applyInArrow(_sweep_group(count), _RUNS))


def labels_of(tree: DataFrame | None, objects: DataFrame, thresholds: Thresholds) -> DataFrame:
    """(subset, t_idx, obj, cluster) of a forest of subset 0, or of none."""
    owned = objects.select(F.lit(0).cast("long").alias("subset"), F.col("obj").cast("long").alias("obj")).distinct()
    if tree is not None and owned.count() > FOREST_PAIRS:
        return sweep_frames(tree, owned, len(thresholds.distinct))
    return _swept(owned, tree, len(thresholds.distinct))


def distmx_cluster(distances: DataFrame, names: DataFrame, thresholds: Thresholds, members: DataFrame | None = None, **settings) -> DataFrame:
    """Clusters with t_order, threshold, t_name and obj_id; `names` has seq_idx, seq_id.

    `distances` is (id1, id2, dist) with ids as in seq_idx; `members` is (subset, obj).
    """
    objects = names.select(F.col("seq_idx").alias("obj"))
    found = cluster(distances, objects, thresholds, members, **settings)
    named = found.join(names.select(F.col("seq_idx").alias("obj"), F.col("seq_id").alias("obj_id")), "obj", "left")
    return with_thresholds(named, thresholds)


def matrix(clusters: DataFrame) -> DataFrame:
    """(subset, obj, clusters): one array of cluster labels by threshold index for each object."""
    pairs = F.sort_array(F.collect_list(F.struct("t_idx", "cluster")))
    return clusters.groupBy("subset", "obj").agg(F.transform(pairs, lambda p: p["cluster"]).alias("clusters"))


def _dendrogram(thresholds: Thresholds):
    heights = list(thresholds.distinct)

    def run(table: pa.Table) -> pa.Table:
        subset = table.column("subset")[0].as_py()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        is_object = table.column("t").is_null().to_numpy(zero_copy_only=False)
        t = table.column("t").fill_null(0).to_numpy()
        objects = np.unique(i[is_object])
        i, j, t = i[~is_object], j[~is_object], t[~is_object]
        order = np.lexsort((j, i, t))
        f = Forest(len(objects))
        step_of: dict[int, int] = {}
        rows: list[tuple] = []

        def merge(a: int, b: int, height: float) -> None:
            """Leaves are -(place + 1), earlier steps their 1-based number; leaves first."""
            a, b = f.root(a), f.root(b)
            if a == b:
                return
            sides = sorted((step_of.get(r, -(r + 1)) for r in (a, b)), key=lambda x: (x > 0, abs(x)))
            f.join(a, b)
            rows.append((len(rows) + 1, *sides, height))
            step_of[min(a, b)] = len(rows)

        for k in order:
            merge(int(np.searchsorted(objects, i[k])), int(np.searchsorted(objects, j[k])), heights[t[k]])
        roots = [k for k in range(len(objects)) if f.root(k) == k]
        for r in roots[1:]:
            merge(roots[0], r, 1.0)
        steps, left, right, height = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.table({
            "subset": pa.array([subset] * len(steps), pa.int64()), "step": pa.array(steps, pa.int32()),
            "left": pa.array(left, pa.int32()), "right": pa.array(right, pa.int32()), "height": pa.array(height, pa.float64()),
        })

    return run


_STEPS = "subset long, step int, left int, right int, height double"


def hclust(pairs: DataFrame, objects: DataFrame, thresholds: Thresholds, forest_pairs: int | None = None) -> DataFrame:
    """(subset, step, left, right, height): the dendrogram with heights at thresholds; the rest joins at 1."""
    most = FOREST_PAIRS if forest_pairs is None else forest_pairs
    owned = objects.select(F.lit(0).cast("long").alias("subset"), F.col("obj").cast("long").alias("obj")).distinct()
    tree = forest(canonical(pairs, thresholds, False))
    if owned.count() > most:
        return hclust_frames(tree, owned, thresholds, most)
    rows = owned.select("subset", F.col("obj").alias("i"), F.col("obj").alias("j"), F.lit(None).cast("int").alias("t"))
    return rows.unionByName(tree).groupBy("subset").applyInArrow(_dendrogram(thresholds), _STEPS)


def _merge_run(table: pa.Table) -> pa.Table:
    """Merges of a run of forest pairs, given by their ends' clusters: (step, left, right), then (null, cluster, its cluster after)."""
    rank, a, b = (table.column(c).to_numpy() for c in ("rank", "a", "b"))
    order = np.argsort(rank)
    sides, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    f, now = Forest(len(sides)), sides.tolist()
    steps, left, right = [], [], []
    for step, x, y in zip((rank[order] + 1).tolist(), at[: len(order)].tolist(), at[len(order) :].tolist(), strict=True):
        x, y = f.root(x), f.root(y)
        low, high = sorted((now[x], now[y]), key=lambda s: (s > 0, abs(s)))
        f.join(x, y)
        now[min(x, y)] = step
        steps.append(step)
        left.append(low)
        right.append(high)
    after = [now[f.root(k)] for k in range(len(sides))]
    return pa.table({
        "step": pa.array([*steps, *[None] * len(sides)], pa.int64()), "left": pa.array([*left, *sides.tolist()], pa.int64()),
        "right": pa.array([*right, *after], pa.int64()),
    })


def hclust_frames(tree: DataFrame, objects: DataFrame, thresholds: Thresholds, most: int) -> DataFrame:
    """The same dendrogram with no task that holds more than `most` merges.

    A forest pair is one merge, and its place in (t, i, j) order is its step. Runs of
    `most` steps are merged one after another; between runs every object's cluster, a
    leaf or the last step that it took part in, is carried in a table.
    """
    from functools import reduce

    leaves = with_index(objects.select("obj"), ["obj"], "place")
    labels = staged(leaves.select("obj", "place", (-(F.col("place") + 1)).alias("side")), "dendrogram-labels")
    edges = staged(with_index(tree.select("t", "i", "j"), ["t", "i", "j"], "rank"), "dendrogram-pairs")
    total = edges.count()
    heights = F.array(*[F.lit(float(h)) for h in thresholds.distinct])
    out = []
    for low in range(0, total, most):
        own = edges.where(F.col("rank").between(low, low + most - 1))
        a = labels.select(F.col("obj").alias("i"), F.col("side").alias("a"))
        b = labels.select(F.col("obj").alias("j"), F.col("side").alias("b"))
        sided = own.join(a, "i").join(b, "j").select("rank", "a", "b")
        merged = staged(sided.groupBy(F.lit("run")).applyInArrow(_merge_run, "step long, left long, right long"), "dendrogram-run")
        height = own.select((F.col("rank") + 1).alias("step"), F.element_at(heights, F.col("t") + 1).alias("height"))
        out.append(merged.where("step is not null").join(height, "step").select("step", "left", "right", "height"))
        after = merged.where("step is null").select(F.col("left").alias("side"), F.col("right").alias("after"))
        labels = staged(
            labels.join(after, "side", "left").select("obj", "place", F.coalesce("after", "side").alias("side")), "dendrogram-labels"
        )
    # what is left joins the first cluster one after another
    tops = labels.groupBy("side").agg(F.min("place").alias("least"))
    numbered = staged(with_index(tops, ["least"], "k"), "dendrogram-tops")
    first = numbered.where("k = 0").select("side").first()
    if first is not None:
        before = F.when(F.col("k") == 1, F.lit(first[0])).otherwise(F.col("k") - 1 + total)
        pair = F.array_sort(F.array(F.struct((before > 0).alias("late"), F.abs(before).alias("no"), before.alias("side")),
                                    F.struct((F.col("side") > 0).alias("late"), F.abs("side").alias("no"), F.col("side").alias("side"))))
        rest = numbered.where("k > 0").withColumn("pair", pair)
        out.append(rest.select(
            (F.col("k") + total).alias("step"), F.col("pair")[0]["side"].alias("left"), F.col("pair")[1]["side"].alias("right"), F.lit(1.0).alias("height")
        ))
    none = objects.sparkSession.createDataFrame([], "step long, left long, right long, height double")
    kinds = [c.split() for c in _STEPS.split(", ")]
    return reduce(DataFrame.unionByName, out, none).withColumn("subset", F.lit(0)).select(*[F.col(c).cast(k).alias(c) for c, k in kinds])


def leaf_order(merges: list[tuple[int, int]]) -> list[int]:
    """Leaves in the order a dendrogram draws them, from its (left, right) steps."""
    if not merges:
        return [0]
    out: list[int] = []
    stack = [len(merges)]
    while stack:
        k = stack.pop()
        if k < 0:
            out.append(-k - 1)
        else:
            left, right = merges[k - 1]
            stack += [right, left]
    return out


__all__ = ["cluster", "distmx_cluster", "forest", "hclust", "hclust_frames", "leaf_order", "matrix", "merge_forests", "sweep_frames", "threshold_at"]
