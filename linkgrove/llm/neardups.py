"""Near-duplicate groups by SimHash anchors and the exact Jaccard similarity of word shingles.

Every set of five-word shingles has a 64-bit SimHash, and fingerprints meet at the anchor
points of the covering code of `simhash`. A fingerprint meets the leaders of its anchors,
the nearest few of these are compared by whole sets, and what is similar is one group.
Sets of similarity 0.8 may differ in more bits than any affordable anchors span, so what
the fingerprints did not join is then found by prefix filtering, between groups only.

Prefix filtering: let all shingles have one order. Of two sets of similarity 0.8 or more
the smaller has one of its first `index_size` shingles among the first `probe_size` of
the larger, so no pair can be missed whatever the order is. The first shingle that both
have must also leave enough behind it in both sets. The order puts shingles that a sample
of the documents holds often last and sorts by hash otherwise: a stock passage opens no
comparison unless nearly all of a text is stock. Candidates then meet by their parity
sketches, 512 bits that differ in no more places than the sets have different members,
and what is left by whole sets.

Equal sets are one node. In a few more rounds a node meets a few partners, each the leader that
chance gives to a shingle, which joins large groups of copies by about as many comparisons
as they have members; after that all candidate pairs of different components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.llm import simhash
from linkgrove.llm.common import LOWER, UPPER, few_files, free_shuffles, maybe_broadcast, passing, staged, unstage
from linkgrove.operators.components import components

SEED = 42
SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that comparisons are exact.
SIMILAR = (4, 5)
#: One document of this many tells which shingles are frequent, those it holds this often.
SAMPLE, OFTEN = 8, 8
#: Most frequent shingles that are sent to every task.
MOST_FREQUENT = 200_000
#: Rounds before all candidate pairs are compared, and partners that a text meets in each.
ROUNDS, PARTNERS = 3, 3
#: Most bits in which fingerprints that meet at an anchor may differ.
WITHIN = 16
#: Words of 64 bits in a parity sketch.
SKETCH = 8
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles as rising 64-bit hashes; ASCII case is ignored.

    A text with fewer than five words is one shingle of all its words; null or no words: none.
    """
    ws = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w, SEED) for w in ws), np.uint64, len(ws))
    n = len(ws) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * _MIX + one[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def probe_size(n: int) -> int:
    """First shingles of a set of n of which a similar set that is no larger has one."""
    a, b = SIMILAR
    return n - -(-a * n // b) + 1 if n else 0


def _shared(size: str | Column, other: str | Column) -> Column:
    """Least number of common shingles of similar sets of these sizes."""
    a, b = SIMILAR
    return F.ceil((F.col(size) + F.col(other)) * a / (a + b))


def _index_size(n: Column) -> Column:
    """First shingles of a set of n of which one stands in the probe of a similar set that is no smaller."""
    a, b = SIMILAR
    return n - F.ceil(n * (2 * a) / (a + b)) + 1


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, text) to (row, id, mark, fp): a hash and the SimHash of the row's set."""
    for batch in batches:
        marks, fps = np.empty((2, batch.num_rows), np.uint64)
        for k, t in enumerate(batch.column(2)):
            shingles = shingle_set(t.as_py())
            marks[k], fps[k] = xxhash.xxh64_intdigest(shingles.tobytes(), SEED), simhash.of_hashes(shingles)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(marks.view(np.int64)), pa.array(fps.view(np.int64))],
            names=["_row", "_id", "_mark", "_fp"],
        )


def _heads(pick):
    """(node, n, i, h): the shingles that `pick` takes from each set, and their places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                picked = [pick(s) for s in sets]
                sizes = np.array([len(p) for p in picked], np.int64)
                nodes = np.repeat(part.column(0).to_numpy(), sizes)
                ns = np.repeat(np.array([len(s) for s in sets], np.int32), sizes)
                places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hs = np.concatenate([*picked, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.record_batch(
                    [pa.array(nodes), pa.array(ns), pa.array(places.astype(np.int32)), pa.array(hs)], names=["node", "n", "i", "h"]
                )

    return run


def _prefix(frequent: np.ndarray):
    def pick(shingles: np.ndarray) -> np.ndarray:
        p = probe_size(len(shingles))
        if not len(frequent):
            return shingles[:p]
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        last = frequent[at] == shingles
        return np.concatenate([shingles[~last], shingles[last]])[:p]

    return pick


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles' numbers by their low bits, as SKETCH longs."""
    bits = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_BITS = [f"b{k}" for k in range(SKETCH)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, bits = np.empty(batch.num_rows, np.int32), np.empty((SKETCH, batch.num_rows), np.int64)
        for k, t in enumerate(batch.column(1)):  # one set at a time, as a batch may have 10,000 texts
            shingles = shingle_set(t.as_py())
            sizes[k], bits[:, k] = len(shingles), sketch(shingles)
        yield pa.record_batch([batch.column(0), pa.array(sizes), *map(pa.array, bits)], names=["node", "n", *_BITS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])


def _among(texts: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """The texts of the given nodes, at most `rows`."""
    nodes = staged(few_files(nodes.distinct(), rows), "near-among")
    return texts.join(maybe_broadcast(nodes, nodes.count()), "node", "left_semi")


def _similar(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the candidate pairs whose sets are similar enough; only texts whose sketches are close make sets."""
    a, b = SIMILAR

    def side(key: str) -> DataFrame:
        return sketches.select(F.col("node").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("n", *_BITS)])

    differ = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in _BITS), F.lit(0))
    may = differ <= F.col("u_n") + F.col("v_n") - 2 * _shared("u_n", "v_n")
    close = pairs.join(side("u"), "u").join(side("v"), "v").where(may).select("u", "v")
    close = staged(few_files(close, pairs.count()), "near-close")
    ends = close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node")))
    sets = _among(texts, ends, 2 * close.count()).mapInArrow(_sets, "node long, s array<long>")
    left = sets.select(F.col("node").alias("u"), F.col("s").alias("u_s"))
    right = sets.select(F.col("node").alias("v"), F.col("s").alias("v_s"))
    both = F.size(F.array_intersect("u_s", "v_s"))
    # both / union >= a / b, in whole numbers
    enough = both * (a + b) >= a * (F.size("u_s") + F.size("v_s"))
    return close.join(left, "u").join(right, "v").where(enough).select("u", "v")


def _meet(probes: DataFrame, partners: DataFrame) -> DataFrame:
    """(node, other, c) of the pairs that may be similar: `partners` has (h, l) with l the struct (node, n, i, c)."""
    a, b = SIMILAR
    small, large = F.least("n", "l.n"), F.greatest("n", "l.n")
    # the smaller set meets within its index prefix; of equal sets either does
    own = (F.col("n") <= F.col("l.n")) & (F.col("i") < _index_size(F.col("n")))
    its = (F.col("l.n") <= F.col("n")) & (F.col("l.i") < _index_size(F.col("l.n")))
    behind = F.least(F.col("n") - F.col("i"), F.col("l.n") - F.col("l.i")) >= _shared("n", "l.n")
    return probes.join(partners, "h").where((F.col("c") != F.col("l.c")) & (small * b >= large * a) & (own | its) & behind).select(
        "node", F.col("l.node").alias("other")
    )


def anchored(prints: DataFrame, rows: int) -> DataFrame:
    """(u, v): candidate pairs u < v of so many (node, fp) rows: the nearest few fingerprints met at anchors, and equal ones."""
    first = staged(few_files(prints.groupBy("fp").agg(F.min("node").alias("first")), rows), "near-prints")
    spread = first.select("fp").repartition(max(1, -(-first.count() // simhash.NODES_A_TASK)), "fp")
    far = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    best = Window.partitionBy("u").orderBy(far, F.xxhash64("v"))
    met = simhash.leaders(spread, WITHIN).withColumn("at", F.row_number().over(best)).where(F.col("at") <= PARTNERS)
    met = met.join(first.select(F.col("fp").alias("u"), F.col("first").alias("node")), "u")
    met = met.join(first.select(F.col("fp").alias("v"), F.col("first").alias("other")), "v").select("node", "other")
    same = prints.join(first, "fp").where("node <> first").select("node", F.col("first").alias("other"))
    both = met.unionByName(same)
    return both.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v): links of (node, text) rows, as many as join each group of similar sets; `prints` has (node, fp)."""
    shape = "node long, n int, i int, h long"
    sample = texts.where(F.xxhash64("text") % SAMPLE == 0).mapInArrow(_heads(lambda s: s), shape)
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    most = often.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").toPandas()["h"]
    frequent = np.sort(most.to_numpy(np.int64).view(np.uint64))
    free_shuffles(texts.sparkSession)
    every = staged(texts.mapInArrow(_heads(_prefix(frequent)), shape), "near-heads")
    # a shingle says something only if two sets have it, one of them in its index prefix
    index = F.max(F.col("i") < _index_size(F.col("n")))
    repeated = staged(
        every.groupBy("h").agg(F.count(F.lit(1)).alias("c"), index.alias("x")).where("c > 1 and x").select("h"), "near-repeated"
    )
    free_shuffles(texts.sparkSession)
    heads = staged(every.join(repeated.hint("merge"), "h", "left_semi"), "near-prefixes")
    unstage(every)
    unstage(repeated)
    free_shuffles(texts.sparkSession)
    nodes = prints.count()
    sketches = staged(
        _among(texts, heads.select("node"), nodes).mapInArrow(_sketches, f"node long, n int, {', '.join(f'{c} long' for c in _BITS)}"), "near-sketches"
    )

    # first what meets by fingerprint; only nodes that share a shingle have sketches, others are similar to none
    pairs = staged(few_files(anchored(prints, nodes), (PARTNERS + 1) * nodes), "near-anchored")
    free_shuffles(texts.sparkSession)
    found = staged(few_files(_similar(pairs, sketches, texts), pairs.count()), "near-links")
    unstage(pairs)
    free_shuffles(texts.sparkSession)
    now = components(found, "near-components")
    for turn in range(ROUNDS + 1):
        moved = maybe_broadcast(now, now.count())
        places = heads.join(moved, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        one = F.struct("node", "n", "i", "c").alias("l")
        # only shingles that still lie in more than one component
        wide = places.groupBy("h").agg(
            F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by(one, F.xxhash64("node", "h", F.lit(turn))).alias("l")
        ).where("c0 <> c1")
        if turn < ROUNDS:
            met = _meet(places, wide.select("h", "l")).groupBy("node", "other").agg(F.count(F.lit(1)).alias("c"))
            best = Window.partitionBy("node").orderBy(F.desc("c"), F.xxhash64("other", F.lit(turn)))
            met = met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= PARTNERS)
        else:
            open_ = places.join(wide.select("h"), "h", "left_semi")
            met = _meet(open_, open_.select("h", one)).where("node < other")
        pairs = met.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
        # a round has few pairs a node, the last step any number
        pairs = staged(few_files(pairs, PARTNERS * nodes) if turn < ROUNDS else pairs, "near-candidates")
        free_shuffles(texts.sparkSession)
        new = staged(few_files(_similar(pairs, sketches, texts), pairs.count()), "near-links")
        found = found.unionByName(new)
        unstage(pairs)
        free_shuffles(texts.sparkSession)
        if turn < ROUNDS:
            now = components(found, "near-components")
    unstage(heads)
    unstage(sketches)
    return found


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that with the least doc_id, with all its columns.

    Groups are connected through pairs of texts whose sets of five-word shingles have
    Jaccard similarity 0.8 or more; texts without words, null ones included, are alike.
    Rows are told apart by a key of their own: of rows that share a doc_id in a group
    one stays, and a null doc_id stays only where its group has no other.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("_row"))
    own = passing(rows, "near-rows")
    plain = own.select("_row", F.col("row.doc_id").cast("long").alias("_id"), F.col("row.text").cast("string").alias("text"))
    marks = staged(plain.mapInArrow(_marks, "_row long, _id long, _mark long, _fp long"), "near-nodes")
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_row")).alias("first")
    nodes = staged(marks.groupBy("_mark").agg(first, F.min("_fp").alias("fp")), "near-firsts")
    # nodes whose rows are copies of another row drop out; what is left of the texts is read where it lies
    extra = staged(marks.join(nodes.select("first._row"), "_row", "left_anti").select("_row"), "near-copies")
    rest = plain.join(maybe_broadcast(extra, extra.count()), "_row", "left_anti")
    texts = rest.select(F.col("_row").alias("node"), "text")
    reach = components(links(texts, nodes.select(F.col("first._row").alias("node"), "fp")), "near-components")
    groups = nodes.join(reach, F.col("first._row") == F.col("node"), "left").select(
        "first", F.coalesce("component", "first._row").alias("root")
    )
    keep = groups.groupBy("root").agg(F.min("first").alias("first")).select("first._row")
    drop = staged(marks.join(keep, "_row", "left_anti").select("_row"), "near-dropped")
    return own.join(maybe_broadcast(drop, drop.count()), "_row", "left_anti").select("row.*")
