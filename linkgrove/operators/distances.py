"""Pair generation and the distance relations of sequence sets.

All pairs are made by tiles: sequences are dealt to groups, and each pair of groups is
one task that compares them block by block, so a task holds two groups of bounded size
and pairs leave it only if they are within the threshold. A sequence is sent once for
each group, not for each block. Where lengths alone rule a pair out, groups are runs in
the order of length, and pairs of groups that no length allows are never made.

Kernels that need nanoseconds for a pair take `tiles`: a group is packed into one row and
shuffled once, and a product of these rows reads it again for every tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkgrove.config import FileDistance, HammingDistance, Prefilter, Wfa2Distance
from linkgrove.functions import alignment as al
from linkgrove.functions import hamming as hm
from linkgrove.sources import distances as files
from linkgrove.sources.sequences import indexed, with_index
from linkgrove.storage import staged

#: Sequences that a task compares at once with others; the least size of a group.
BLOCK = 512
#: Pairs of groups that are made if groups stay between BLOCK and the most sequences that a task holds twice.
TILES, MOST = 4096, 16_384
#: Pairs of groups of the fast kernels.
FAST_TILES = 300
#: Least tasks that these are dealt to, if there are as many.
TASKS = 96
#: Pairs that a fast kernel holds at once, and rows of a batch that leaves it.
CELLS, ROWS = 65_536, 100_000
#: Nanoseconds for a pair of sequences that share a k-mer by a list, and for a bit of any pair by words of 64 bits.
LISTED, BIT = 10, 0.04
#: Pairs that the alignment kernel takes at once.
BATCH = 2048
DETAILS = ("none", "gapstats", "cigar")
_BASE = "seq_idx1 long, seq_idx2 long, score1 double, score2 double, dist1 double, dist2 double"
_MORE = {
    "none": "",
    "gapstats": ", align_length int, n_insert int, n_delete int, max_insert int, max_delete int",
    "cigar": ", cigar string",
}


def kmers(seq: Column, k: int = 8) -> Column:
    """Array of the k-mers over A, C, G, T in order; other letters end a run."""
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: seq.substr(i, F.lit(k))), lambda x: x.rlike("^[ACGT]+$"))


def kmer_pairs(seqs: DataFrame, udist_threshold: float, k: int = 8, presence: bool = False) -> DataFrame:
    """(seq_idx1, seq_idx2, udist): pairs with 1 - shared/possible k-mers within the threshold.

    A k-mer counts as often as both sequences have it; `presence` counts it once. The
    possible number is that of the shorter sequence, of the larger distinct set with
    `presence`. Pairs share one k-mer at least. They are counted tile by tile, so that only
    those within the threshold are ever rows, however many sequences share a k-mer.
    """
    own = seqs.where(F.length("seq") >= k).select("seq_idx", "seq")
    schema = "seq_idx1 long, seq_idx2 long, udist double"
    return tiles(own).mapInArrow(on_tiles(_shared_kmers(udist_threshold, k, presence), schema), schema)


def _tokens(seqs: list[str], k: int, presence: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, key) of every k-mer over A, C, G, T; a key is the k-mer's letters and which of its repeats it is.

    Numbers of one call can be compared with each other only.
    """
    text = np.frombuffer("\n".join(seqs).encode("ascii", "replace") + b"\n", np.uint8)
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    letters = code[text]
    n = max(0, len(text) - k + 1)
    valid = np.convolve(letters < 0, np.ones(k, np.int64))[k - 1 : k - 1 + n] == 0
    at = np.flatnonzero(valid)
    key = np.zeros(len(at), np.int64)
    for done in range(0, k, 15):  # a number below the k-mers there are, then 15 letters
        for i in range(done, min(k, done + 15)):
            key = key * 4 + letters[at + i]
        key = np.unique(key, return_inverse=True)[1]
    seq = (np.cumsum(text == 10) - (text == 10))[at]
    order = np.lexsort((key, seq))
    seq, key = seq[order], key[order]
    new = np.ones(len(seq), bool)
    new[1:] = (seq[1:] != seq[:-1]) | (key[1:] != key[:-1])
    if presence:
        return seq[new], key[new]
    start = np.flatnonzero(new)
    repeat = np.arange(len(seq)) - np.repeat(start, np.diff(np.append(start, len(seq))))
    return seq, np.unique(key + (key.max(initial=0) + 1) * repeat, return_inverse=True)[1]


def _shared_kmers(udist_threshold: float, k: int, presence: bool):
    def run(one: pa.Table, two: pa.Table | None) -> Iterator[tuple]:
        ids = [t.column("seq_idx").to_numpy() for t in (one, two or one)]
        texts = [t.column("seq").to_pylist() for t in (one, two) if t is not None]
        na, nb = len(ids[0]), len(ids[1])
        seq, key = _tokens([s for t in texts for s in t], k, presence)
        total = int(key.max(initial=-1)) + 1
        left = seq < na
        right = left if two is None else ~left
        a, ka, b, kb = seq[left], key[left], seq[right] - (0 if two is None else na), key[right]
        if presence:
            size = np.bincount(a, minlength=na), np.bincount(b, minlength=nb)
        else:
            length = [np.array([len(s) for s in t], np.int64) for t in texts]
            size = length[0] - (k - 1), length[-1] - (k - 1)
        fa, fb = np.bincount(ka, minlength=total), np.bincount(kb, minlength=total)
        # many pairs share a frequent k-mer, which is a bit of every sequence; a rare one lists its sequences
        dense = fa * fb * LISTED > na * nb * BIT
        place = np.cumsum(dense) - 1
        words = -(-int(dense.sum()) // 64)

        def bits(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros((words, n), np.uint64)
            own = dense[keys]
            at = place[keys[own]]
            np.bitwise_or.at(out, (at // 64, rows[own]), np.uint64(1) << (at % 64).astype(np.uint64))
            return out

        wa, wb = bits(a, ka, na), bits(b, kb, nb)
        order = np.argsort(kb, kind="stable")
        lists, begin = b[order], np.cumsum(fb) - fb
        rare = ~dense[ka] & (fb[ka] > 0)
        ra, rk = a[rare], ka[rare]
        step = max(1, CELLS // max(1, nb))
        kind = np.uint8 if np.bincount(a, minlength=1).max() < 256 else np.uint32
        # the fewest that a sequence of this size needs, less a hair; pairs that have them are compared exactly
        need = [np.clip(np.floor((1 - udist_threshold) * n - 1e-9), 1, np.iinfo(kind).max).astype(kind) for n in size]
        pick = np.maximum if presence else np.minimum
        shared_, both_, few_ = (np.empty((min(step, na), nb), t) for t in (kind, np.uint64, np.uint8))
        for lo in range(0, na, step):
            hi = min(na, lo + step)
            shared, both, few = shared_[: hi - lo], both_[: hi - lo], few_[: hi - lo]
            shared[:] = 0
            for w in range(words):
                np.bitwise_and(wa[w, lo:hi, None], wb[w], out=both)
                np.bitwise_count(both, out=few)
                np.add(shared, few, out=shared)
            x, y = np.searchsorted(ra, (lo, hi))
            cuts = x + 1 + np.flatnonzero(np.diff(np.cumsum(fb[rk[x:y]]) // ROWS))
            for p, q in pairwise((x, *cuts, y)):  # lists of some ROWS places at once
                n = fb[rk[p:q]]
                places = lists[np.repeat(begin[rk[p:q]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                shared += np.bincount(np.repeat((ra[p:q] - lo) * nb, n) + places, minlength=shared.size).reshape(shared.shape).astype(kind)
            i, j = np.divmod(np.flatnonzero(shared >= pick(need[0][lo:hi, None], need[1])), nb)
            if two is None:
                i, j = i[lo + i < j], j[lo + i < j]
            udist = 1 - shared[i, j] / pick(size[0][lo + i], size[1][j])
            near = udist <= udist_threshold
            yield (*in_order(ids[0][lo + i[near]], ids[1][j[near]]), udist[near])

    return run


def in_order(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(one, two), np.maximum(one, two)


def group_size(rows: int, block: int = BLOCK, pairs: int = TILES) -> int:
    """Sequences of a group, so that about so many pairs of groups arise."""
    return max(block, min(MOST, math.ceil(rows / math.sqrt(2 * pairs))))


def _packed(df: DataFrame, block: int, key: str) -> tuple[DataFrame, int]:
    """(at, rows): each group's rows, as Arrow, in one row; and how many groups there are."""
    n = max(1, -(-(rows := df.count()) // group_size(rows, block, FAST_TILES)))
    names = df.columns

    def pack(table: pa.Table) -> pa.Table:
        own = table.select(names).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        return pa.table({"at": table.column("at")[:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = df.withColumn("at", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    return dealt.groupBy("at").applyInArrow(pack, "at int, rows binary").repartition(n), n


def tiles(left: DataFrame, right: DataFrame | None = None, block: int = BLOCK, key: str = "seq_idx") -> DataFrame:
    """(lo, one, hi, two): every pair of groups of one or two sets, for on_tiles.

    Rows are shuffled once, in their group; the product reads each group again for each
    task and writes nothing.
    """
    a, na = _packed(left, block, key)
    b, nb = (a, na) if right is None else _packed(right, block, key)
    one = a.select(F.col("at").alias("lo"), F.col("rows").alias("one")).hint("shuffle_replicate_nl")
    two = b.select(F.col("at").alias("hi"), F.col("rows").alias("two"))
    pairs = one.join(two, F.col("lo") <= F.col("hi")) if right is None else one.crossJoin(two.withColumn("hi", F.lit(-1)))
    # a task starts Python, which takes longer than a small tile
    return pairs.coalesce(max(TASKS, na * nb // 6))


def on_tiles(kernel: Callable[[pa.Table, pa.Table | None], Iterator[tuple]], schema: str):
    """A function for mapInArrow over `tiles`; the kernel gives columns, without the second table for a group with itself.

    Batches leave as they fill, so no task holds all pairs of its tile.
    """

    names = [c.split()[0] for c in schema.split(", ")]

    def table(value) -> pa.Table:
        return pa.ipc.open_stream(value.as_buffer()).read_all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, one, hi, two in zip(*(batch.column(c) for c in ("lo", "one", "hi", "two")), strict=True):
                held: list[tuple] = []
                for columns in kernel(table(one), None if lo == hi else table(two)):
                    if len(columns[0]):
                        held.append(columns)
                    if sum(len(c[0]) for c in held) >= ROWS:
                        yield _joined(held, names)
                        held = []
                if held:
                    yield _joined(held, names)

    return run


def _joined(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*held, strict=True)]
    return pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def block_pairs(seqs: DataFrame, block: int = BLOCK, shorter: float | None = None) -> DataFrame:
    """(lo, hi, block, seq_idx, seq): every group once for each pair of groups that it is part of.

    With `shorter`, groups are runs in the order of length, and pairs of groups are left
    out whose longest shorter sequence is under that share of the shortest longer one.
    """
    rows = seqs.count()
    size = group_size(rows, block)
    n = max(1, -(-rows // size))
    if shorter is None or n == 1:
        own = seqs.select((F.col("seq_idx") % n).cast("int").alias("block"), "seq_idx", "seq")
        other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return own.select("*", other.alias("_other")).select(
            F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "seq_idx", "seq"
        )
    sized = seqs.select("seq_idx", "seq", F.length("seq").alias("_length"))
    own = staged(
        with_index(sized, ["_length", "seq_idx"], "_place").withColumn("block", F.floor(F.col("_place") / size).cast("int")), "length-groups"
    )
    # a row a group; a group is at most TILES' square root or rows / MOST in number
    ends = own.groupBy("block").agg(F.min("_length").alias("least"), F.max("_length").alias("most")).orderBy("block").collect()
    allowed = [(x.block, y.block) for k, x in enumerate(ends) for y in ends[k:] if x.most >= shorter * y.least - 1e-9]
    tiles = seqs.sparkSession.createDataFrame(
        [(lo, hi, b) for lo, hi in allowed for b in {lo, hi}], "lo int, hi int, block int"
    )
    return own.join(F.broadcast(tiles), "block").select("lo", "hi", "block", "seq_idx", "seq")


def _columns(details: str) -> list[str]:
    return [c.split()[0] for c in (_BASE + _MORE[details]).split(", ")]


def _types(details: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return [kinds[c.split()[1]] for c in (_BASE + _MORE[details]).split(", ")]


class Kernel:
    """Scores pairs of sequences under one distance; used by pair, search and cluster tasks."""

    def __init__(self, config, threshold: float, span: str = "global", details: str = "none", constrain: bool = True):
        if details not in DETAILS:
            raise ValueError(f"unknown details {details!r}")
        self.config, self.threshold, self.span, self.details = config, threshold, span, details
        self.constrain = constrain

    def by_length(self) -> bool:
        """Whether lengths rule pairs out."""
        return self.span == "global" and self.constrain and not isinstance(self.config, HammingDistance)

    def possible(self, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Whether lengths leave the pair a chance."""
        if not self.by_length():
            return np.ones(len(la), bool)
        return np.minimum(la, lb) >= (1 - self.threshold) * np.maximum(la, lb) - 1e-12

    def rows(self, a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """(distances, scores, details) of pairs, the shorter sequence first."""
        flip = [len(x) > len(y) for x, y in zip(a, b, strict=True)]
        first = [y if f else x for x, y, f in zip(a, b, flip, strict=True)]
        second = [x if f else y for x, y, f in zip(a, b, flip, strict=True)]
        free = al.free_ends(self.config, self.span)
        cost, length, matches = al.align_batch(first, second, al.scores_of(self.config), free)
        dist = np.where(length > 0, (length - matches) / np.maximum(length, 1), 0.0)
        return dist, cost.astype(np.float64), list(zip(first, second, strict=True))

    def more(self, pair: tuple[str, str]) -> tuple:
        if self.details == "none":
            return ()
        if self.details == "cigar":
            return (al.cigar(*pair, self.config, self.span),)
        ops = al.operations(*pair, al.scores_of(self.config), al.free_ends(self.config, self.span))
        return al.gap_details(ops, self.span != "global")

    def compare(self, left: tuple[np.ndarray, list[str]], right: tuple[np.ndarray, list[str]] | None) -> Iterator[tuple]:
        """Rows of pairs within the threshold, inside `left` or between both."""
        ia, a = left
        ib, b = right or left
        la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        for at in range(len(a)):
            others = np.arange(at + 1, len(b)) if right is None else np.arange(len(b))
            others = others[self.possible(np.full(len(others), la[at]), lb[others])]
            for k in range(0, len(others), BATCH):
                own = others[k : k + BATCH]
                dist, score, pairs = self.rows([a[at]] * len(own), [b[j] for j in own])
                for m in np.flatnonzero(dist <= self.threshold):
                    lo, hi = sorted((int(ia[at]), int(ib[own[m]])))
                    d, s = float(dist[m]), float(score[m])
                    yield (lo, hi, s, s, d, d, *self.more(pairs[m]))


def _hamming(config: HammingDistance, threshold: float, details: str):
    types = _types(details)

    def run(one: pa.Table, two: pa.Table | None) -> Iterator[tuple]:
        parts = [t for t in (one, two) if t is not None]
        ids = [t.column("seq_idx").to_numpy() for t in parts]
        grid = hm.encode([s for t in parts for s in t.column("seq").to_pylist()])
        bits = hm.planes(grid)
        left, right = bits[:, :, : len(one)], bits if two is None else bits[:, :, len(one) :]
        grids = grid[: len(one)], grid if two is None else grid[len(one) :]
        for i, j, wrong, compared in hm.near_pairs(left, right, threshold, config, CELLS, two is None):
            lo, hi = in_order(ids[0][i], ids[-1][j])
            score, dist = wrong.astype(np.float64), hm.as_distance(wrong, compared, config)
            more: list = []
            if details == "gapstats":
                found = [
                    hm.gap_details(*((grids[0][a], grids[1][b]) if ids[0][a] <= ids[-1][b] else (grids[1][b], grids[0][a])))
                    for a, b in zip(i, j, strict=True)
                ]
                more = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types[6:], strict=True)] if found else [pa.array([], t) for t in types[6:]]
            elif details == "cigar":
                more = [pa.nulls(len(lo), pa.string())]
            yield (lo, hi, score, score, dist, dist, *more)

    return run


def _group(kernel: Kernel):
    names, types = _columns(kernel.details), _types(kernel.details)

    def run(table: pa.Table) -> pa.Table:
        block, idx = table.column("block").to_numpy(), table.column("seq_idx").to_numpy()
        seqs = table.column("seq").to_pylist()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()

        def side(b: int):
            at = np.flatnonzero(block == b)
            return idx[at], [seqs[i] for i in at]

        rows = list(kernel.compare(side(lo), None if lo == hi else side(hi)))
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def seq_distmx(
    seqs: DataFrame,
    threshold: float,
    config=None,
    details: str = "none",
    span: str = "global",
    constrain: bool = True,
    by_index: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Pairs of the set with dist2 <= threshold, the lower place first.

    Columns: seq_id1, seq_id2 (or seq_idx1, seq_idx2), score1, score2, dist1, dist2 and
    those of `details`: gapstats (align_length, n_insert, n_delete, max_insert,
    max_delete) or cigar, both relative to the shorter sequence.
    """
    config = config if config is not None else Wfa2Distance()
    numbered = indexed(seqs)
    if isinstance(config, FileDistance):
        found = files.file_pairs(seqs.sparkSession, config, numbered, threshold)
    else:
        kernel = Kernel(config, threshold, span, details, constrain)
        schema = _BASE + _MORE[details]
        if isinstance(config, HammingDistance):
            found = tiles(numbered.select("seq_idx", "seq"), block=block).mapInArrow(on_tiles(_hamming(config, threshold, details), schema), schema)
            return found if by_index else with_names(found, numbered)
        shorter = 1 - threshold if kernel.by_length() else None
        blocks = block_pairs(numbered, block, shorter)
        found = blocks.groupBy("lo", "hi").applyInArrow(_group(kernel), schema)
    return found if by_index else with_names(found, numbered)


def with_names(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    one = seqs.select(F.col("seq_idx").alias("seq_idx1"), F.col("seq_id").alias("seq_id1"))
    two = seqs.select(F.col("seq_idx").alias("seq_idx2"), F.col("seq_id").alias("seq_id2"))
    rest = [c for c in pairs.columns if c not in ("seq_idx1", "seq_idx2")]
    return pairs.join(one, "seq_idx1").join(two, "seq_idx2").select("seq_id1", "seq_id2", *rest)


def _score_candidates(kernel: Kernel):
    names, types = _columns(kernel.details), _types(kernel.details)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for k in range(0, len(a), BATCH):
                dist, score, pairs = kernel.rows(a[k : k + BATCH], b[k : k + BATCH])
                rows += [
                    (int(i[k + m]), int(j[k + m]), float(score[m]), float(score[m]), float(dist[m]), float(dist[m]), *kernel.more(pairs[m]))
                    for m in np.flatnonzero(dist <= kernel.threshold)
                ]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def score_pairs(candidates: DataFrame, seqs: DataFrame, config, threshold: float, details: str = "none", span: str = "global") -> DataFrame:
    """Align candidate pairs (seq_idx1, seq_idx2) and keep those within the threshold."""
    one = seqs.select(F.col("seq_idx").alias("seq_idx1"), F.col("seq").alias("_a"))
    two = seqs.select(F.col("seq_idx").alias("seq_idx2"), F.col("seq").alias("_b"))
    joined = candidates.join(one, "seq_idx1").join(two, "seq_idx2").select("seq_idx1", "seq_idx2", "_a", "_b")
    return joined.mapInArrow(_score_candidates(Kernel(config, threshold, span, details)), _BASE + _MORE[details])


def seq_distmx_kmer(seqs: DataFrame, threshold: float, udist_threshold: float, config=None, details: str = "none") -> DataFrame:
    """Pairs by shared 8-mers first, then alignment."""
    numbered = indexed(seqs)
    found = score_pairs(kmer_pairs(numbered, udist_threshold), numbered, config or Wfa2Distance(), threshold, details)
    return with_names(found, numbered)


def length_pairs(seqs: DataFrame, threshold: float) -> DataFrame:
    """(seq_idx1, seq_idx2, a, b): pairs whose lengths are compatible with a global distance.

    Lengths are cut into classes of one ratio 1 - threshold, so compatible lengths are
    in one class or neighbouring ones: an equi-join on the class, then the exact test.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    cls = F.floor(F.log(F.greatest(F.length("seq"), F.lit(1))) / F.log(F.lit(1 / (1 - threshold)))).cast("int")
    one = seqs.select(F.col("seq_idx").alias("i"), F.col("seq").alias("a"), cls.alias("c"))
    two = seqs.select(F.col("seq_idx").alias("j"), F.col("seq").alias("b"), F.explode(F.array(cls - 1, cls, cls + 1)).alias("c"))
    pairs = one.join(two, "c").where("i < j").where(al.length_compatible(F.length("a"), F.length("b"), threshold))
    return pairs.select(F.col("i").alias("seq_idx1"), F.col("j").alias("seq_idx2"), "a", "b")


def prefilter(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of length_pairs whose edit distance leaves a distance within the threshold possible, natively."""
    bound = al.edit_bound(F.length("a"), F.length("b"), threshold)
    # the bounded form stops as soon as the bound is passed and gives -1
    near = pairs.withColumn("_bound", bound.cast("int")).withColumn("edits", F.expr("levenshtein(a, b, _bound)"))
    return near.where(F.col("edits") >= 0).drop("_bound")


def seq_distmx_prealign(
    seqs: DataFrame, threshold: float, config=None, filter_config: Prefilter | None = None, counts: Observation | None = None
) -> DataFrame:
    """Two stages: a cheap prefilter on the JVM, alignment of what is left.

    score1 is the edit distance, dist1 the least distance it allows. `counts`, if given,
    observes how many pairs were aligned.
    """
    config, filter_config = config or Wfa2Distance(), filter_config or Prefilter()
    numbered = indexed(seqs)
    if filter_config.method == "kmer":
        near = kmer_pairs(numbered, filter_config.udist_threshold)
        return with_names(score_pairs(near, numbered, config, threshold), numbered)
    near = prefilter(length_pairs(numbered, threshold), threshold)
    if counts is not None:
        near = near.observe(counts, F.count(F.lit(1)).alias("aligned"))
    total = F.length("a") + F.length("b")
    first = near.select("seq_idx1", "seq_idx2", F.col("edits").cast("double").alias("_e"), (F.col("edits") * (2 - threshold) / total).alias("_d"))
    found = score_pairs(first, numbered, config, threshold).drop("score1", "dist1")
    joined = found.join(first, ["seq_idx1", "seq_idx2"])
    out = joined.select("seq_idx1", "seq_idx2", F.col("_e").alias("score1"), "score2", F.col("_d").alias("dist1"), "dist2")
    return with_names(out, numbered)


def seq_distmx_hamming(seqs: DataFrame, threshold: float, min_overlap: int = 0, ignore_gaps: bool = False, details: str = "none") -> DataFrame:
    return seq_distmx(seqs, threshold, HammingDistance(min_overlap, ignore_gaps), details)


def seq_distmx_edlib(seqs: DataFrame, threshold: float, details: str = "none", span: str = "global", constrain: bool = True) -> DataFrame:
    from linkgrove.config import EdlibDistance

    return seq_distmx(seqs, threshold, EdlibDistance(), details, span, constrain)


def seq_distmx_wfa2(
    seqs: DataFrame, threshold: float, match: int = -1, mismatch: int = 2, gap_open: int = 10, gap_extend: int = 1,
    gap_open2: int | None = None, gap_extend2: int | None = None, details: str = "none", span: str = "global",
) -> DataFrame:
    config = Wfa2Distance(match, mismatch, gap_open, gap_extend, gap_open2, gap_extend2)
    return seq_distmx(seqs, threshold, config, details, span)
