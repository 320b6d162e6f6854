import itertools
import random

import numpy as np
import pytest
from linkgrove import config as cf
from linkgrove.functions import alignment as al
from linkgrove.functions import cigar as cg
from linkgrove.functions import hamming as hm
from linkgrove.functions import taxa
from linkgrove.functions.thresholds import threshold_at, threshold_index, with_thresholds
from pyspark.sql import functions as F


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


# --- configuration ------------------------------------------------------------


def test_threshold_configs():
    t = cf.threshold_uniform(0.0, 0.4, 0.001)
    assert len(t) == 401 and t.top == pytest.approx(0.4)
    assert len(cf.threshold_uniform(0.0, 0.35, 0.001)) == 351
    named = cf.threshold_set({"species": 0.017, "genus": 0.067})
    assert named.names == ("species", "genus") and named.values == (0.017, 0.067)
    assert cf.threshold_set([0.1, 0.1, 0.2]).distinct == (0.1, 0.2)
    assert cf.threshold_config("lookup", [0.1, 0.2], precision=0.01).precision == 0.01
    for bad in (
        lambda: cf.threshold_set([]), lambda: cf.threshold_set([0.2, 0.1]), lambda: cf.threshold_set([-0.1]), lambda: cf.threshold_set([float("nan")]),
        lambda: cf.threshold_uniform(0.2, 0.1, 0.1), lambda: cf.threshold_uniform(0, 1, 0), lambda: cf.threshold_lookup([0.1], 0),
        lambda: cf.threshold_config("no"), lambda: cf.threshold_set([0.1], ["a", "b"]),
    ):
        with pytest.raises(cf.ConfigError):
            bad()


def test_other_configs():
    from dataclasses import replace

    w = cf.Wfa2Distance(gap_open=4)
    assert w.gap_open2 == 4 and w.gap_extend2 == 1 and not w.is_edit and cf.Wfa2Distance().is_edit
    assert replace(w, mismatch=3).mismatch == 3
    assert cf.dist_config("hamming", min_overlap=3).min_overlap == 3
    assert {cf.dist_config(m).method for m in ("wfa2", "edlib", "hybrid", "hamming", "usearch")} == {"wfa2", "edlib", "hybrid", "hamming", "usearch"}
    assert cf.dist_config("file", filename="x").by_name
    assert cf.clust_config("slink").method == "slink" and cf.parallel_config("hierarchical", threads=4, shards=2).shards == 2
    assert cf.prealign_config("kmer", udist_threshold=0.5).udist_threshold == 0.5
    for bad in (
        lambda: cf.Wfa2Distance(match=1), lambda: cf.Wfa2Distance(mismatch=0), lambda: cf.Wfa2Distance(gap_extend=0), lambda: cf.dist_config("x"),
        lambda: cf.clust_config("x"), lambda: cf.clust_config("matrix", fill_method="x"), lambda: cf.parallel_config("merge", threads=0),
        lambda: cf.parallel_config("hierarchical", threads=1, shards=2), lambda: cf.prealign_config("sneaky"), lambda: cf.HammingDistance(-1),
        lambda: cf.HybridDistance(-1), lambda: cf.prealign_config("kmer", udist_threshold=2),
    ):
        with pytest.raises(cf.ConfigError):
            bad()


# --- thresholds ---------------------------------------------------------------


def test_uniform_index(spark):
    t = cf.threshold_uniform(0.0, 0.4, 0.001)
    got = column(spark, [0.118, 0.1, 0.3, -0.1, 0.4005], "double", lambda x: threshold_index(x, t))
    assert got == [118, 100, 300, 0, 401]


def test_set_index(spark):
    t = cf.threshold_set([0.017, 0.067, 0.084, 0.148])
    got = column(spark, [0.118, 0.067, 0.06700000001, 0.0671, 0.149], "double", lambda x: threshold_index(x, t))
    assert got == [3, 1, 1, 2, 4]
    assert column(spark, [-1, 0, 3, 9], "int", lambda x: threshold_at(x, t)) == [0.017, 0.017, 0.148, 0.148]


def test_lookup_index(spark):
    t = cf.threshold_lookup([0.0, 0.1, 0.2], 0.05)
    assert column(spark, [0.02, 0.03, 0.1, 0.12, 0.2, 0.3], "double", lambda x: threshold_index(x, t)) == [0, 1, 1, 1, 2, 3]


def test_repeated_thresholds(spark):
    t = cf.threshold_set([0.1, 0.1, 0.2], ["a", "b", "c"])
    rows = with_thresholds(spark.createDataFrame([(0, 5), (1, 6)], "t_idx int, n int"), t).orderBy("t_order").collect()
    assert [(r.t_name, r.n) for r in rows] == [("a", 5), ("b", 5), ("c", 6)]


# --- CIGAR --------------------------------------------------------------------


def test_cigar_goldens(spark):
    cigars = ["8=2D", "MMXID", "3M2I1D2I4M", "=", "5M", ""]
    assert column(spark, cigars, "string", cg.cigar_distance)[:3] == pytest.approx([0.2, 0.6, 5 / 12])
    assert column(spark, cigars, "string", cg.cigar_distance)[3:] == [0.0, 0.0, None]
    got = [tuple(r) for r in column(spark, cigars[:3], "string", cg.gap_stats)]
    assert got == [(10, 0, 2, 0, 2), (5, 1, 1, 1, 1), (12, 4, 1, 4, 1)]
    assert column(spark, ["8=2D"], "string", lambda x: cg.cigar_distance(x, True)) == [0.0]
    assert tuple(column(spark, ["8=2D"], "string", lambda x: cg.gap_stats(x, True))[0]) == (10, 0, 0, 0, 0)
    df = cg.add_gap_stats(spark.createDataFrame([("8=2D",)], "cigar string"))
    assert df.columns == ["cigar", *cg.GAP_COLUMNS]


# --- Hamming --------------------------------------------------------------------

A, B = "-AAAAACA-GCGT", "AAAAAACCCGCG-"


def hamming(spark, a, b, **settings):
    config = cf.HammingDistance(**settings)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    native = df.select(hm.hamming_distance(F.col("a"), F.col("b"), config)).first()[0]
    grid = hm.encode([a, b])
    kernel = hm.as_distance(*hm.one_to_many(grid[0], grid[1:], config), config)[0]
    assert native == pytest.approx(kernel)
    return native


def test_hamming_goldens(spark):
    assert hamming(spark, A, B) == pytest.approx(1 / 10)
    assert hamming(spark, A, B, ignore_gaps=False) == pytest.approx(2 / 11)
    pad = "ACGT" * 16
    assert hamming(spark, pad + A + pad, pad + B + pad) == pytest.approx(1 / 138)
    assert hamming(spark, pad + A + pad, pad + B + pad, ignore_gaps=False) == pytest.approx(4 / 141)
    assert hamming(spark, A, B, min_overlap=11) == 1.0
    assert hamming(spark, "----", "ACGT") == 1.0
    assert hamming(spark, "ACgggGT", "ACGT") == 0.0


@pytest.mark.parametrize("width", [1, 40, 64, 65, 300])
@pytest.mark.parametrize("ignore_gaps", [True, False])
@pytest.mark.parametrize("overlap", [0, 30])
def test_hamming_planes(width, ignore_gaps, overlap):
    """All pairs by words of bits are those of one sequence after the other, to the last bit of a distance."""
    rng = random.Random(width)
    seqs = ["".join(rng.choice("ACGT-N") for _ in range(width)) for _ in range(30)] + ["-" * width, "A" * width]
    seqs += [s[: width // 2] + "-" * (width - width // 2) for s in seqs[:5]] + ["-" * (width - width // 2) + s[: width // 2] for s in seqs[:5]]
    config = cf.HammingDistance(min_overlap=overlap, ignore_gaps=ignore_gaps)
    grid = hm.encode(seqs)
    bits = hm.planes(grid)
    for t in (0.0, 0.5, 0.7, 1.0, 1.5, -0.1):
        want = {}
        for a in range(len(seqs)):
            wrong, compared = hm.one_to_many(grid[a], grid, config)
            dist = hm.as_distance(wrong, compared, config)
            want |= {(a, b): (wrong[b], compared[b]) for b in np.flatnonzero((dist <= t) & (compared > 0))}
        for inside in (True, False):
            got = {}
            for i, j, wrong, compared in hm.near_pairs(bits, bits, t, config, 100, inside):
                got |= dict(zip(zip(i.tolist(), j.tolist(), strict=True), zip(wrong, compared, strict=True), strict=True))
            assert got == {(a, b): v for (a, b), v in want.items() if a < b or not inside}


def test_hamming_details():
    grid = hm.encode(["AC--GTA", "ACGGG-A"])
    assert hm.gap_details(grid[0], grid[1]) == (7, 2, 1, 2, 1)
    with pytest.raises(ValueError):
        hm.encode(["AC", "A"])


def test_check_aligned(spark):
    hm.check_aligned(spark.createDataFrame([("AC",), ("A-",), ("AaC",)], "seq string"))
    with pytest.raises(ValueError):
        hm.check_aligned(spark.createDataFrame([("AC",), ("A",)], "seq string"))


# --- alignment --------------------------------------------------------------------

EDIT = cf.EdlibDistance()
WFA = cf.Wfa2Distance()


def test_alignment_goldens():
    a, b = "AAACGCGTCG", "AAACGCGT"
    assert al.distances([a], [b], WFA)[0] == pytest.approx(0.2)
    assert al.distances([a], [b], EDIT)[0] == pytest.approx(0.2)
    assert al.distances([a], [b], WFA, "extension")[0] == 0
    assert al.distances([b], [a], EDIT, "extension")[0] == 0
    assert al.distances([a], [b], EDIT, "extension")[0] > 0
    assert al.cigar(a, b, WFA) == "8M2D"
    assert al.cigar("ACGT", "ACGT", EDIT) == "MMMM"
    assert al.distances(["AB"], ["BA"], WFA)[0] == pytest.approx(2 / 3)
    assert al.distances([""], [""], WFA)[0] == 0
    assert al.distances([""], ["AC"], WFA)[0] == 1
    assert al.gapped("ACGT", "AGT", WFA) in (("ACGT", "A-GT"),)
    with pytest.raises(ValueError):
        al.free_ends(WFA, "no")


def every_alignment(a, b):
    """All alignments as strings of operations."""
    if not a and not b:
        yield ""
        return
    if a and b:
        for rest in every_alignment(a[1:], b[1:]):
            yield ("M" if a[0] == b[0] else "X") + rest
    if a:
        for rest in every_alignment(a[1:], b):
            yield "D" + rest
    if b:
        for rest in every_alignment(a, b[1:]):
            yield "I" + rest


def cost_of(ops, s):
    total = 0
    for op, run in itertools.groupby(ops):
        k = len(list(run))
        if op in "ID":
            total += min(s.gap_open + k * s.gap_extend, s.gap_open2 + k * s.gap_extend2)
        else:
            total += k * (s.match if op == "M" else s.mismatch)
    return total


@pytest.mark.parametrize(
    "scores",
    [WFA, cf.Wfa2Distance(0, 2, 3, 1), cf.Wfa2Distance(-1, 2, 4, 1), cf.Wfa2Distance(0, 4, 6, 2, 9, 1), cf.Wfa2Distance(0, 1, 0, 3)],
)
def test_best_alignment_by_enumeration(scores):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("AC") for _ in range(rng.randrange(6))), "".join(rng.choice("AC") for _ in range(rng.randrange(6)))) for _ in range(40)]
    cost, length, matches = al.align_batch([p[0] for p in pairs], [p[1] for p in pairs], scores)
    for (a, b), c, n, m in zip(pairs, cost, length, matches, strict=True):
        best = min((cost_of(o, scores), -len(o), -o.count("M")) for o in every_alignment(a, b))
        assert (c, -n, -m) == best
        ops = al.operations(a, b, scores)
        assert (cost_of(ops, scores), -len(ops), -ops.count("M")) == best


def test_extension_by_enumeration():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        for free in ("second", "both"):
            ends = [(len(a), j) for j in range(len(b) + 1)]
            if free == "both":
                ends += [(i, len(b)) for i in range(len(a) + 1)]
            best = min((cost_of(o, WFA), -len(o), -o.count("M")) for i, j in ends for o in every_alignment(a[:i], b[:j]))
            cost, length, matches = al.align_batch([a], [b], WFA, free)
            assert (cost[0], -length[0], -matches[0]) == best
            ops = al.operations(a, b, WFA, free)
            body = ops.rstrip("I") if free == "second" else ops
            assert ops.count("M") == -best[2] and len(body) >= -best[1] - ops.count("I")
            assert sum(o != "I" for o in ops) == len(a) and sum(o != "D" for o in ops) == len(b)


def test_alignment_columns(spark):
    df = spark.createDataFrame([("AAACGCGTCG", "AAACGCGT"), (None, "A")], "a string, b string")
    rows = df.select(al.align(WFA)("a", "b").alias("d"), al.cigars(WFA)("a", "b").alias("c"), al.pairwise_alignment(WFA)("a", "b").alias("g")).collect()
    assert rows[0].d == pytest.approx(0.2) and rows[0].c == "8M2D" and tuple(rows[0].g) == ("AAACGCGTCG", "AAACGCGT--")
    assert rows[1].d is None and rows[1].c is None


def test_bounds_are_safe(spark):
    """No pair within a threshold is ruled out by length or by the edit bound."""
    rng = random.Random(5)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", al.edit_bound(F.length("a"), F.length("b"), 0.3).alias("k"), al.length_compatible(F.length("a"), F.length("b"), 0.3).alias("ok")).collect()
    dist = al.distances([r.a for r in rows], [r.b for r in rows], WFA)
    cost, _, _ = al.align_batch([r.a for r in rows], [r.b for r in rows], WFA)
    near = np.array(dist) <= 0.3
    assert near.any() and all(r.ok and c <= r.k for r, c, n in zip(rows, cost, near, strict=True) if n)


# --- taxa -------------------------------------------------------------------------


def test_placeholders(spark):
    names = [
        "Mortierella_sp", "Fungi sp. 123", "Inocybe_spA", "Xus Sp9", "Ascomycota_gen_Incertae_sedis", "Uncultured fungus", "unknown", None,
        "nonea lutea", "Russula spectabilis", "Agaricus bisporus",
    ]
    assert column(spark, names, "string", taxa.is_placeholder) == [True] * 9 + [False] * 2


def test_clean_taxonomy(spark):
    df = spark.createDataFrame([("a", "Fungi", "unknown"), ("b", None, "Asco")], "seq_id string, kingdom string, phylum string")
    assert [tuple(r) for r in taxa.clean_taxonomy(df, ("kingdom", "phylum")).orderBy("seq_id").collect()] == [("a", "Fungi", None), ("b", None, "Asco")]
    with pytest.raises(ValueError):
        taxa.clean_taxonomy(df, ("kingdom", "class"))


def test_ranks(spark):
    assert taxa.superranks("class") == ["kingdom", "phylum"] and taxa.subranks("family") == ["genus", "species"]
    assert column(spark, ["species", "kingdom", "x"], "string", taxa.rank_order) == [1, 7, None]
    with pytest.raises(ValueError):
        taxa.superranks("x")


@pytest.mark.parametrize(
    "given,expect",
    [([3.0, 10.0], [0.03, 0.10]), ([97.0, 99.0], [0.03, 0.01]), ([0.97, 0.6], [0.03, 0.4]), ([0.03, 0.2], [0.03, 0.2]), ([0.4, 60.0], [0.996, 0.4])],
)
def test_threshold_units(spark, given, expect):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*given, None])], "k int, t double")
    got = [r.t for r in taxa.threshold_as_dist(df, "t").orderBy("k").collect()]
    assert got[:-1] == pytest.approx(expect) and got[-1] is None


def test_strict_median(spark):
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4)) for v in range(1, n + 1)] + [("e", None)]
    got = {r.g: r.v for r in taxa.strict_median(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 2}


def test_names(spark):
    assert taxa.make_seq_names(9, "ASV")[0] == "ASV1"
    assert taxa.make_seq_names(10, "ASV")[0] == "ASV01" and taxa.make_seq_names(10, "ASV")[-1] == "ASV10"
    assert taxa.make_seq_names(100, "ASV")[0] == "ASV001"
    assert column(spark, [0, 9], "long", lambda x: taxa.numbered_names(x, F.lit(10), "ASV")) == ["ASV01", "ASV10"]
    assert column(spark, ["AC", "ACGT"], "string", lambda x: taxa.pad_strings(x, 4)) == ["ACXX", "ACGT"]
