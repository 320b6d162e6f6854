import itertools
import math
import random

import numpy as np
import pytest
from linkgrove import config as cf
from linkgrove.functions import hamming as hm
from linkgrove.functions.alignment import distances
from linkgrove.operators import distances as dm
from linkgrove.operators import linkage, metrics, ranks, search
from linkgrove.plans import assign, optimize
from linkgrove.plans.clusters import seq_cluster
from linkgrove.sources import distances as files
from linkgrove.sources import external
from linkgrove.sources import sequences as sq
from linkgrove.streaming.forest import ForestStream
from pyspark.sql import functions as F

# --- linkage --------------------------------------------------------------------


def brute(pairs, objects, thresholds):
    """Labels by transitive closure at each threshold."""
    out = {}
    for t, limit in enumerate(thresholds):
        label = {o: o for o in objects}
        changed = True
        while changed:
            changed = False
            for i, j, d in pairs:
                if i in label and j in label and d <= limit + 1e-8:
                    low = min(label[i], label[j])
                    if label[i] != low or label[j] != low:
                        label[i] = label[j] = low
                        changed = True
        out.update({(t, o): k for o, k in label.items()})
    return out


@pytest.fixture(scope="module")
def points():
    rng = random.Random(11)
    centres = [(rng.random() * 3, rng.random() * 3) for _ in range(5)]
    spots = [(x + rng.gauss(0, 0.3), y + rng.gauss(0, 0.3)) for x, y in centres for _ in range(5)]
    rows = [(i, i, 0.0) for i in range(25)]
    for i, j in itertools.combinations(range(25), 2):
        d = round(math.dist(spots[i], spots[j]) * 20) / 20
        if d <= 1:
            rows.append((j, i, d) if rng.random() < 0.5 else (i, j, d))
    return rows + rng.sample(rows, 20)


CONFIGS = [
    cf.threshold_uniform(0.0, 1.0, 0.05),
    cf.threshold_set([i / 20 for i in range(21)]),
    cf.threshold_lookup([i / 20 for i in range(21)], 0.05),
]


@pytest.mark.parametrize("thresholds", CONFIGS, ids=lambda t: t.kind)
@pytest.mark.parametrize("seed", range(2))
def test_clusters_in_any_order(spark, points, thresholds, seed):
    rows = list(points)
    random.Random(seed).shuffle(rows)
    pairs = spark.createDataFrame(rows, "id1 long, id2 long, dist double").repartition(1 + 4 * seed)
    objects = spark.range(25).withColumnRenamed("id", "obj")
    expect = brute(points, range(25), thresholds.values)
    got = linkage.cluster(pairs, objects, thresholds, method=cf.clust_config("slink"), parallel=cf.parallel_config("merge", threads=2))
    assert {(r.t_idx, r.obj): r.cluster for r in got.collect()} == expect


def test_no_task_needs_the_forest(spark, points):
    t = cf.threshold_set([0.1, 0.3, 0.5])
    pairs, objects = spark.createDataFrame(points, "id1 long, id2 long, dist double"), spark.range(25).withColumnRenamed("id", "obj")
    got = linkage.cluster(pairs, objects, t, forest_pairs=3)
    assert {(r.t_idx, r.obj): r.cluster for r in got.collect()} == brute(points, range(25), t.values)


@pytest.mark.parametrize("forest_pairs", [None, 0])
def test_wide_ids_and_subsets(spark, points, forest_pairs):
    """Ids and subset numbers near the ends of a long give the clusters that small ones give, on either path."""
    t = cf.threshold_set([0.2, 0.4])
    far, part = 2**61, 2**40
    pairs = spark.createDataFrame([(i + far, j + far, d) for i, j, d in points], "id1 long, id2 long, dist double")
    objects = spark.range(25).select((F.col("id") + far).alias("obj"))
    members = objects.crossJoin(spark.createDataFrame([(part,), (-part,), (3,)], "subset long")).where("subset <> 3 or obj % 2 = 0")
    got = linkage.cluster(pairs, objects, t, members, forest_pairs=forest_pairs).collect()
    whole = brute(points, range(25), t.values)
    for s, own in ((part, range(25)), (-part, range(25)), (3, range(0, 25, 2))):
        expect = whole if s != 3 else brute(points, own, t.values)
        assert {(r.t_idx, r.obj - far): r.cluster - far for r in got if r.subset == s} == expect


def test_sweep_hands_out_changes():
    """With 401 thresholds a sweep gives rows for label changes, not for thresholds times objects."""
    rng = np.random.default_rng(4)
    n, count = 3000, 401
    j = np.arange(1, n)
    i = (rng.random(n - 1) * j).astype(np.int64)
    t = rng.integers(0, count, n - 1)
    runs = list(linkage.sweep(i, j, t, np.arange(n), count))
    assert max(len(places) for places, *_ in runs) <= n
    assert sum(len(places) for places, *_ in runs) < 30 * n
    held = np.full((count, n), -1)
    for places, first, last, labels in runs:
        for p, a, label in zip(places.tolist(), first.tolist(), labels.tolist(), strict=True):
            assert (held[a : last + 1, p] == -1).all()
            held[a : last + 1, p] = label
    for k in (0, 7, 200, 400):
        f = linkage.Forest(n)
        for a, b in zip(i[t <= k].tolist(), j[t <= k].tolist(), strict=True):
            f.join(a, b)
        assert held[k].tolist() == [f.root(o) for o in range(n)]


@pytest.mark.parametrize("most", [1, 4, 24])
def test_dendrogram_in_runs(spark, points, most):
    t = CONFIGS[1]
    pairs, objects = spark.createDataFrame(points, "id1 long, id2 long, dist double"), spark.range(25).withColumnRenamed("id", "obj")
    far = [(i + 2**50, j + 2**50, d) for i, j, d in points if d < 0.3]
    few, moved = spark.createDataFrame(far, "id1 long, id2 long, dist double"), objects.selectExpr("obj + power(2, 50) as obj")
    for p, o in ((pairs, objects), (few, moved)) if most == 4 else ((pairs, objects),):
        expect = linkage.hclust(p, o, t).orderBy("step").collect()
        assert linkage.hclust(p, o, t, forest_pairs=most).orderBy("step").collect() == expect and len(expect) == 24


def test_overlapping_subsets(spark, points):
    t = CONFIGS[1]
    rng = random.Random(2)
    subsets = {s: sorted(rng.sample(range(25), n)) for s, n in enumerate((5, 10, 15, 20))}
    members = spark.createDataFrame([(s, o) for s, own in subsets.items() for o in own], "subset long, obj long")
    pairs, objects = spark.createDataFrame(points, "id1 long, id2 long, dist double"), spark.range(25).withColumnRenamed("id", "obj")
    for forest_pairs in (None, 0):
        small = t if forest_pairs is None else cf.threshold_set([0.2, 0.4])
        got = linkage.cluster(pairs, objects, small, members, forest_pairs=forest_pairs).collect()
        for s, own in subsets.items():
            assert {(r.t_idx, r.obj): r.cluster for r in got if r.subset == s} == brute(points, own, small.values)


def test_tiny_relation(spark, tmp_path):
    (tmp_path / "d").write_text("0 0 0\n1\t1 0\n\n 0 1  0.118\n")
    t = cf.threshold_set({"species": 0.017, "genus": 0.067, "family": 0.084, "order": 0.148})
    names = spark.createDataFrame([(0, "ASV59674"), (1, "ASV60755")], "seq_idx long, seq_id string")
    got = linkage.distmx_cluster(files.read_distances(spark, str(tmp_path / "d")), names, t)
    rows = sorted((r.t_order, r.t_name, r.obj_id, r.cluster) for r in got.collect())
    assert [r[3] for r in rows] == [0, 1, 0, 1, 0, 1, 0, 0]
    assert [r[1] for r in rows][::2] == ["species", "genus", "family", "order"]
    wide = {r.obj: r.clusters for r in linkage.matrix(got).collect()}
    assert wide == {0: [0, 0, 0, 0], 1: [1, 1, 1, 0]}


def test_no_pairs_and_no_objects(spark):
    t = cf.threshold_set([0.1])
    none = spark.createDataFrame([], "id1 long, id2 long, dist double")
    got = linkage.cluster(none, spark.range(3).withColumnRenamed("id", "obj"), t).collect()
    assert sorted((r.obj, r.cluster) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert linkage.cluster(none, spark.range(0).withColumnRenamed("id", "obj"), t).collect() == []


def test_dendrogram(spark, points):
    t = CONFIGS[1]
    pairs, objects = spark.createDataFrame(points, "id1 long, id2 long, dist double"), spark.range(25).withColumnRenamed("id", "obj")
    rows = linkage.hclust(pairs, objects, t).orderBy("step").collect()
    assert len(rows) == 24 and [r.height for r in rows] == sorted(r.height for r in rows)
    expect = brute(points, range(25), t.values)
    for k, limit in enumerate(t.values):
        groups = {i: {i} for i in range(25)}
        made = {}
        for r in rows:
            sides = [made[x] if x > 0 else {-x - 1} for x in (r.left, r.right)]
            made[r.step] = sides[0] | sides[1]
            if r.height <= limit + 1e-9 and limit < 1:
                for o in made[r.step]:
                    groups[o] = made[r.step]
        if limit < 1:
            assert {o: min(g) for o, g in groups.items()} == {o: expect[k, o] for o in range(25)}
    assert sorted(linkage.leaf_order([(r.left, r.right) for r in rows])) == list(range(25))


def test_stream_adds_up(spark, points, tmp_path):
    t = cf.threshold_set([0.1, 0.2, 0.3, 0.5])
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"part{k}.txt").write_text("".join(f"{i}\t{j}\t{d}\n" for i, j, d in points[k::3] + points[::7]))
    state = ForestStream(spark, t)
    state.start(files.stream_distances(spark, str(folder)), str(tmp_path / "check")).awaitTermination()
    assert state.batches >= 3 and state.state.count() <= 24
    got = state.clusters(spark.range(25).withColumnRenamed("id", "obj")).collect()
    assert {(r.t_idx, r.obj): r.cluster for r in got} == brute(points, range(25), t.values)


def test_stream_goes_on_after_a_restart(spark, points, tmp_path):
    t = cf.threshold_set([0.1, 0.2, 0.3, 0.5])
    folder = f"file://{tmp_path}/state"
    for k in range(4):  # a new driver for each batch
        state = ForestStream(spark, t, folder)
        assert state.batches == k
        state.add(spark.createDataFrame(points[k::4], "id1 long, id2 long, dist double"), k)
    got = ForestStream(spark, t, folder).clusters(spark.range(25).withColumnRenamed("id", "obj")).collect()
    assert {(r.t_idx, r.obj): r.cluster for r in got} == brute(points, range(25), t.values)
    assert len([p for p in (tmp_path / "state").iterdir()]) == 2


# --- metrics ----------------------------------------------------------------------

K = [[1, 2, 2, 4, 4], [1, 2, 2, 1, 2]]
C = [1, 1, 1, 4, 1]
GOLD = {
    0: dict(RI=0.4, ARI=-0.071428571, MCC=-0.102062073, FMI=0.288675135, MI=0.223143551, EMI=0.278595326, AMI=-0.071428571, FM=0.666666667),
    1: dict(RI=0.6, ARI=0.230769231, MCC=0.25, FMI=0.612372436, MI=0.223143551, EMI=0.160353774, AMI=0.122478905, FM=0.819047619),
}


@pytest.fixture(scope="module")
def partitions(spark):
    k = spark.createDataFrame([(t, o, v) for t, row in enumerate(K) for o, v in enumerate(row)], "t_idx int, obj long, k long")
    return k, spark.createDataFrame(list(enumerate(C)), "obj long, c int")


def test_confusion_goldens(partitions):
    rows = metrics.confusion_matrix(*partitions).orderBy("t_idx").collect()
    assert [(r.TP, r.FP, r.FN, r.TN) for r in rows] == [(1, 1, 5, 3), (3, 1, 3, 3)]


def test_metric_goldens(partitions):
    for r in metrics.pair_indices(metrics.confusion_matrix(*partitions)).collect():
        assert [r.RI, r.ARI, r.MCC, r.FMI] == pytest.approx([GOLD[r.t_idx][m] for m in ("RI", "ARI", "MCC", "FMI")], abs=1e-8)
    for r in metrics.adjusted_mutual_information(*partitions).collect():
        assert [r.MI, r.EMI, r.AMI] == pytest.approx([GOLD[r.t_idx][m] for m in ("MI", "EMI", "AMI")], abs=1e-8)
    for r in metrics.fmeasure(*partitions).collect():
        assert r.FM == pytest.approx(GOLD[r.t_idx]["FM"], abs=1e-8)
    long = {(r.t_idx, r.measure): r.value for r in metrics.cluster_measures(*partitions).collect()}
    assert long == pytest.approx({(t, m): GOLD[t][m] for t in GOLD for m in metrics.MEASURES}, abs=1e-8)
    with pytest.raises(ValueError):
        metrics.cluster_measures(*partitions, measures=("no",))


def test_a_truth_for_each_row(spark, partitions):
    own = spark.createDataFrame([(t, o, v if t == 0 else 7) for t in (0, 1) for o, v in enumerate(C)], "t_idx int, obj long, c int")
    rows = metrics.confusion_matrix(partitions[0], own).orderBy("t_idx").collect()
    assert (rows[0].TP, rows[0].FP, rows[0].FN, rows[0].TN) == (1, 1, 5, 3)
    assert rows[1].FP == 0 and rows[1].TN == 0 and rows[1].TP + rows[1].FN == 10


def test_equal_partitions(spark):
    k = spark.createDataFrame([(0, o, o % 3) for o in range(9)], "t_idx int, obj long, k long")
    c = spark.createDataFrame([(o, 10 + o % 3) for o in range(9)], "obj long, c int")
    r = {x.measure: x.value for x in metrics.cluster_measures(k, c).collect()}
    assert all(r[m] == pytest.approx(1) for m in ("RI", "ARI", "MCC", "FMI", "AMI", "FM"))
    same = spark.createDataFrame([(0, o, 1) for o in range(4)], "t_idx int, obj long, k long")
    one = spark.createDataFrame([(o, 1) for o in range(4)], "obj long, c int")
    r = {x.measure: x.value for x in metrics.cluster_measures(same, one).collect()}
    assert r["MCC"] is None and r["ARI"] is None and r["AMI"] is None and r["FM"] == 1


def test_expected_information_of_large_clusters(spark):
    """No table as long as the number of objects is made or broadcast; runs of terms and far terms left out give the whole sum."""
    m = np.array([0, 1, 2, 15, 16, 17, 1000, 10**9])
    assert metrics.log_factorial(m) == pytest.approx([math.lgamma(k + 1) for k in m.tolist()], rel=1e-14, abs=1e-14)
    n, a, b = 60_000, 25_000, 30_001
    k = spark.range(n).select(F.lit(0).alias("t_idx"), F.col("id").alias("obj"), (F.col("id") < a).cast("long").alias("k"))
    c = spark.range(n).select(F.col("id").alias("obj"), (F.col("id") % 7 * 10_000 + F.col("id") % 10_000 < b).cast("int").alias("c"))
    sizes = {r.c: r["count"] for r in c.groupBy("c").count().collect()}
    want, lf = 0.0, lambda x: math.lgamma(x + 1)
    for x in (a, n - a):
        for y in sizes.values():
            for i in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(i) - lf(x - i) - lf(y - i) - lf(n - x - y + i))
                want += i / n * math.log(n * i / (x * y)) * p
    found = metrics.adjusted_mutual_information(k, c)
    assert found.first().EMI == pytest.approx(want, rel=1e-4, abs=1e-9)
    assert "Range" not in found._jdf.queryExecution().executedPlan().toString()


def test_sets_and_intersections(spark):
    sets = spark.createDataFrame([(0, [[0], [1, 2], [3, 4]])], "t_idx int, sets array<array<long>>")
    k = metrics.from_sets(sets, "k", ["t_idx"])
    c = metrics.from_sets(spark.createDataFrame([([[0, 1, 2, 4], [3]],)], "sets array<array<long>>"), "c")
    assert metrics.fmeasure(k, c).first().FM == pytest.approx(GOLD[0]["FM"], abs=1e-8)
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(metrics.intersect_length(F.col("a"), F.col("b"))).collect()] == [2, 0]


def test_best_threshold_ties(spark):
    rows = [(0, "A", 0.5), (1, "A", 0.9), (2, "A", 0.9), (3, "A", 0.9), (4, "A", 0.9), (5, "A", float("nan")), (6, "A", None), (0, "B", None)]
    measured = spark.createDataFrame(rows, "t_idx int, measure string, value double")
    levels = spark.createDataFrame([(k, k / 10) for k in range(7)], "t_idx int, threshold double")
    assert [tuple(r) for r in metrics.best_thresholds(measured, levels).collect()] == [("A", 0.2, 0.9)]


# --- ranks and thresholds ------------------------------------------------------------


def test_summarize_by_rank(spark):
    rows = [("s1", "F", "A", "x"), ("s2", "F", "A", "y"), ("s3", "F", "B", None), ("s4", "F", "B", "z"), ("s5", None, "B", "z")]
    df = spark.createDataFrame(rows, "id string, kingdom string, phylum string, class string")
    got = {(r.supertaxon, r.superrank, r["rank"]): (r.n_taxa, r.n_seq, r.seq_id, r.true_partition) for r in ranks.summarize_by_rank(df, ("kingdom", "phylum", "class"), "id").collect()}
    assert got == {
        ("F", "kingdom", "phylum"): (2, 4, ["s1", "s2", "s3", "s4"], [0, 0, 1, 1]),
        ("F", "kingdom", "class"): (3, 3, ["s1", "s2", "s4"], [0, 1, 2]),
        ("A", "phylum", "class"): (2, 2, ["s1", "s2"], [0, 1]),
        ("B", "phylum", "class"): (1, 2, ["s4", "s5"], [0, 0]),
    }
    order = [r.supertaxon for r in ranks.rank_sorted(ranks.summarize_by_rank(df, ("kingdom", "phylum", "class"), "id"), ("kingdom", "phylum", "class")).collect()]
    assert order == ["F", "F", "A", "B"]


OPTIMA = [("class", "kingdom", "Fungi", 0.2), ("class", "phylum", "Asco", 0.15), ("phylum", "kingdom", "Fungi", 0.3)]
KPC = ("kingdom", "phylum", "class")


def test_taxon_thresholds(spark):
    optima = spark.createDataFrame(OPTIMA, "rank string, superrank string, supertaxon string, threshold double")
    table = spark.createDataFrame([("a", "Fungi", "Asco"), ("b", "Fungi", "Basidio"), ("c", "Fungi", None)], "seq_id string, kingdom string, phylum string")
    got = {r.taxon: r.threshold for r in optimize.calc_taxon_thresholds("phylum", table, optima, KPC).collect()}
    assert got == {"Asco": 0.15, "Basidio": 0.2, "_NA_": 0.2}
    sub = {(r.taxon, r["rank"]): r.threshold for r in optimize.calc_subtaxon_thresholds("kingdom", table, optima, KPC).collect()}
    assert sub == {("Fungi", "class"): 0.2, ("Fungi", "phylum"): 0.3, ("_NA_", "class"): 0.2, ("_NA_", "phylum"): 0.3}
    empty = table.withColumn("phylum", F.lit(None).cast("string"))
    assert optimize.calc_taxon_thresholds("phylum", empty, optima, KPC).collect() == []
    falling = spark.createDataFrame([("class", "kingdom", "Fungi", 0.4), ("phylum", "kingdom", "Fungi", 0.3)], optima.schema)
    sub = {r["rank"]: r.threshold for r in optimize.calc_subtaxon_thresholds("kingdom", table, falling, KPC).collect() if r.taxon == "Fungi"}
    assert sub == {"class": 0.4, "phylum": 0.4}
    missing = spark.createDataFrame([("phylum", "kingdom", "Fungi", 0.3)], optima.schema)
    sub = {r["rank"]: r.threshold for r in optimize.calc_subtaxon_thresholds("kingdom", table, missing, KPC).collect() if r.taxon == "Fungi"}
    assert sub == {"class": None, "phylum": None}
    with pytest.raises(ValueError):
        optimize.chosen_optima(optima, "a", "b")


def test_optimize_thresholds_finds_the_gap(spark):
    """Two tight groups of sequences: any threshold between inside and outside distances is best."""
    rng = random.Random(8)
    rows, seqs = [], []
    for g in range(3):
        base = [rng.choice("ACGT") for _ in range(60)]
        for k in range(4):
            s = list(base)
            for _ in range(2):
                s[rng.randrange(60)] = rng.choice("ACGT")
            seqs.append((f"s{g}{k}", "".join(s)))
            rows.append((f"s{g}{k}", "F", f"P{g}"))
    tax = spark.createDataFrame(rows, "seq_id string, kingdom string, phylum string")
    found = optimize.optimize_thresholds(
        tax, spark.createDataFrame(seqs, "seq_id string, seq string"), ("kingdom", "phylum"), cf.EdlibDistance(), cf.threshold_uniform(0.0, 0.4, 0.02), min_taxa=2
    ).collect()
    by = {r.measure: (r.threshold, r.value) for r in found}
    assert set(by) == set(metrics.MEASURES)
    assert by["ARI"][1] == pytest.approx(1) and 0.05 < by["ARI"][0] < 0.4


# --- sequences, pairs, search ----------------------------------------------------------

SIX = ["ACGT", "ACGA", "ACGG", "ACGC", "ACGT", "AGCA"]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(k, f"seq{k + 1}", s) for k, s in enumerate(SIX)], "seq_idx long, seq_id string, seq string")


@pytest.mark.parametrize("config", [cf.EdlibDistance(), cf.Wfa2Distance(), cf.HybridDistance(), cf.HammingDistance()], ids=lambda c: c.method)
@pytest.mark.parametrize("block", [2, 100])
def test_pair_counts(six, config, block):
    counts = [dm.seq_distmx(six, t, config, block=block).count() for t in (0.1, 0.3, 0.5, 0.55)]
    assert counts == [1, 10, *([11, 11] if config.method == "hamming" else [12, 12])]


def test_pair_columns(six):
    got = dm.seq_distmx(six, 0.1).first()
    assert (got.seq_id1, got.seq_id2, got.dist2) == ("seq1", "seq5", 0)
    assert dm.seq_distmx(six, 0.3, details="gapstats").columns[-5:] == ["align_length", "n_insert", "n_delete", "max_insert", "max_delete"]
    assert dm.seq_distmx(six, 0.3, details="cigar").columns[-1] == "cigar"
    assert dm.seq_distmx(six, 0.3, by_index=True).columns[:2] == ["seq_idx1", "seq_idx2"]
    with pytest.raises(ValueError):
        dm.seq_distmx(six, 0.3, details="no").count()


def test_shortcuts(six):
    assert dm.seq_distmx_edlib(six, 0.3).count() == 10
    assert dm.seq_distmx_hamming(six, 0.3).count() == 10
    assert dm.seq_distmx_wfa2(six, 0.3).count() == 10
    assert dm.seq_distmx_prealign(six, 0.3).count() == 10
    row = dm.seq_distmx_prealign(six, 0.3).where("seq_id1 = 'seq1' and seq_id2 = 'seq2'").first()
    assert (row.score1, row.score2) == (1, 1) and row.dist1 <= row.dist2


def test_aligned_pairs_are_counted(six):
    from pyspark.sql import Observation

    seen = Observation()
    dm.seq_distmx_prealign(six, 0.3, counts=seen).collect()
    assert seen.get["aligned"] >= 10


def test_external_plans(spark, six, tmp_path, monkeypatch):
    """A script that stands for the program writes the table that it would."""
    from linkgrove.plans import external as plans

    fake = tmp_path / "usearch"
    fake.write_text(
        "#!/bin/sh\nfor a in \"$@\"; do case $p in -tabbedout) printf '0\\t1\\t0.05\\n' > $a;; -userout) out=$a;; esac; p=$a; done\n"
        "case $1 in -allpairs_global) printf 'seq1\\tseq2\\t3\\t80\\n' > $out;; -usearch_global) printf 'seq1\\tseq2\\t80\\n' > $out;; esac\n"
    )
    fake.chmod(0o755)
    monkeypatch.setenv("usearch", str(fake))
    got = plans.seq_cluster_usearch(six, cf.threshold_set([0.1])).collect()
    assert {r.obj_id: r.cluster for r in got}["seq2"] == 0 and len(got) == 6
    assert plans.seq_distmx_usearch(six, 0.3).first().dist2 == pytest.approx(0.2)
    assert plans.seq_search_usearch(six, six, 0.3).first().ref_id == "seq2"


def test_prefilters_lose_nothing(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = []
    for k in range(25):
        s = list(base)
        for _ in range(rng.randrange(12)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice(["", "A", "CC"])
        seqs.append((k, f"s{k}", "".join(s)))
    df = spark.createDataFrame(seqs, "seq_idx long, seq_id string, seq string")
    want = {(r.seq_id1, r.seq_id2): r.dist2 for r in dm.seq_distmx(df, 0.25, constrain=False).collect()}
    assert want and want == {(r.seq_id1, r.seq_id2): r.dist2 for r in dm.seq_distmx(df, 0.25).collect()}
    assert want == {(r.seq_id1, r.seq_id2): r.dist2 for r in dm.seq_distmx_prealign(df, 0.25).collect()}
    kmer = {(r.seq_id1, r.seq_id2): r.dist2 for r in dm.seq_distmx_kmer(df, 0.25, 1.0).collect()}
    assert kmer.items() <= want.items()


def test_kmer_pairs(spark):
    seqs = [(0, "ACGTACGTAC"), (1, "ACGTACGTAC"), (2, "ACGTACGT"), (3, "TTTTTTTTTT"), (4, "ACGNACGTAC"), (5, "ACG")]
    df = spark.createDataFrame(seqs, "seq_idx long, seq string")
    got = {(r.seq_idx1, r.seq_idx2): r.udist for r in dm.kmer_pairs(df, 1.0).collect()}
    assert got == {(0, 1): 0, (0, 2): 0, (1, 2): 0}
    assert (0, 4) in {(r.seq_idx1, r.seq_idx2) for r in dm.kmer_pairs(df, 1.0, 4).collect()}
    assert {(r.seq_idx1, r.seq_idx2): r.udist for r in dm.kmer_pairs(df, 0.5, presence=True).collect()}[0, 1] == 0


def bag(seq, k, presence):
    words = [w for w in (seq[i : i + k] for i in range(len(seq) - k + 1)) if set(w) <= set("ACGT")]
    return {w: 1 if presence else words.count(w) for w in words}


def test_kmers_that_all_sequences_share(spark):
    """No row for each pair that shares a k-mer: the plan joins packed groups only, and the counts are those of bags."""
    rng = random.Random(5)
    seqs = ["ACGTACGTAACC" + "".join(rng.choice("ACGTACGT-n") for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    seqs += ["A" * 400, "A" * 350 + "C", "é" + seqs[0], None, "", "ACG"]
    df = spark.createDataFrame([(3 * i, s) for i, s in enumerate(seqs)], "seq_idx long, seq string")
    for k, presence, t in ((5, False, 0.6), (5, True, 0.8), (33, False, 0.999), (4, False, 1.0)):
        bags = {3 * i: bag(s, k, presence) for i, s in enumerate(seqs) if s}
        want = {}
        for (i, a), (j, b) in itertools.combinations(bags.items(), 2):
            shared = sum(min(n, b.get(w, 0)) for w, n in a.items())
            size = max(len(a), len(b)) if presence else min(len(seqs[i // 3]), len(seqs[j // 3])) - (k - 1)
            if shared and 1 - shared / size <= t:
                want[i, j] = 1 - shared / size
        found = dm.kmer_pairs(df, t, k, presence)
        assert want and {(r.seq_idx1, r.seq_idx2): r.udist for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "Generate" not in plan


def test_tiles_make_every_pair_once(spark, monkeypatch):
    """Several groups, lists and bits, give the pairs of one group."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(40))) for i in range(90)]
    df = spark.createDataFrame(rows, "seq_idx long, seq string")
    whole = sorted(map(tuple, dm.kmer_pairs(df, 0.97, 4).collect()))
    monkeypatch.setattr(dm, "group_size", lambda rows, block=1, pairs=1: 20)
    assert whole and whole == sorted(map(tuple, dm.kmer_pairs(df, 0.97, 4).collect()))


def test_vectors_are_sent_once(spark, data, monkeypatch):
    """Cosine pairs of several groups: each group is packed and shuffled once, whatever the number of tiles."""
    from linkgrove.queries import embedding_pairs

    whole = sorted(map(tuple, embedding_pairs(spark, data).collect()))
    monkeypatch.setattr(dm, "group_size", lambda rows, block=1, pairs=1: 150)
    found = embedding_pairs(spark, data)
    assert whole and whole == sorted(map(tuple, found.collect()))
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ignore_gaps", [True, False])
def test_hamming_tiles(spark, monkeypatch, ignore_gaps):
    """Groups are sent once, as packed rows; pairs, details and best hits are those of one group."""
    monkeypatch.setattr(dm, "group_size", lambda rows, block=1, pairs=1: 20)
    rng = random.Random(8)
    rows = [(i, f"s{i}", "".join(rng.choice("ACGT-") for _ in range(70))) for i in range(70)]
    df = spark.createDataFrame(rows, "seq_idx long, seq_id string, seq string")
    config = cf.HammingDistance(ignore_gaps=ignore_gaps)
    grid = hm.encode([r[2] for r in rows])
    dist = np.array([hm.as_distance(*hm.one_to_many(g, grid, config), config) for g in grid])
    pairs = dm.seq_distmx(df, 0.7, config, "gapstats", by_index=True)
    want = {(i, j): (dist[i, j], *hm.gap_details(grid[i], grid[j])) for i in range(70) for j in range(i + 1, 70) if dist[i, j] <= 0.7}
    assert want and {(r.seq_idx1, r.seq_idx2): (r.dist2, *r[6:]) for r in pairs.collect()} == want
    hits = search.seq_search(df.where("seq_idx < 30"), df.where("seq_idx >= 30"), 0.72, config)
    best = {(f"s{i}", f"s{j}", dist[i, j]) for i in range(30) for j in range(30, 70) if dist[i, j] == dist[i, 30:].min() <= 0.72}
    assert best and {tuple(r) for r in hits.collect()} == best
    for df in (pairs, hits):
        assert "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("config", [cf.EdlibDistance(), cf.HammingDistance()], ids=lambda c: c.method)
def test_search_keeps_ties(spark, six, config):
    query = spark.createDataFrame([("q1", "ACGT"), ("q2", "ACCC"), ("q3", "TTTT")], "seq_id string, seq string")
    got = sorted((r.seq_id, r.ref_id, r.dist) for r in search.seq_search(query, six, 0.3, config).collect())
    assert got == [("q1", "seq1", 0), ("q1", "seq5", 0), ("q2", "seq4", 0.25)]
    assert {(r.seq_id, r.ref_id) for r in search.one_hit(search.seq_search(query, six, 0.3, config)).collect()} == {("q1", "seq1"), ("q2", "seq4")}


def test_search_hamming_golden(spark):
    q = spark.createDataFrame([("A", "-AAAAACA-GCGT")], "seq_id string, seq string")
    r = spark.createDataFrame([("B", "AAAAAACCCGCG-")], "seq_id string, seq string")
    assert search.seq_search(q, r, 0.4, cf.HammingDistance()).first().dist == pytest.approx(1 / 10)
    assert search.seq_search(q, r, 0.4, cf.HammingDistance(ignore_gaps=False)).first().dist == pytest.approx(2 / 11)
    with pytest.raises(ValueError):
        search.seq_search(q, r, 0.4, cf.HammingDistance(), return_cigar=True)
    assert search.seq_search(q, r, 0.9, cf.Wfa2Distance(), return_cigar=True).first().cigar


def test_seq_cluster_forms(spark, six, tmp_path):
    t = cf.threshold_set([0.1, 0.3])
    want = {(0, "seq5"): 0, (0, "seq2"): 1, (1, "seq2"): 0, (1, "seq6"): 5}
    for source in (six, {f"seq{k + 1}": s for k, s in enumerate(SIX)}, [(f"seq{k + 1}", s) for k, s in enumerate(SIX)]):
        got = {(r.t_idx, r.obj_id): r.cluster for r in seq_cluster(source, t, cf.EdlibDistance(), spark=spark).collect()}
        assert len(got) == 12 and want.items() <= got.items()
    path = sq.write_fasta(six, str(tmp_path / "x.fasta"))
    assert seq_cluster(path, t, spark=spark).count() == 12
    parts = seq_cluster(six, t, which=[["seq1", "seq2"], ["seq5", "seq6"]]).collect()
    assert {(r.subset, r.obj_id): r.cluster for r in parts if r.t_idx == 1} == {(0, "seq1"): 0, (0, "seq2"): 0, (1, "seq5"): 4, (1, "seq6"): 5}
    assert seq_cluster(six, t, output_type="hclust").count() == 5
    (tmp_path / "d.txt").write_text("seq1 seq2 0.05\nseq1 other 0.0\n")
    got = seq_cluster(six, t, cf.FileDistance(str(tmp_path / "d.txt"))).where("t_idx = 0").collect()
    assert {r.obj_id: r.cluster for r in got}["seq2"] == 0
    with pytest.raises(ValueError):
        seq_cluster(six.unionByName(six), t).count()
    with pytest.raises(ValueError):
        seq_cluster(six, t, which=[["nobody"]]).count()


def test_fastq_in_byte_splits(spark, tmp_path):
    """Records that begin with any letter, over many splits of two files and through gzip."""
    rows = [(f"r{k}", "ACGT"[k % 4] * (k % 23), "@+I>"[k % 4] * (k % 23)) for k in range(900)]
    text = "".join(f"@{i} more {i}\n{s}\n+{i if len(s) % 2 else ''}\n{q}\n" for i, s, q in rows)
    cut = text.index("@r400 ")
    folder = tmp_path / "reads"
    folder.mkdir()
    (folder / "a.fastq").write_text(text[:cut])
    (folder / "b.fastq").write_text(text[cut:].replace("\n", "\r\n") + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sq.read_fastq(spark, str(folder))
        assert sorted(map(tuple, got.select("seq_id", "seq", "quality").collect())) == sorted(rows)
        assert {r.description for r in got.select("description").limit(3).collect()} <= {f"{i} more {i}" for i, _, _ in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tiles_by_length(spark):
    """Groups in the order of length leave out pairs that no length allows, and no pair within the threshold."""
    rng = random.Random(12)
    rows = [(k, f"s{k}", "".join(rng.choice("ACGT") for _ in range(rng.choice([6, 20, 60, 61])))) for k in range(40)]
    rows += [(40 + k, f"t{k}", rows[k][2][1:] + "A") for k in range(20)]
    seqs = spark.createDataFrame(rows, "seq_idx long, seq_id string, seq string")
    whole = dm.seq_distmx(seqs, 0.3, by_index=True)
    tiles = dm.block_pairs(seqs, 5, 0.7)
    pairs = {(r.lo, r.hi) for r in tiles.select("lo", "hi").distinct().collect()}
    assert 12 <= len(pairs) < 12 * 13 / 2 * 0.6 and all((b, b) in pairs for b in range(12))
    got = dm.seq_distmx(seqs, 0.3, by_index=True, block=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 10


def test_groups_follow_the_root_of_the_rows():
    assert [dm.group_size(n) for n in (1, 10**4, 10**6, 10**9)] == [512, 512, 11049, 16384]


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n>s2\nGG\n>s3\n\n")
    rows = sorted(map(tuple, sq.read_fasta(spark, str(tmp_path / "a.fa")).collect()))
    assert rows == [("s1", "ACGTAC", "s1 first one"), ("s2", "GG", "s2"), ("s3", "", "s3")]
    import gzip

    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@@@@\n@r2\nGG\n+r2\nII\n")
    reads = sorted(map(tuple, sq.read_fastq(spark, str(tmp_path / "b.fq.gz")).select("seq_id", "seq", "quality").collect()))
    assert reads == [("r1", "ACGT", "@@@@"), ("r2", "GG", "II")]
    assert sorted(r[0] for r in sq.fastq_names(spark, str(tmp_path / "b.fq.gz")).collect()) == ["r1", "r2"]
    assert sq.read_sequences(spark, str(tmp_path / "b.fq.gz")).count() == 2
    with pytest.raises(ValueError):
        sq.read_sequences(spark, "x.txt")


def test_selection(spark, six):
    assert {r.seq_id for r in sq.select_sequences(six, ["seq1", "seq6"]).collect()} == {"seq1", "seq6"}
    assert {r.seq_idx for r in sq.select_sequences(six, [0, 5], negate=True).collect()} == {1, 2, 3, 4}
    assert sq.select_sequences(six, F.col("seq") == "ACGT", negate=True).count() == 4
    assert sq.select_sequences(six, six.where("seq_idx > 3"), negate=True).count() == 4
    assert sq.sequence_size(six) == 6 and sq.seq_names(six).columns == ["seq_id"]
    renamed = sq.rename_sequences(six, spark.createDataFrame([(k, f"n{k}") for k in range(6)], "seq_idx long, seq_id string"))
    assert {r.seq_id for r in renamed.collect()} == {f"n{k}" for k in range(6)}
    assert sq.find_name_column(["x", "seq"]) == "x" and sq.find_seq_column(["OTU", "y"]) == "y"
    for f, c in ((sq.find_name_column, ["a", "b", "c"]), (sq.find_seq_column, ["a", "b", "c"])):
        with pytest.raises(ValueError):
            f(c)


def test_index_without_one_task(spark):
    rows = spark.range(500).selectExpr("concat('k', lpad(cast(499 - id as string), 3, '0')) as seq_id", "id")
    got = sq.with_index(rows.repartition(7), ["seq_id"]).collect()
    assert all(r.seq_idx == 499 - r.id for r in got) and len(got) == 500


def test_relations(spark, six, tmp_path):
    t = spark.createDataFrame([(0, 1, 0.2), (0, 9, 0.1)], "a int, b int, d double")
    assert files.check_relation(t, False).columns == ["id1", "id2", "dist"]
    for bad in (t.select("a", "b"), t.withColumn("a", F.lit("x"))):
        with pytest.raises(ValueError):
            files.check_relation(bad, False)
    (tmp_path / "n.txt").write_text("seq1 seq2 0.2\nseq9 seq2 0.1\nseq3 seq1 0.5\n")
    config = cf.FileDistance(str(tmp_path / "n.txt"))
    assert dm.seq_distmx(six, 0.3, config).count() == 1
    hits = search.seq_search(six.where("seq_idx < 2"), six.where("seq_idx >= 1"), 0.6, config).collect()
    assert sorted((r.seq_id, r.ref_id, r.dist) for r in hits) == [("seq1", "seq2", 0.2)]
    (tmp_path / "i.txt").write_text("0 1 0.2\n0 77 0.1\n")
    assert files.load(spark, cf.FileDistance(str(tmp_path / "i.txt"), by_name=False), six).count() == 1


def test_external_programs(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("USEARCH", "/bin/sh")
    assert external.find_usearch() == "/bin/sh"
    with pytest.raises(FileNotFoundError):
        external.find_executable("surely-not-here")
    t = cf.threshold_set([0.1, 0.3])
    assert "0.6" in external.distmx_command("u", "f", "o", t)
    assert "query+target+raw+id+caln" in external.pairs_command("u", "f", "o", 0.3, True)
    assert "-maxaccepts" in external.search_command("u", "q", "r", "o", 0.3)
    (tmp_path / "p.tsv").write_text("a\tb\t12\t90.0\t8=2D\n")
    row = external.read_pairs(spark, str(tmp_path / "p.tsv"), "gapstats").first()
    assert row.dist2 == pytest.approx(0.1) and row.score1 == 12 and row.n_delete == 2
    (tmp_path / "h.tsv").write_text("a\tb\t95.0\n")
    assert external.read_hits(spark, str(tmp_path / "h.tsv")).first().dist == pytest.approx(0.05)


# --- closed reference and assignment ------------------------------------------------------


def test_closed_reference_waves(spark):
    pairs = spark.createDataFrame([("r", "q1", 0.1), ("q1", "q2", 0.1), ("q3", "q2", 0.1), ("q4", "r", 0.2)], "seq_id string, other_id string, dist double")
    q = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "seq_id string")
    r = spark.createDataFrame([("r",)], "seq_id string")
    got = {x.seq_id: (x.ref_id, x.wave) for x in assign.closed_ref_from_pairs(pairs, q, r, 0.1).collect()}
    assert got == {"q1": ("r", 1), "q2": ("r", 2), "q3": ("r", 3)}
    assert assign.closed_ref_from_pairs(pairs, q, r.limit(0), 0.1).collect() == []


def test_closed_reference_by_search(spark):
    ref = spark.createDataFrame([("r1", "A" * 20), ("r2", "C" * 20)], "seq_id string, seq string")
    rows = [("q1", "A" * 18 + "CC"), ("q2", "A" * 16 + "CCCC"), ("q3", "G" * 20), ("q4", "C" * 19 + "A")]
    got = {x.seq_id: x.ref_id for x in assign.closed_ref_cluster(spark.createDataFrame(rows, "seq_id string, seq string"), ref, 0.1, cf.HammingDistance()).collect()}
    assert got == {"q1": "r1", "q2": "r1", "q4": "r2"}


def test_assign_taxa(spark):
    groups = {"k": "AAAAAAAAAAAAAAAAAAAA", "u": "CCCCCCCCCCCCCCCCCCCC", "v": "GGGGGGGGGGGGGGGGGGGG"}
    seqs = [(f"{g}{i}", s[: 20 - i] + "T" * i) for g, s in groups.items() for i in range(3)]
    probs = [(s, "kingdom", "Fungi", 1.0) for s, _ in seqs] + [("k0", "phylum", "Asco", 0.95), ("u0", "phylum", "Basidio", 0.5)]
    optima = [("phylum", "kingdom", "Fungi", 0.12), ("class", "kingdom", "Fungi", 0.06)]
    got = {
        r.seq_id: (r.kingdom, r.phylum, r["class"])
        for r in assign.assign_taxa(
            spark.createDataFrame(seqs, "seq_id string, seq string"),
            spark.createDataFrame(probs, "seq_id string, rank string, taxon string, prob double"),
            spark.createDataFrame(optima, "rank string, superrank string, supertaxon string, threshold double"),
            KPC, prob_thresh=0.9, config=cf.HammingDistance(),
        ).collect()
    }
    assert len(got) == 9 and all(v[0] == "Fungi" for v in got.values())
    assert {got[f"k{i}"][1] for i in range(3)} == {"Asco"}
    assert len({got[f"u{i}"][1] for i in range(3)}) == 1 and got["u0"][1].startswith("pseudophylum_")
    assert got["u0"][1] != got["v0"][1]
    assert all(v[2].startswith("pseudoclass_") for v in got.values())


def test_distance_kernel_agrees_with_levenshtein(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 15))) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a in words for b in words[:10]], "a string, b string")
    rows = df.select("a", "b", F.levenshtein("a", "b").alias("e")).collect()
    from linkgrove.functions.alignment import align_batch

    cost, _, _ = align_batch([r.a for r in rows], [r.b for r in rows], cf.Wfa2Distance())
    assert cost.tolist() == [r.e for r in rows]
    assert (distances([r.a for r in rows], [r.b for r in rows], cf.EdlibDistance()) <= 1).all()
