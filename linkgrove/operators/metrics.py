"""How well clusters agree with a reference partition, at every threshold.

Clusters are rows (…keys, obj, k) and the truth (…keys, obj, c); keys name a threshold
and perhaps a subset. Everything follows from one aggregation, the contingency counts
n_ij, whose partial sums are made before the shuffle. Ratios that divide by zero are
null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgrove.storage import staged

MEASURES = ("MCC", "RI", "ARI", "FMI", "MI", "AMI", "FM")


def contingency(clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    """(keys, k, c, nij, nk, nc, ntot). The truth is shared by the keys it has no column for.

    The cells are written once, as every measure reads them; their sums are partial
    aggregations joined back, so no task holds all cells of a threshold.
    """
    shared = [x for x in keys if x in truth.columns]
    joined = clusters.join(truth, [*shared, "obj"])
    cells = staged(joined.groupBy(*keys, "k", "c").agg(F.count(F.lit(1)).alias("nij")), "contingency")

    def total(name: str, *by: str) -> DataFrame:
        return cells.groupBy(*keys, *by).agg(F.sum("nij").alias(name))

    return (
        cells.join(total("nk", "k"), [*keys, "k"])
        .join(total("nc", "c"), [*keys, "c"])
        .join(total("ntot"), list(keys))
        .select(*keys, "k", "c", "nij", "nk", "nc", "ntot")
    )


def _confusion(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.col("nij").cast("double")
    sums = cells.groupBy(*keys).agg(
        F.sum(n * (n - 1) / 2).alias("TP"),
        F.sum(n * (F.col("nk") - n) / 2).alias("FP"),
        F.sum(n * (F.col("nc") - n) / 2).alias("FN"),
        F.max("ntot").cast("double").alias("ntot"),
    )
    every = F.col("ntot") * (F.col("ntot") - 1) / 2
    return sums.select(*keys, "TP", "FP", "FN", (every - F.col("TP") - F.col("FP") - F.col("FN")).alias("TN"))


def confusion_matrix(clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    """Pairs of objects together or apart in both partitions: TP, FP, FN, TN for each key.

    A truth with a column of its own for a key gives each key its own partition.
    """
    return _confusion(contingency(clusters, truth, keys), keys)


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rand_index() -> Column:
    tp, fp, fn, tn = map(F.col, ("TP", "FP", "FN", "TN"))
    return _div(tp + tn, tp + fp + fn + tn)


def adjusted_rand_index() -> Column:
    tp, fp, fn, tn = map(F.col, ("TP", "FP", "FN", "TN"))
    return _div(2 * (tp * tn - fp * fn), (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))


def matthews_correlation_coefficient() -> Column:
    tp, fp, fn, tn = map(F.col, ("TP", "FP", "FN", "TN"))
    return _div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(fn + tn) * F.sqrt(fp + tn))


def fowlkes_mallow_index() -> Column:
    tp, fp, fn = map(F.col, ("TP", "FP", "FN"))
    return _div(tp, F.sqrt(tp + fp) * F.sqrt(tp + fn))


def pair_indices(confusion: DataFrame) -> DataFrame:
    """Add RI, ARI, MCC, FMI to a confusion table."""
    return confusion.withColumns({
        "RI": rand_index(), "ARI": adjusted_rand_index(), "MCC": matthews_correlation_coefficient(), "FMI": fowlkes_mallow_index(),
    })


def _mutual(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, total = F.col("nij").cast("double"), F.col("ntot").cast("double")
    return cells.groupBy(*keys).agg(
        F.sum(n / total * F.log(n * total / (F.col("nk").cast("double") * F.col("nc")))).alias("MI")
    )


def mutual_information(clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    return _mutual(contingency(clusters, truth, keys), keys)


#: Numbers whose ln m! is looked up, and terms of one row of `_expected`.
_SMALL, _TERMS = 16, 4096
_LOGS = np.array([math.log(math.factorial(k)) for k in range(_SMALL)])


def log_factorial(m: np.ndarray) -> np.ndarray:
    """ln m! for whole m >= 0, by Stirling's series, so no table as long as the number of objects is made or joined."""
    x = np.maximum(m, _SMALL).astype(np.float64)
    r = 1 / (x * x)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return np.where(m < _SMALL, _LOGS[np.minimum(m, _SMALL - 1)], series)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ntot, a, b, e): the sum of the terms low..high of one pair of cluster sizes."""
    for batch in batches:
        out = []
        for ntot, a, b, low, high in zip(*(batch.column(c).to_numpy() for c in ("ntot", "a", "b", "low", "high")), strict=True):
            n = np.arange(low, high + 1)
            fixed = log_factorial(np.array([a, b, ntot - a, ntot - b])).sum() - log_factorial(np.array([ntot]))[0]
            rest = log_factorial(n) + log_factorial(a - n) + log_factorial(b - n) + log_factorial(ntot - a - b + n)
            out.append(float((n / ntot * np.log(float(ntot) * n / (float(a) * float(b))) * np.exp(fixed - rest)).sum()))
        yield pa.record_batch([*(batch.column(c) for c in ("ntot", "a", "b")), pa.array(out, pa.float64())], names=["ntot", "a", "b", "e"])


def _expected(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, EMI, hk, hc): expected mutual information under random labels, and both entropies.

    Only cluster sizes matter, so each distinct (N, a, b) is worked out once for all
    keys that share it, with its multiplicity joined back. Its terms are made in runs of
    _TERMS, dealt over the tasks; they are about the root of the smaller cluster in number.
    """
    ks = cells.select(*keys, "k", "nk", "ntot").distinct()
    cs = cells.select(*keys, "c", "nc", "ntot").distinct()
    a_sizes = ks.groupBy(*keys, "ntot", F.col("nk").alias("a")).agg(F.count(F.lit(1)).alias("na"))
    b_sizes = cs.groupBy(*keys, "ntot", F.col("nc").alias("b")).agg(F.count(F.lit(1)).alias("nb"))
    pairs = a_sizes.join(b_sizes, [*keys, "ntot"])
    shapes = pairs.select("ntot", "a", "b").distinct()
    # Beyond this far from the mean a term's weight is under exp(-750) by Hoeffding's bound, which is 0 in a double.
    least = F.least("a", "b")
    mean = F.col("a").cast("double") * F.col("b") / F.col("ntot")
    far = F.ceil(F.sqrt(375.0 * least)) + 1
    low = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("ntot"), F.floor(mean) - far)
    high = F.least(least, F.ceil(mean) + far)
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        shapes.withColumns({"low": low, "high": high})
        .where("low <= high")
        .withColumn("low", F.explode(F.sequence("low", "high", F.lit(_TERMS).cast("long"))))
        .withColumn("high", F.least("high", F.col("low") + (_TERMS - 1)))
        .repartition(parts)
    )
    sums = runs.mapInArrow(_terms, "ntot long, a long, b long, e double")
    emi = sums.groupBy("ntot", "a", "b").agg(F.sum("e").alias("e"))
    expected = pairs.join(emi, ["ntot", "a", "b"]).groupBy(*keys).agg(F.sum(F.col("e") * F.col("na") * F.col("nb")).alias("EMI"))

    def entropy(sizes: DataFrame, size: str, count: str, name: str) -> DataFrame:
        p = F.col(size).cast("double") / F.col("ntot")
        return sizes.groupBy(*keys).agg((-F.sum(F.col(count) * p * F.log(p))).alias(name))

    return expected.join(entropy(a_sizes, "a", "na", "hk"), list(keys)).join(entropy(b_sizes, "b", "nb", "hc"), list(keys))


def _adjusted(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = _mutual(cells, keys).join(_expected(cells, keys), list(keys))
    span = F.greatest("hk", "hc") - F.col("EMI")
    return both.select(*keys, "MI", "EMI", F.when(F.abs(span) > 1e-15, (F.col("MI") - F.col("EMI")) / span).alias("AMI"))


def adjusted_mutual_information(clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    """MI, EMI and AMI = (MI - EMI) / (max entropy - EMI) for each key."""
    return _adjusted(contingency(clusters, truth, keys), keys)


def _fmeasure(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = cells.groupBy(*keys, "c").agg(
        F.max(F.col("nij").cast("double") / (F.col("nc") + F.col("nk"))).alias("f"),
        F.max("nc").alias("nc"),
        F.max("ntot").alias("ntot"),
    )
    return best.groupBy(*keys).agg((2 * F.sum(F.col("nc") * F.col("f")) / F.max("ntot")).alias("FM"))


def fmeasure(clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    """Mean over objects of the best F-measure of their true class with any cluster."""
    return _fmeasure(contingency(clusters, truth, keys), keys)


def from_sets(sets: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, obj, label) of partitions given as arrays of object arrays in `sets`."""
    return sets.select(*keys, F.posexplode("sets").alias(label, "_set")).select(*keys, F.explode("_set").alias("obj"), label)


def intersect_length(a: Column, b: Column) -> Column:
    """Common distinct elements of two arrays."""
    return F.size(F.array_intersect(a, b))


def cluster_measures(
    clusters: DataFrame, truth: DataFrame, keys: Sequence[str] = ("t_idx",), measures: Sequence[str] = MEASURES
) -> DataFrame:
    """(keys, measure, value) rows of the measures asked for, from one contingency table."""
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    cells = contingency(clusters, truth, keys)
    parts = []
    if set(measures) & {"MCC", "RI", "ARI", "FMI"}:
        parts.append(pair_indices(_confusion(cells, keys)))
    if "AMI" in measures:
        parts.append(_adjusted(cells, keys))
    elif "MI" in measures:
        parts.append(_mutual(cells, keys))
    if "FM" in measures:
        parts.append(_fmeasure(cells, keys))
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p, list(keys))
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return wide.select(*keys, F.inline(values))


#: Decimal digits to which measures are compared.
TIE_DIGITS = 10


def best_thresholds(measured: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, measure, threshold, value): the best value of each measure, the lower middle threshold of ties.

    `measured` has keys, t_idx, measure, value; `thresholds` has t_idx, threshold. NaN
    and null never win. Values count as equal if they agree to TIE_DIGITS digits, as sums
    of floats come in any order.
    """
    value = F.when(~F.isnan("value"), F.round("value", TIE_DIGITS))
    by = Window.partitionBy(*keys, "measure")
    top = (
        measured.withColumn("value", value)
        .withColumn("_best", F.max("value").over(by))
        .where(F.col("value") == F.col("_best"))
        .withColumn("_at", F.row_number().over(by.orderBy("t_idx")))
        .withColumn("_of", F.count(F.lit(1)).over(by))
        .where(F.col("_at") == F.ceil(F.col("_of") / 2))
    )
    return top.join(F.broadcast(thresholds.select("t_idx", "threshold").distinct()), "t_idx").select(
        *keys, "measure", "threshold", "value"
    )
