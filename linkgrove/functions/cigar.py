"""CIGAR strings to distances and gap statistics: one fold over their runs, no Python.

A run is an optional count and one of = M X I D; a missing count is 1. Insertions and
deletions may interleave: a run of one is ended only by = M or X, not by the other.
The extension forms leave a trailing gap out of counts and distance, but not out of
align_length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_COLUMNS = ("align_length", "n_insert", "n_delete", "max_insert", "max_delete")
_FIELDS = ("length", "match", "ins", "dele", "run_i", "run_d", "max_i", "max_d")


def _runs(cigar: Column) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(r"(\d*)([=MXID])"), F.lit(0))
    return F.transform(
        found,
        lambda r: F.struct(
            F.when(F.length(r) == 1, F.lit(1))
            .otherwise(r.substr(F.lit(1), F.length(r) - 1).cast("int"))
            .alias("n"),
            F.substring(r, -1, 1).alias("op"),
        ),
    )


def _fold(runs: Column) -> Column:
    start = F.struct(*[F.lit(0).alias(f) for f in _FIELDS])

    def step(s: Column, r: Column) -> Column:
        n, op = r["n"], r["op"]
        ins, dele = op == "I", op == "D"
        gap = ins | dele
        run_i = F.when(ins, s["run_i"] + n).when(dele, s["run_i"]).otherwise(0)
        run_d = F.when(dele, s["run_d"] + n).when(ins, s["run_d"]).otherwise(0)
        values = {
            "length": s["length"] + n,
            "match": s["match"] + F.when(op.isin("=", "M"), n).otherwise(0),
            "ins": s["ins"] + F.when(ins, n).otherwise(0),
            "dele": s["dele"] + F.when(dele, n).otherwise(0),
            "run_i": run_i,
            "run_d": run_d,
            "max_i": F.greatest(s["max_i"], F.when(gap, run_i).otherwise(0)),
            "max_d": F.greatest(s["max_d"], F.when(gap, run_d).otherwise(0)),
        }
        return F.struct(*[values[f].alias(f) for f in _FIELDS])

    return F.aggregate(runs, start, step)


def _trimmed(cigar: Column) -> Column:
    """Without the trailing gap run."""
    return F.regexp_replace(cigar, r"(\d*[ID])+$", "")


def _once(value: Column, use) -> Column:
    """`use(value)` with the fold run once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _distance(s: Column) -> Column:
    return F.when(s["length"] > 0, (s["length"] - s["match"]).cast("double") / s["length"])


def _stats(length: Column, s: Column) -> list[Column]:
    return [
        length.alias("align_length"),
        s["ins"].alias("n_insert"),
        s["dele"].alias("n_delete"),
        s["max_i"].alias("max_insert"),
        s["max_d"].alias("max_delete"),
    ]


def cigar_distance(cigar: Column, extension: bool = False) -> Column:
    """Share of the alignment that is no match; null where nothing is aligned."""
    return _once(_fold(_runs(_trimmed(cigar) if extension else cigar)), _distance)


def cigar_summary(cigar: Column, extension: bool = False) -> Column:
    """Struct of GAP_COLUMNS and dist, from one fold."""
    if not extension:
        return _once(_fold(_runs(cigar)), lambda s: F.struct(*_stats(s["length"], s), _distance(s).alias("dist")))
    total = F.aggregate(_runs(cigar), F.lit(0), lambda n, r: n + r["n"])  # a free gap counts for the length alone
    return _once(_fold(_runs(_trimmed(cigar))), lambda s: F.struct(*_stats(total, s), _distance(s).alias("dist")))


def gap_stats(cigar: Column, extension: bool = False) -> Column:
    """Struct of GAP_COLUMNS."""
    return _once(cigar_summary(cigar, extension), lambda s: F.struct(*[s[c].alias(c) for c in GAP_COLUMNS]))


def add_gap_stats(df: DataFrame, cigar: str = "cigar", extension: bool = False, distance: str | None = None) -> DataFrame:
    """Add GAP_COLUMNS, and the distance under the name `distance` if one is given."""
    stats = df.withColumn("_gaps", cigar_summary(F.col(cigar), extension))
    own = {c: F.col("_gaps")[c] for c in GAP_COLUMNS} | ({distance: F.col("_gaps")["dist"]} if distance else {})
    return stats.withColumns(own).drop("_gaps")
