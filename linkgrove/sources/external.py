"""External search programs: where they are, how they are called, how their tables are read.

The programs are not part of this package. Distances come from tables that they wrote,
or, where an executable is found, from running it on the driver's machine.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.config import Thresholds
from linkgrove.functions.cigar import add_gap_stats


def find_executable(name: str) -> str:
    """From the variable of that name, or in capitals, then the path, then ./bin; raise if nowhere."""
    for variable in (name, name.upper()):
        path = os.environ.get(variable)
        if path and os.access(path, os.X_OK):
            return path
    path = shutil.which(name)
    if path:
        return path
    own = Path("bin") / name
    if os.access(own, os.X_OK):
        return str(own)
    raise FileNotFoundError(f"no executable {name!r} in the environment, the path or ./bin")


def find_usearch() -> str:
    return find_executable("usearch")


def distmx_command(executable: str, fasta: str, out: str, thresholds: Thresholds, threads: int = 1) -> list[str]:
    """Sparse distance matrix up to the top threshold; search ends at twice that, 1 at most."""
    top = thresholds.top
    return [
        executable, "-calc_distmx", fasta, "-tabbedout", out, "-maxdist", str(top), "-termdist", str(min(1, 2 * top)),
        "-lopen", "0", "-lext", "1", "-threads", str(threads),
    ]


def pairs_command(executable: str, fasta: str, out: str, threshold: float, cigar: bool, threads: int = 1) -> list[str]:
    fields = "query+target+raw+id" + ("+caln" if cigar else "")
    return [
        executable, "-allpairs_global", fasta, "-userout", out, "-userfields", fields, "-id", str(1 - threshold), "-threads", str(threads),
    ]


def search_command(executable: str, query: str, ref: str, out: str, threshold: float, threads: int = 1) -> list[str]:
    return [
        executable, "-usearch_global", query, "-db", ref, "-userout", out, "-userfields", "query+target+id", "-id", str(1 - threshold),
        "-top_hits_only", "-maxaccepts", "100", "-strand", "plus", "-threads", str(threads),
    ]


def run(command: list[str]) -> None:
    subprocess.run(command, check=True)


def read_pairs(spark: SparkSession, path: str, details: str = "none") -> DataFrame:
    """A table of query, target, raw score, identity in percent and perhaps CIGAR as scored pairs."""
    kinds = "seq_id1 string, seq_id2 string, score1 double, id double" + (", cigar string" if details != "none" else "")
    rows = spark.read.csv(path, sep="\t", schema=kinds)
    dist = 1 - F.col("id") / 100
    out = rows.withColumns({"score2": F.col("score1"), "dist1": dist, "dist2": dist}).drop("id")
    if details == "gapstats":
        out = add_gap_stats(out).drop("cigar")
    front = ["seq_id1", "seq_id2", "score1", "score2", "dist1", "dist2"]
    return out.select(*front, *[c for c in out.columns if c not in front])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A table of query, target and identity in percent as (seq_id, ref_id, dist)."""
    rows = spark.read.csv(path, sep="\t", schema="seq_id string, ref_id string, id double")
    return rows.select("seq_id", "ref_id", (1 - F.col("id") / 100).alias("dist"))
