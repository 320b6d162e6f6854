"""Immutable settings of distances, thresholds, clustering, parallelism and prefilters.

`dataclasses.replace` updates any of them; every constructor checks its values.
Cluster and parallel methods all name one result here: Spark decides how the work is
split, so those settings are kept as accepted aliases.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

EPS = math.sqrt(2.0**-52)


class ConfigError(ValueError):
    """A setting is out of its range."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


# --- distances ---------------------------------------------------------------


@dataclass(frozen=True)
class Wfa2Distance:
    """Gap-affine alignment; scores are penalties, `match` is a bonus below or at zero."""

    match: int = 0
    mismatch: int = 1
    gap_open: int = 0
    gap_extend: int = 1
    gap_open2: int | None = None
    gap_extend2: int | None = None
    method: str = "wfa2"

    def __post_init__(self):
        object.__setattr__(self, "gap_open2", self.gap_open if self.gap_open2 is None else self.gap_open2)
        object.__setattr__(self, "gap_extend2", self.gap_extend if self.gap_extend2 is None else self.gap_extend2)
        _need(self.match <= 0, "match must not be positive: it is a penalty")
        _need(self.mismatch > 0, "mismatch must be positive")
        _need(self.gap_open >= 0 and self.gap_open2 >= 0, "gap opening must not be negative")
        _need(self.gap_extend > 0 and self.gap_extend2 > 0, "gap extension must be positive")

    @property
    def is_edit(self) -> bool:
        return (self.match, self.mismatch, self.gap_open, self.gap_extend, self.gap_open2, self.gap_extend2) == (0, 1, 0, 1, 0, 1)


@dataclass(frozen=True)
class EdlibDistance:
    """Edit distance over alignment length."""

    method: str = "edlib"


@dataclass(frozen=True)
class HybridDistance:
    """Two edit-distance engines switched at `cutoff`; one result, so one engine here."""

    cutoff: float = 0.1
    method: str = "hybrid"

    def __post_init__(self):
        _need(self.cutoff >= 0, "cutoff must not be negative")


@dataclass(frozen=True)
class HammingDistance:
    min_overlap: int = 0
    ignore_gaps: bool = True
    method: str = "hamming"

    def __post_init__(self):
        _need(self.min_overlap >= 0, "min_overlap must not be negative")


@dataclass(frozen=True)
class FileDistance:
    filename: str
    by_name: bool = True
    method: str = "file"


@dataclass(frozen=True)
class ExternalDistance:
    """Distances from an external search program."""

    executable: str | None = None
    threads: int | None = None
    method: str = "usearch"


def dist_config(method: str, **settings):
    kinds = {
        "wfa2": Wfa2Distance, "edlib": EdlibDistance, "hybrid": HybridDistance, "hamming": HammingDistance,
        "file": FileDistance, "usearch": ExternalDistance,
    }
    _need(method in kinds, f"unknown distance method {method!r}")
    return kinds[method](**settings)


# --- thresholds --------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """An ordered list of distance thresholds, which `index` maps distances to.

    kind `uniform` steps from `start` by `step`, `set` takes `values`, `lookup` takes
    them after rounding distances to `precision`. Repeated values of a set stay as
    rows of the result.
    """

    kind: str
    values: tuple[float, ...]
    names: tuple[str, ...] | None = None
    start: float = 0.0
    step: float = 0.0
    precision: float = 0.0

    def __post_init__(self):
        _need(self.kind in ("uniform", "set", "lookup"), f"unknown threshold type {self.kind!r}")
        _need(len(self.values) > 0, "at least one threshold is needed")
        _need(all(v is not None and v >= 0 and not math.isnan(v) for v in self.values), "thresholds must be numbers >= 0")
        _need(all(a <= b for a, b in zip(self.values, self.values[1:], strict=False)), "thresholds must not fall")
        _need(self.names is None or len(self.names) == len(self.values), "as many names as thresholds are needed")
        if self.kind == "lookup":
            _need(self.precision > 0, "precision must be positive")

    def __len__(self) -> int:
        return len(self.values)

    @property
    def distinct(self) -> tuple[float, ...]:
        return tuple(dict.fromkeys(self.values))

    @property
    def top(self) -> float:
        return self.values[-1]


def threshold_uniform(start: float, stop: float, step: float, names: Sequence[str] | None = None) -> Thresholds:
    _need(start >= 0 and stop >= start and step > 0, "need 0 <= from <= to and a positive step")
    count = math.ceil((stop - start) / step) + 1
    return Thresholds("uniform", tuple(start + i * step for i in range(count)), names and tuple(names), start, step)


def threshold_set(values: Sequence[float] | Mapping[str, float], names: Sequence[str] | None = None) -> Thresholds:
    if isinstance(values, Mapping):
        names, values = names or list(values), list(values.values())
    return Thresholds("set", tuple(map(float, values)), names and tuple(names))


def threshold_lookup(values, precision: float, names: Sequence[str] | None = None) -> Thresholds:
    if isinstance(values, Mapping):
        names, values = names or list(values), list(values.values())
    return Thresholds("lookup", tuple(map(float, values)), names and tuple(names), precision=precision)


def threshold_config(kind: str, *args, **settings) -> Thresholds:
    makers = {"uniform": threshold_uniform, "set": threshold_set, "lookup": threshold_lookup}
    _need(kind in makers, f"unknown threshold type {kind!r}")
    return makers[kind](*args, **settings)


# --- clustering and parallelism: aliases of one plan --------------------------


@dataclass(frozen=True)
class ClusterMethod:
    method: str = "tree"
    binary_search: bool = True
    fill_method: str = "binary"
    verbose: bool = False
    test: bool = False

    def __post_init__(self):
        _need(self.method in ("tree", "matrix", "index", "slink"), f"unknown cluster method {self.method!r}")
        _need(self.fill_method in ("binary", "linear", "topdown"), f"unknown fill method {self.fill_method!r}")


def clust_config(method: str = "tree", **settings) -> ClusterMethod:
    return ClusterMethod(method, **settings)


@dataclass(frozen=True)
class Parallelism:
    """How many first-level pieces the forest reduction starts from; None leaves Spark's partitions."""

    method: str = "merge"
    threads: int = 1
    shards: int = 1

    def __post_init__(self):
        _need(self.method in ("merge", "concurrent", "hierarchical"), f"unknown parallel method {self.method!r}")
        _need(self.threads >= 1 and self.shards >= 1, "threads and shards must be positive")
        _need(self.method != "hierarchical" or self.threads >= self.shards, "hierarchical needs a thread for each shard")


def parallel_config(method: str = "merge", **settings) -> Parallelism:
    return Parallelism(method, **settings)


# --- prefilters ---------------------------------------------------------------


@dataclass(frozen=True)
class Prefilter:
    """A cheap test before alignment: `kmer` distance, or an edit-distance bound."""

    method: str = "edlib"
    udist_threshold: float = 1.0

    def __post_init__(self):
        _need(self.method in ("kmer", "wfa2", "edlib"), f"unknown prefilter {self.method!r}")
        _need(0 <= self.udist_threshold <= 1, "udist_threshold must lie in [0, 1]")


def prealign_config(method: str, **settings) -> Prefilter:
    return Prefilter(method, **settings)
