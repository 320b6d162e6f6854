"""Pairwise alignment: distances for batches of pairs, CIGARs for single ones.

One score does everything: cost first, then the longer alignment, then more matches.
Distance is edits over alignment length, so the tie rule matters; the longest optimal
alignment gives the smallest distance, which the bound in `edit_bound` presumes. A gap
of k letters costs min(open + k*extend, open2 + k*extend2). I consumes the second
sequence, D the first.

Spans: `global` charges all end gaps; `extension` frees 3' gaps, of both sequences for
gap-affine alignment and of the second only for edit distance (`free="second"`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from linkgrove.config import EdlibDistance, HammingDistance, HybridDistance, Wfa2Distance

#: Alignments must be shorter than this; keys hold cost, length and matches as digits.
_B = 1 << 17
_FAR = 1 << 60
_CHUNK_CELLS = 2_000_000
AlignDistance = Wfa2Distance | EdlibDistance | HybridDistance


def scores_of(config: AlignDistance) -> Wfa2Distance:
    return config if isinstance(config, Wfa2Distance) else Wfa2Distance()


def free_ends(config: AlignDistance, span: str) -> str:
    if span not in ("global", "extension", "extend"):
        raise ValueError(f"unknown span {span!r}")
    if span == "global":
        return "none"
    return "second" if isinstance(config, EdlibDistance) else "both"


def edit_bound(len_a: Column, len_b: Column, threshold: float) -> Column:
    """Most edits that a pair within `threshold` can have, one added for rounding."""
    return ((F.lit(threshold) * (len_a + len_b)) / F.lit(2 - threshold)).cast("int") + 1


def length_compatible(len_a: Column, len_b: Column, threshold: float) -> Column:
    """Whether lengths alone leave a global distance within `threshold` possible."""
    return F.least(len_a, len_b) >= F.lit(1 - threshold) * F.greatest(len_a, len_b)


def _steps(s: Wfa2Distance) -> tuple[int, int, list[tuple[int, int]]]:
    """Keys of a match, a mismatch, and (open, extend) of both gap pieces."""
    unit = _B * _B
    gaps = [(s.gap_open * unit, s.gap_extend * unit - _B), (s.gap_open2 * unit, s.gap_extend2 * unit - _B)]
    return s.match * unit - _B - 1, s.mismatch * unit - _B, gaps[:1] if gaps[0] == gaps[1] else gaps


def decode(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, alignment length, matches) of keys."""
    q, matches = np.divmod(-key, _B)
    cost, length = np.divmod(q, _B)
    return -cost, length, matches


def _row(prev_h, prev_d, diag_step, first_column, gaps):
    """Next row of the recurrence from the last; arrays are (pairs x columns)."""
    width = prev_h.shape[1]
    down = [np.minimum(prev_h + (o + e), d + e) for (o, e), d in zip(gaps, prev_d, strict=True)]
    h = down[0].copy()
    for d in down[1:]:
        np.minimum(h, d, out=h)
    np.minimum(h[:, 1:], prev_h[:, :-1] + diag_step, out=h[:, 1:])
    h[:, 0] = first_column
    base = h.copy()
    for o, e in gaps:
        ramp = np.arange(width, dtype=np.int64) * e
        across = np.minimum.accumulate(base - ramp, axis=1) + ramp + o
        np.minimum(h[:, 1:], (across[:, :-1] + e), out=h[:, 1:])
    return h, down


def _gap(k, gaps):
    return min(o + k * e for o, e in gaps) if k else 0


def align_batch(a: Sequence[str], b: Sequence[str], scores: Wfa2Distance, free: str = "none"):
    """(cost, length, matches) arrays of pairs; with free ends, of the part before the free gap."""
    match, mismatch, gaps = _steps(scores)
    out = np.zeros(len(a), np.int64)
    order = np.argsort([len(x) for x in a], kind="stable")
    widest = max((len(x) for x in b), default=0) + 1
    size = max(1, _CHUNK_CELLS // widest)
    for at in range(0, len(order), size):
        own = order[at : at + size]
        la, lb = np.array([len(a[i]) for i in own]), np.array([len(b[i]) for i in own])
        n, m = int(la.max()), int(lb.max())
        left = np.zeros((len(own), n), np.uint32)
        right = np.full((len(own), m), 1 << 31, np.uint32)
        for k, i in enumerate(own):
            left[k, : la[k]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), "<u4")
            right[k, : lb[k]] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.tile(np.array([_gap(j, gaps) for j in range(m + 1)], np.int64), (len(own), 1))
        d = [np.full_like(h, _FAR) for _ in gaps]
        rows = np.arange(len(own))
        best = np.full(len(own), _FAR, np.int64)
        columns = np.arange(m + 1)

        def close(i, h=None, la=la, lb=lb, best=best, rows=rows, columns=columns):
            """Take the keys of cells where pairs may end in row i."""
            if free == "both":
                np.minimum(best, h[rows, lb], out=best)
            done = la == i
            if done.any():
                if free == "none":
                    best[done] = h[rows, lb][done]
                else:
                    inside = np.where(columns <= lb[done][:, None], h[done], _FAR)
                    best[done] = np.minimum(best[done], inside.min(axis=1))

        close(0, h)
        for i in range(1, n + 1):
            step = np.where(right == left[:, i - 1 : i], match, mismatch)
            h, d = _row(h, d, step, _gap(i, gaps), gaps)
            close(i, np.where((la >= i)[:, None], h, _FAR) if free == "both" else h)
        out[own] = best
    return decode(out)


def distances(a: Sequence[str], b: Sequence[str], config: AlignDistance, span: str = "global") -> np.ndarray:
    """Distance of each pair; two empty sequences are at 0."""
    _, length, matches = align_batch(a, b, scores_of(config), free_ends(config, span))
    return np.where(length > 0, (length - matches) / np.maximum(length, 1), 0.0)


def operations(a: str, b: str, scores: Wfa2Distance, free: str = "none") -> str:
    """One best alignment as a string of M, X, I, D, free end gaps included."""
    match, mismatch, gaps = _steps(scores)
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for s in (a, b))
    n, m = len(x), len(y)
    h = np.array([[_gap(j, gaps) for j in range(m + 1)]], np.int64)
    d = [np.full_like(h, _FAR) for _ in gaps]
    grid_h = [h[0]]
    for i in range(1, n + 1):
        h, d = _row(h, d, np.where(y == x[i - 1], match, mismatch)[None, :], _gap(i, gaps), gaps)
        grid_h.append(h[0])
    i, j, tail = n, m, ""
    if free != "none":
        cells = [(grid_h[n][k], n, k) for k in range(m + 1)]
        if free == "both":
            cells += [(grid_h[k][m], k, m) for k in range(n)]
        key = min(c[0] for c in cells)
        _, i, j = next(c for c in reversed(cells) if c[0] == key)
        tail = "D" * (n - i) + "I" * (m - j)
    out = []
    while i or j:
        here = grid_h[i][j]
        if i and j and here == grid_h[i - 1][j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            out.append("M" if x[i - 1] == y[j - 1] else "X")
            i, j = i - 1, j - 1
            continue
        # a gap of k letters ends here: the first k whose start explains the cell
        for k in range(1, max(i, j) + 1):
            cost = _gap(k, gaps)
            if k <= i and here == grid_h[i - k][j] + cost:
                out.append("D" * k)
                i -= k
                break
            if k <= j and here == grid_h[i][j - k] + cost:
                out.append("I" * k)
                j -= k
                break
        else:
            raise AssertionError("no step explains a cell")
    return "".join(reversed(out)) + tail


def run_lengths(ops: str) -> str:
    out, at = [], 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[at]:
            out.append(f"{k - at}{ops[at]}")
            at = k
    return "".join(out)


def cigar(a: str, b: str, config: AlignDistance, span: str = "global") -> str:
    """Run-length CIGAR for gap-affine alignment, one letter a column for edit distance."""
    ops = operations(a, b, scores_of(config), free_ends(config, span))
    return ops if isinstance(config, EdlibDistance) else run_lengths(ops)


def gapped(a: str, b: str, config: AlignDistance, span: str = "global") -> tuple[str, str]:
    """Both sequences with '-' where the other goes on alone."""
    left, right, i, j = [], [], 0, 0
    for op in operations(a, b, scores_of(config), free_ends(config, span)):
        left.append("-" if op == "I" else a[i])
        right.append("-" if op == "D" else b[j])
        i += op != "I"
        j += op != "D"
    return "".join(left), "".join(right)


def gap_details(ops: str, extension: bool = False) -> tuple[int, int, int, int, int]:
    """align_length, n_insert, n_delete, max_insert, max_delete of a column-wise alignment."""
    body = ops.rstrip("ID") if extension else ops
    runs, best = {"I": 0, "D": 0}, {"I": 0, "D": 0}
    for op in body:
        if op in runs:
            runs[op] += 1
            best[op] = max(best[op], runs[op])
        else:
            runs = {"I": 0, "D": 0}
    return len(ops), body.count("I"), body.count("D"), best["I"], best["D"]


def align(config: AlignDistance, span: str = "global"):
    """Column function (a, b) -> distance; null where either is."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            ok = a.notna() & b.notna()
            out = pd.Series(np.nan, index=a.index, dtype="float64").astype("Float64")
            out[:] = pd.NA
            if ok.any():
                out[ok] = distances(a[ok].tolist(), b[ok].tolist(), config, span)
            yield out

    return run


def cigars(config: AlignDistance, span: str = "global"):
    """Column function (a, b) -> CIGAR; null where either is."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(
                [None if pd.isna(x) or pd.isna(y) else cigar(x, y, config, span) for x, y in zip(a, b, strict=True)], dtype=object
            )

    return run


def pairwise_alignment(config: AlignDistance, span: str = "global"):
    """Column function (a, b) -> struct (a, b) of gapped strings."""

    @F.pandas_udf("a string, b string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = [(None, None) if pd.isna(x) or pd.isna(y) else gapped(x, y, config, span) for x, y in zip(a, b, strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b"], index=a.index)

    return run


__all__ = [
    "HammingDistance", "align", "align_batch", "cigar", "cigars", "distances", "edit_bound", "gap_details", "gapped",
    "length_compatible", "operations", "pairwise_alignment", "run_lengths",
]
