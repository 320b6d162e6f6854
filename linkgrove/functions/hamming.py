"""Distances of aligned sequences, position by position.

Lower-case letters are insertions outside the alignment and are left out; A, C, G, T
are valid; anything else is a gap. Sequences must then have one length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrove.config import HammingDistance


def aligned(seq: Column) -> Column:
    return F.regexp_replace(seq, "[a-z]", "")


def _codes(seq: Column) -> Column:
    return F.split(aligned(seq), "")


def hamming_distance(a: Column, b: Column, config: HammingDistance | None = None) -> Column:
    """Column distance; 1.0 where nothing, or less than min_overlap, can be compared.

    ignore_gaps compares positions where both are valid. Otherwise positions where one
    is valid count, inside the part that both sequences span.
    """
    config = config or HammingDistance()
    pairs = F.zip_with(
        _codes(a),
        _codes(b),
        lambda x, y: F.struct(
            x.isin("A", "C", "G", "T").alias("va"), y.isin("A", "C", "G", "T").alias("vb"), (x == y).alias("same")
        ),
    )

    def ratio(p: Column) -> Column:
        if config.ignore_gaps:
            used = F.filter(p, lambda s: s["va"] & s["vb"])
        else:
            first = F.greatest(F.array_position(F.transform(p, lambda s: s["va"]), True), F.array_position(F.transform(p, lambda s: s["vb"]), True))
            back = F.reverse(p)
            last = F.size(p) + 1 - F.greatest(
                F.array_position(F.transform(back, lambda s: s["va"]), True), F.array_position(F.transform(back, lambda s: s["vb"]), True)
            )
            some = F.exists(p, lambda s: s["va"]) & F.exists(p, lambda s: s["vb"])
            span = F.when(some & (last >= first), F.slice(p, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(p, 1, 0))
            used = F.filter(span, lambda s: s["va"] | s["vb"])
        return F.element_at(
            F.transform(
                F.array(used),
                lambda u: F.when(
                    (F.size(u) > 0) & (F.size(u) >= config.min_overlap),
                    F.size(F.filter(u, lambda s: ~(s["va"] & s["vb"] & s["same"]))).cast("double") / F.size(u),
                ).otherwise(F.lit(1.0)),
            ),
            1,
        )

    return F.element_at(F.transform(F.array(pairs), ratio), 1)


def encode(seqs: list[str]) -> np.ndarray:
    """(sequences x width) byte matrix of the aligned letters; 0 where not valid."""
    kept = [s if s.isascii() and s.upper() == s else "".join(c for c in s if not c.islower()) for s in seqs]
    width = max(map(len, kept), default=0)
    if any(len(k) != width for k in kept):
        raise ValueError("aligned sequences must have one length")
    grid = np.frombuffer("".join(kept).encode("ascii", "replace"), np.uint8).reshape(len(kept), width).copy()
    grid[~np.isin(grid, np.frombuffer(b"ACGT", np.uint8))] = 0
    return grid


def _ends(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    valid = grid > 0
    n = grid.shape[1]
    some = valid.any(axis=1)
    first = np.where(some, valid.argmax(axis=1), n)
    last = np.where(some, n - valid[:, ::-1].argmax(axis=1), 0)
    return first, last


def one_to_many(one: np.ndarray, many: np.ndarray, config: HammingDistance) -> tuple[np.ndarray, np.ndarray]:
    """(mismatches, compared positions) of one encoded sequence with each of many."""
    va, vb = one > 0, many > 0
    equal = (many == one) & va
    if config.ignore_gaps:
        used = va & vb
    else:
        first, last = _ends(many)
        f, e = (x[0] for x in _ends(one[None, :]))
        at = np.arange(len(one))
        inside = (at >= np.maximum(first, f)[:, None]) & (at < np.minimum(last, e)[:, None])
        used = (va | vb) & inside
    compared = used.sum(axis=1)
    return compared - (equal & used).sum(axis=1), compared


def planes(grid: np.ndarray) -> np.ndarray:
    """(4, words, sequences) words of 64 positions: two bits of the letter, whether it is valid, whether the span holds it."""
    first, last = _ends(grid)
    at = np.arange(grid.shape[1])
    span = (at >= first[:, None]) & (at < last[:, None])
    wide = np.zeros((4, len(grid), -(-max(1, grid.shape[1]) // 64) * 64), bool)
    wide[:, :, : grid.shape[1]] = grid & 2, grid & 4, grid > 0, span
    words = np.packbits(wide, axis=2).view(np.uint64)
    return np.ascontiguousarray(words.transpose(0, 2, 1))


def many_to_many(one: np.ndarray, many: np.ndarray, config: HammingDistance) -> tuple[np.ndarray, np.ndarray]:
    """(equal, compared) positions of all planes of one set with all of another, as matrices."""
    kind = np.uint8 if one.shape[1] < 4 else np.uint32
    equal, compared = (np.zeros((one.shape[2], many.shape[2]), kind) for _ in range(2))
    for w in range(one.shape[1]):
        x1, x2, va, sa = one[:, w, :, None]
        y1, y2, vb, sb = many[:, w]
        same = x1 ^ ~y1
        other = x2 ^ ~y2
        same &= other
        both = np.bitwise_and(va, vb, out=other)
        same &= both
        equal += np.bitwise_count(same)
        if not config.ignore_gaps:  # a valid position lies in its own span
            both = va & sb
            both |= vb & sa
        compared += np.bitwise_count(both)
    return equal, compared


def least_equal(width: int, threshold: float, config: HammingDistance) -> np.ndarray:
    """By compared positions, 0..width: the equal ones that a distance within the threshold needs; width + 1 if none do."""
    n = np.arange(width + 1)
    guess = np.clip(np.floor(threshold * n), -1, n).astype(np.int64)
    need = np.full(width + 1, width + 1)
    for wrong in (guess - 1, guess, guess + 1):  # the product may be rounded; the quotient decides
        ok = (n > 0) & (wrong >= 0) & (wrong <= n) & (as_distance(wrong, n, config) <= threshold)
        need = np.where(ok, n - wrong, need)
    return need


def near_pairs(one: np.ndarray, many: np.ndarray, threshold: float, config: HammingDistance, cells: int, inside: bool):
    """(i, j, mismatches, compared) of pairs of planes within the threshold, some `cells` pairs at a time; i < j `inside` one set."""
    need = least_equal(one.shape[1] * 64, threshold, config)
    need = need.astype(np.uint8 if one.shape[1] < 4 else np.uint32)
    step = max(1, cells // max(1, many.shape[2]))
    for lo in range(0, one.shape[2], step):
        equal, compared = many_to_many(one[:, :, lo : lo + step], many, config)
        i, j = np.divmod(np.flatnonzero(equal >= need[compared]), many.shape[2])
        if inside:
            i, j = i[lo + i < j], j[lo + i < j]
        n = compared[i, j].astype(np.int64)
        yield lo + i, j, n - equal[i, j], n


def as_distance(mismatches: np.ndarray, compared: np.ndarray, config: HammingDistance) -> np.ndarray:
    ok = (compared > 0) & (compared >= config.min_overlap)
    return np.where(ok, mismatches / np.maximum(compared, 1), 1.0)


def gap_details(one: np.ndarray, other: np.ndarray) -> tuple[int, int, int, int, int]:
    """align_length, n_insert, n_delete, max_insert, max_delete over the part both span.

    An insertion is valid in `other` only, a deletion in `one` only; a run is ended by
    a position valid in both.
    """
    (f1, e1), (f2, e2) = ((int(x[0][0]), int(x[1][0])) for x in (_ends(one[None, :]), _ends(other[None, :])))
    va, vb = (x[max(f1, f2) : max(min(e1, e2), max(f1, f2))] > 0 for x in (one, other))

    def longest(gap: np.ndarray) -> int:
        best = run = 0
        for g, both in zip(gap, va & vb, strict=True):
            run = run + 1 if g else 0 if both else run
            best = max(best, run)
        return best

    ins, dele = vb & ~va, va & ~vb
    return int((va | vb).sum()), int(ins.sum()), int(dele.sum()), longest(ins), longest(dele)


def check_aligned(df: DataFrame, seq: str = "seq") -> None:
    """Raise unless all aligned sequences have one length."""
    lengths = df.agg(F.min(F.length(aligned(F.col(seq)))).alias("a"), F.max(F.length(aligned(F.col(seq)))).alias("b")).first()
    if lengths["a"] != lengths["b"]:
        raise ValueError(f"aligned sequences have lengths from {lengths['a']} to {lengths['b']}")
