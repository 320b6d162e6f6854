"""SimHash near-dedup by anchor points of a covering code.

Fingerprints that differ in at most two of 64 bits agree in one 32-bit half up to one
bit. In each half the anchors are the codewords of the perfect [31,26] Hamming code
with a free top bit: covering radius 1, so every half lies within 1 of its home
anchor, and every other half within one bit of it lies within radius plus threshold,
2, of that same anchor. A fingerprint therefore goes to its home anchor as the left
side of the comparison and to all 17 or fewer anchors within distance 2 as the right
side. No link can be missed, and an anchor holds few fingerprints: there are 2**27.

Exact copies of a fingerprint are one node; links are kept between different
fingerprints only, and components come from link tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import LOWER, UPPER, bind, staged, table
from linkgrove.operators.components import components

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Texts are hashed in slices of this many shingles, which bounds a worker's memory.
SLICE = 200_000
#: Fingerprints whose anchors one task lists.
NODES_A_TASK = 20_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a text; null or no words: 0.

    A text with fewer than three words is one shingle of all its words.
    """
    ws = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not ws:
        return 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    total = max(1, len(ws) - SHINGLE + 1)
    for at in range(0, total, SLICE):
        part = ws[at : at + SLICE + SHINGLE - 1]
        if len(part) < SHINGLE:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _over_half(ones, total)


def _over_half(ones: np.ndarray, total: int) -> int:
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingles that are hashed already; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[at : at + SLICE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _over_half(ones, len(hashes))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _syndrome(half: Column) -> Column:
    """Which of the bits 1-31 (0: none) to flip to reach the codeword: XOR of set bits' numbers."""
    out = F.lit(0).cast("long")
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        parity = F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2
        out = out + parity.cast("long") * F.lit(1 << k)
    return out


def _flip(half: Column, position: Column) -> Column:
    """Flip bit number `position` (1-31); 0 leaves the word as it is."""
    one = F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))
    return half.bitwiseXOR(F.coalesce(one, F.lit(0).cast("long")))


def home_anchor(half: Column) -> Column:
    return _flip(half, _syndrome(half))


def near_anchors(half: Column) -> Column:
    """Homes of all words within one bit: every anchor within radius plus threshold that can hold a partner.

    Flipping bit p changes the syndrome s to s XOR p, so one syndrome serves all words.
    """

    def homes(s: Column) -> Column:
        flips = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda p: _flip(_flip(half, p.cast("long")), p.cast("long").bitwiseXOR(s)),
        )
        other = _flip(half, s).bitwiseXOR(F.lit(1 << 31).cast("long"))
        return F.array_distinct(F.concat(flips, F.array(other)))

    return bind(_syndrome(half), homes)


def _halves(fps: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    return fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("side"), h.alias("half")) for i, h in enumerate((low, high))
    ])).alias("x")).select("fp", "x.side", "x.half")


def leaders(fps: DataFrame, within: int) -> DataFrame:
    """(u, v): each fingerprint u with the leaders v, within so many bits, of the anchors that it lies near.

    `fps` has distinct `fp`. One fingerprint leads all that have an anchor for their home,
    so a large group of near copies makes at most 34 pairs a member. Two fingerprints
    within three bits meet if no third shares their anchors; further ones by chance.
    """
    halves = _halves(fps)
    lead = (
        halves.select("side", home_anchor(F.col("half")).alias("anchor"), "fp")
        .groupBy("side", "anchor")
        .agg(F.min_by("fp", F.xxhash64("fp")).alias("v"))
    )
    near = halves.select(F.col("fp").alias("u"), "side", F.explode(near_anchors(F.col("half"))).alias("anchor"))
    close = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= within)
    return near.hint("merge").join(lead, ["side", "anchor"]).where(close).select("u", "v").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(u, v): pairs u < v of different fingerprints within THRESHOLD bits, each at most once a half.

    `fps` has distinct `fp`. The comparison is part of the join, so only true links
    leave it. The hint keeps both sides plain exchanges, whose skewed anchors AQE splits:
    Spark's estimate leaves out that a row becomes 17, and would broadcast them all.
    """
    halves = _halves(fps)
    left = halves.select(F.col("fp").alias("u"), "side", home_anchor(F.col("half")).alias("anchor"))
    right = halves.select(F.col("fp").alias("v"), "side", F.explode(near_anchors(F.col("half"))).alias("anchor"))
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD)
    return (
        left.join(right.hint("merge"), (left["side"] == right["side"]) & (left["anchor"] == right["anchor"]) & close)
        .select("u", "v")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    component_id is the least doc_id reachable through links, the row itself
    included. Null or empty texts have fingerprint zero and link like any other.
    Repeated rows stay repeated. A null doc_id gets a component like any row but
    never names one; a component of null doc_ids alone has a null id.
    """
    own = staged(fingerprints(docs), "simhash-fingerprints")
    rows = own.count()
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # short rows, but much work for each: tasks by their number, not by their bytes
    spread = own.select("fp").distinct().repartition(max(1, -(-rows // NODES_A_TASK)), "fp")
    reach = components(links(spread), "simhash-components")
    grouped = nodes.join(reach, nodes["fp"] == reach["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    named = staged(grouped, "simhash-groups", rows)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(roots, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
