import random
import re

import xxhash
from linkgrove.llm import simhash
from pyspark.sql import functions as F


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{f:016x}", least[root(i)]) for i, (d, f) in enumerate(fps)), key=str)


def test_documents(small, small_rows):
    got = sorted(map(tuple, simhash.near_duplicates(small).collect()), key=str)
    assert got == brute_components(small_rows)


def test_odd_rows(odd, odd_rows, none):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    assert got == brute_components([r[:2] for r in odd_rows])
    assert simhash.near_duplicates(none).collect() == []


def test_no_link_is_missed(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))))
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1, 1 << 63, 1 << 31, 3 << 31}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.links(frame).collect()}
    expect = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == expect


def test_anchors_are_never_broadcast(spark, tmp_path):
    """A table of fingerprints that is small on disk has 17 anchors a row, too many for the driver."""
    spark.range(5000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    frame = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_anchor_count(spark):
    row = spark.range(2000).select(F.size(simhash.near_anchors(F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))))).toPandas()
    assert set(row.iloc[:, 0]) <= {2, 17}


def test_long_chain(spark):
    value, values = 0, [0]
    for b in range(0, 64, 2):
        value |= 3 << b
        values.append(value - (1 << 64) if value >> 63 else value)
    from linkgrove.operators.components import components

    reach = components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    assert {r.component for r in reach} == {min(values)} and len(reach) == len(values) - 1
