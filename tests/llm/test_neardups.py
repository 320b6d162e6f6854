import random
import re
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from linkgrove.llm import neardups, simhash
from pyspark.sql import functions as F


def brute_shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute_groups(texts):
    """Sets of positions of connected texts, by all pairs."""
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(i)
    return list(groups.values())


@pytest.fixture(scope="module")
def edited():
    """Texts with edited copies on both sides of 0.8, chains of edits and a stock passage in many."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    stock = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for k in range(40):
        ws = [rng.choice(vocab) for _ in range(rng.choice([7, 30, 120, 240]))]
        if k % 3 == 0:
            ws = stock + ws[:40]
        for _ in range(rng.choice([1, 2, 6])):
            texts.append(" ".join(ws))
            ws = list(ws)
            for _ in range(max(1, len(ws) // rng.choice([40, 50, 60]))):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
    texts += [f"{' '.join(stock)} end {k}" for k in range(40)] + ["a b", "A b", "", None, "x"]
    rng.shuffle(texts)
    return texts


def expected(texts):
    return {min(g) for g in brute_groups(texts)}


def test_stage_against_brute_force(spark, edited):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string").repartition(5)
    got = [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(edited)


def test_stage_on_documents(spark, small, small_rows):
    got = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, small, "").collect()}
    firsts = {min(small_rows[i][0] for i in g) for g in brute_groups([t for _, t in small_rows])}
    assert got == firsts and not {145, 177} & got


def test_any_order_of_shingles_is_exact(spark, edited, monkeypatch):
    monkeypatch.setattr(neardups, "OFTEN", 10**9)
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    assert {r.doc_id for r in neardups.keep_first(docs).collect()} == expected(edited)


def test_odd_rows(odd, odd_rows, none):
    kept = neardups.keep_first(odd)
    assert kept.schema == odd.schema and neardups.keep_first(none).collect() == []
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    groups = [[odd_rows[i][0] for i in g] for g in brute_groups([r[1] for r in odd_rows])]
    # rows that repeat, share a doc_id or have none leave one row a group as well
    assert ids == sorted((min((d for d in g if d is not None), default=None) for g in groups), key=str)


def test_stage_joins_by_fingerprint_first(spark, monkeypatch):
    """Near copies whose SimHashes differ in up to three bits meet at anchors, before any prefix is compared."""
    rng = random.Random(11)
    texts, bits = [], []
    for _ in range(60):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(ws), " ".join([*ws[:-1], "edited"])]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        x, y = (simhash.of_hashes(neardups.shingle_set(t)) for t in (a, b))
        bits.append((x ^ y).bit_count())
    made = {}
    staged = neardups.staged

    def spy(df, name, *more):
        out = staged(df, name, *more)
        if name in ("near-anchored", "near-links"):
            made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neardups, "staged", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == set(range(0, 120, 2))
    assert made["near-anchored"][0] >= made["near-links"][0] >= sum(b <= 3 for b in bits) > 50


def test_fingerprints_of_hashes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 64):
        hs = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert simhash.of_hashes(hs) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hs) > n)


def test_prefix_and_sets():
    assert [neardups.probe_size(n) for n in (0, 1, 4, 5, 9, 10, 30)] == [0, 1, 1, 2, 2, 3, 7]
    for text in (None, "", "one", "a b c d e", "a b c d e a b c d e a", "x " * 50):
        assert len(neardups.shingle_set(text)) == len(brute_shingles(text))


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(3)
    for _ in range(300):
        whole = np.array(rng.sample(range(1 << 40), 60), np.uint64)
        x, y = (np.unique(whole[[k for k in range(60) if rng.random() < 0.7]]) for _ in range(2))
        differ = sum(int(b).bit_count() for b in (neardups.sketch(x) ^ neardups.sketch(y)).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y))


def test_stock_passage_makes_few_candidates(spark, monkeypatch):
    """A passage of 60 words in 600 texts that are otherwise different: pairs follow the texts, not their square."""
    rng = random.Random(8)
    stock = [f"s{k}" for k in range(60)]
    texts = [" ".join([f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(16, 60))] + stock) for _ in range(600)]
    pairs = []
    staged = neardups.staged

    def spy(df, name, *more):
        out = staged(df, name, *more)
        if name == "near-candidates":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(neardups, "staged", spy)
    kept = neardups.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 600 and sum(pairs) < 600
