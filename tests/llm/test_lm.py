import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from linkgrove.llm import lm


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " end"]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


def grams(ts, order):
    """For each token its n-grams of every order as (context, word); texts begin with a start that no context goes beyond."""
    out, last = [], None
    for i, w in enumerate(ts):
        own = [((), w)]
        for k in range(2, order + 1):
            own.append(((" start",) if i == 0 else last[k - 2], w))
        last = [(*c, w) for c, w in own]
        out.append(own)
    return out


def counts(rows, folds, order):
    found, docs, n = [Counter() for _ in range(order)], 0, 0
    for d, t in rows:
        if fold(d) in folds:
            for own in grams(tokens(t), order):
                n += 1
                for k in range(order):
                    found[k][own[k]] += 1
            docs += 1
    return found, docs, n, len(found[0])


def brute(rows, order):
    """Exact interpolation; EM runs on the deleted tokens themselves."""

    def parts(own, model):
        found, docs, n, v = model
        p, c = [1 / (v + 1), found[0][own[0]] / max(1, n)], n
        for k in range(1, order):
            context = own[k][0]
            c = docs if context == (" start",) else found[k - 1][context[:-1], context[-1]]
            p.append(found[k][own[k]] / c if c else 0)
        return min(c.bit_length(), lm.CONTEXTS - 1), p

    model = counts(rows, set(range(2, 10)), order)
    held = [parts(own, model) for d, t in rows if fold(d) == 1 for own in grams(tokens(t), order)]

    def expect(weights):
        out = np.zeros(weights.shape)
        for b, p in held:
            share = weights[b] * p
            out[b] += share / share.sum()
        return out

    weights = lm.learn_weights(expect, order)
    model = found, _, n, v = counts(rows, set(range(1, 10)), order)
    out = {}
    for d, t in rows:
        ts = tokens(t)
        base = sum(math.log10((found[0][(), x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)
        score = 0.0
        for own in grams(ts, order):
            k, p = parts(own, model)
            score += math.log10(float(weights[k] @ p))
        out[d, t] = (fold(d) == 0, len(ts), sum(found[0][(), x] > 0 for x in ts), n, base, score)
    return out


def check(frame, rows, **settings):
    got = lm.score_documents(frame, **settings).collect()
    expect = brute(rows, settings.get("order", lm.ORDER))
    assert len(got) == len(rows)
    by_id = {}
    for (d, _), e in expect.items():
        by_id.setdefault(d, []).append(e)
    for r in got:
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
            and r.base_score == pytest.approx(e[4], rel=1e-9)
            and r.score == pytest.approx(e[5], rel=1e-5)
            for e in by_id[r.doc_id]
        ), r


def test_documents(small, small_rows):
    check(small, small_rows)


def test_many_blocks_and_buckets(small, small_rows):
    check(small.repartition(5), small_rows, block=3000, bucket_entries=7000)


def test_odd_rows(odd, odd_rows, none):
    check(odd, [r[:2] for r in odd_rows], block=100)
    assert lm.score_documents(none).collect() == []


def test_only_held_out_documents(spark):
    ids = [k for k in range(200) if fold(k) == 0][:3]
    rows = lm.score_documents(spark.createDataFrame([(k, "a b c") for k in ids], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_bigrams(odd, odd_rows):
    check(odd, [r[:2] for r in odd_rows], order=2)


def test_longer_contexts_predict_held_out_documents(small):
    total = {k: lm.score_documents(small, order=k).where("held_out").agg({"score": "sum", "base_score": "sum"}).first() for k in (1, 3)}
    assert total[3]["sum(score)"] > total[1]["sum(score)"] and total[3]["sum(score)"] > total[3]["sum(base_score)"]


def test_weights_prefer_what_predicts():
    context = np.full(1000, 3)
    p = np.vstack([np.full(1000, 0.01), np.where(np.arange(1000) < 900, 0.5, 0)])
    w = lm.learn_weights(lambda weights: lm.expectations(context, p, 1e-5, weights), 2)
    assert w[3, 2] > 0.8 and abs(w.sum(axis=1) - 1).max() < 1e-9
    assert (w[4] == w[3]).all()


def test_em_never_loses_likelihood():
    rng = np.random.default_rng(7)
    context, p = rng.integers(0, lm.CONTEXTS, 3000), rng.random((3, 3000)) ** 3
    seen = []

    def expect(weights):
        seen.append(np.log((np.vstack([np.full(3000, 0.01), p]) * weights[context].T).sum(axis=0)).sum())
        return lm.expectations(context, p, 0.01, weights)

    lm.learn_weights(expect, 3)
    assert len(seen) > 3 and all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False))


def test_keys_grow_with_the_corpus():
    assert [lm.key_bits(n) for n in (0, 1 << 20, 1 << 30, 1 << 43, 1 << 60)] == [32, 41, 51, 64, 64]


def test_long_text(spark):
    """A text of 300,000 words among short ones."""
    rows = [(k, " ".join(f"w{(i * i + k) % 997}" for i in range(300_000 if k == 2 else 30))) for k in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
