import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from linkgrove.llm import suffixdedup as sd


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a dictionary of all strings."""
    docs = {}
    for d, t in rows:
        data = (t or "").encode()
        key = (d is not None, d or 0, sd._text_hash(data))
        docs.setdefault(key, data)
    seen, gone = set(), {}
    for key in sorted(docs):
        data = docs[key]
        marks = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                marks[i : i + length] = b"\x01" * length
            seen.add(s)
        gone[key] = marks
    out = []
    for d, t in rows:
        data = (t or "").encode()
        m = gone[d is not None, d or 0, sd._text_hash(data)]
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        kept = bytes(b for b, x in zip(data, m, strict=True) if not x)
        out.append((d, len(data), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, sd.remove_repeats(frame).drop("kept").collect()), key=str)


@pytest.fixture(params=["as it is", "many heavy minimizers"])
def weights(request, monkeypatch):
    """With the second, minimizers of two different segments count as heavy."""
    if request.param != "as it is":
        monkeypatch.setattr(sd, "SAMPLE", 1)
        monkeypatch.setattr(sd, "SAMPLED", 2)


def test_documents(small, small_rows, weights):
    assert result(small) == brute(small_rows)


def test_odd_rows(odd, odd_rows, none, weights):
    assert result(odd) == brute([r[:2] for r in odd_rows])
    assert result(none) == []


def test_edited_copies(spark, weights):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé \n") for _ in range(900)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        a = rng.randrange(300)
        rows.append((rng.randrange(10**6), "".join(t[a : a + rng.randrange(90, 700)])))
    rows += [(10**7, "ab" * 400), (10**7 + 1, "a" * 250), (10**7 + 2, "a" * 99), (10**7 + 3, "a" * 100)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_boilerplate_fills_no_bucket(spark):
    """One license line of 83 bytes in 20,000 otherwise different texts: its segments are spread over the buckets."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    line = letters(83)
    texts = [letters(60) + line + letters(60) for _ in range(20000)]
    heavy = sd.heavy_minimizers(spark.createDataFrame([(t,) for t in texts], "text string").repartition(8))
    assert len(heavy)

    def largest(heavy):
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        sizes = {}
        for out in sd._report(64, heavy)(iter([batch])):
            for row in out.to_pylist():
                if row["data"] is None:
                    sizes[row["bucket"]] = sizes.get(row["bucket"], 0) + len(sd._unpack(row["segments"], "<u8"))
        return max(sizes.values()) - sum(sizes.values()) / 64

    bound = 1.5 * sd.SAMPLE * sd.SAMPLED  # segments that one minimizer may have without counting as heavy
    assert largest(heavy[:0]) > 2 * bound and largest(heavy) < bound


def test_rows_without_id(spark):
    """Texts without doc_id are apart from each other, in the order of their hashes."""
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(None, "".join(rng.choices("xyz ", k=40)) + shared) for _ in range(12)] + [(None, shared), (None, shared), (4, shared)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_text_hash_is_that_of_the_engine(spark, odd):
    for text, h in odd.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect():
        assert sd._text_hash(text.encode()) == h


def test_slices_of_long_texts(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    whole = {(int(p), int(h), int(s)) for _, p, h, s in zip(*sd.minimizers(list(sd.slices(data))), strict=True)}
    parts = {(int(p), int(h), int(s)) for _, p, h, s in zip(*sd.minimizers(list(sd.slices(data, size=170))), strict=True)}
    assert whole == parts
    places = sorted(p for p, _, _ in whole)
    for i in range(len(data) - 99):
        assert any(i <= p <= i + 68 for p in places)


def test_borders_are_common_prefixes():
    rng = np.random.default_rng(4)
    for n, letters, least in ((1, 2, 3), (40, 2, 5), (300, 3, 4), (500, 1, 7), (700, 2, 20)):
        data = rng.integers(1, letters + 1, n).astype(np.uint8)
        data[-1] = 0
        order, border = sd.common_prefix_borders(data, least)
        text = [data[i : i + least].tobytes() for i in order]
        assert text == sorted(text)
        for i in range(1, n):
            assert border[i] == (text[i] != text[i - 1] or len(text[i]) < least), (n, i)
