"""Exact substring dedup over all documents by bounded interval expansion on BWTs.

A byte goes if a string of MIN_LENGTH bytes that covers it also starts earlier, in a
smaller doc_id or earlier in its document; strings are judged on the input.

A suffix structure over 100 TB fits no machine, so equal strings are first brought
together. Each string of 100 bytes holds one minimizer, its least-hashed K bytes
(leftmost on ties), at a place that depends on the string alone. For each minimizer a
document reports a hash of the segment around it, which holds all strings that it can
stand for. Where a segment repeats, its later occurrences are covered wholly. Where
one minimizer has different segments, the first occurrence of each goes, as text, to
the hash bucket of the minimizer, so every pair of equal strings meets there.

In a bucket the Burrows-Wheeler transform of the segments is searched breadth first by
backward extension: intervals of all strings of length 1, 2, 3, ... give the common
prefixes of neighbouring suffixes in rising order, and the search ends below
MIN_LENGTH. The borders it did not find separate suffixes that share 100 bytes.

A map task keeps only its first occurrence of each segment, so a passage in a third of
all documents costs one entry a task; buckets follow the number of bytes.

A minimizer inside boilerplate may have as many different segments as there are
documents. Such heavy minimizers are told by a sample of the texts, which decides where
things are compared and nothing else: their segments are dealt to buckets one by one,
and those whose surroundings stand elsewhere too meet string by string, by 128-bit hash in
an aggregation with partial sums, so no bucket holds a heavy minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import free_shuffles, staged, table

MIN_LENGTH = 100
K = 32
#: Bytes that numpy handles at once, and the slices that longer texts are cut into.
CHUNK = 1 << 19
#: Entries that a map task sorts at once; entries and segment bytes of a bucket.
FLUSH = 400_000
BUCKET_ENTRIES = 300_000
BUCKET_BYTES = 700_000
NO_ID = -(1 << 63)
COVER, NEED, HEAVY = 0, 1, 2
#: One text of SAMPLE tells heavy minimizers, those with SAMPLED different segments in it: about a bucket full; the most that every task is told.
SAMPLE, SAMPLED, MOST_HEAVY = 32, 128, 500_000
#: Grid of the contexts of heavy minimizers; divides the places that a minimizer can have in a string.
STEP = 17

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), "<u8").copy()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or next(iter(_POWERS)) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        out = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return next(iter(_POWERS.values()))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by prefix and suffix minima of blocks."""
    n = len(a)
    pad = -n % w
    blocks = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def minimizers(items: list[tuple[bytes, int, int, int]], length: int = MIN_LENGTH, k: int = K):
    """(item, place in its document, minimizer hash, segment hash) arrays.

    An item is (bytes, where they start in the document, first and end of the strings'
    starts in the bytes); the bytes reach `length` beyond both where the document does.
    """
    w = length - k + 1
    sizes = np.array([len(x[0]) for x in items])
    data = np.frombuffer(b"".join(x[0] for x in items), np.uint8)
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    grams = _scramble((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w)
    begins = np.cumsum(sizes) - sizes
    valid = np.zeros(len(least) + 1, np.int32)
    for b, (_, _, first, stop) in zip(begins, items, strict=True):
        if stop > first:
            valid[b + first] += 1
            valid[b + stop] -= 1
    at = np.unique((least[np.cumsum(valid[:-1]) > 0] & low).astype(np.int64))
    item = np.searchsorted(begins, at, "right") - 1
    left = np.minimum(at - begins[item], w - 1)
    right = np.minimum(begins[item] + sizes[item] - at, length)
    segment = (sums[at + right] - sums[at - left]) * down[at - left]
    segment = _scramble(segment + left.astype(np.uint64) * np.uint64(0x9E37) + right.astype(np.uint64) * np.uint64(0xABCD1))
    place = at - begins[item] + np.array([x[1] for x in items])[item]
    # a minimizer's hash is a small number; scrambled again it spreads over the buckets
    return item, place, _scramble(grams[at]) >> np.uint64(16), segment


def slices(data: bytes, length: int = MIN_LENGTH, size: int = CHUNK) -> Iterator[tuple[bytes, int, int, int]]:
    """Items that hold all strings of a document, each string in one."""
    strings = len(data) - length + 1
    for a in range(0, max(0, strings), size):
        low = max(0, a - 2 * length)
        stop = min(strings, a + size)
        yield data[low : stop + 3 * length], low, a - low, stop - low


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _text_hash(data: bytes) -> int:
    """As Spark's xxhash64 of the text."""
    return int(np.uint64(xxhash.xxh64_intdigest(data, 42)).view(np.int64))


def _pack(a: np.ndarray) -> bytes:
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 48-bit key; rising with the key."""
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _is_heavy(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(keys), bool)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys


def _firsts(h, s, doc, text, at):
    """Order of entries by (h, s, document, place) and marks: first of a segment, repeat of one elsewhere."""
    order = np.lexsort((at, text, doc, s, h))
    h, s, doc, text, at = (x[order] for x in (h, s, doc, text, at))
    same = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    first = np.concatenate([[True], ~same])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    elsewhere = (doc != doc[lead]) | (text != text[lead]) | (at != at[lead])
    return order, first, elsewhere


def _spans(doc: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[dict]:
    """Cover rows, one a document, of spans [a, b)."""
    if not len(doc):
        return
    order = np.lexsort((a, text, doc))
    doc, text, a, b = (x[order] for x in (doc, text, a, b))
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
    for low, high in zip(cut, [*cut[1:], len(doc)], strict=True):
        spans = merge_spans(a[low:high], b[low:high])
        yield {"kind": COVER, "doc": int(doc[low]), "text_hash": int(text[low]), "data": spans.astype("<i8").tobytes()}


def merge_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, 2) disjoint rising spans that cover the same bytes."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > b[:-1]])
    last = np.concatenate([first[1:], [True]])
    return np.column_stack([a[first], b[last]])


_ENTRY_ARROW = pa.schema([
    ("bucket", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("keys", pa.binary()), ("segments", pa.binary()),
    ("docs", pa.binary()), ("owner", pa.binary()), ("place", pa.binary()), ("reach", pa.binary()), ("data", pa.binary()),
])
ENTRY_SCHEMA = "bucket int, doc long, text_hash long, keys binary, segments binary, docs binary, owner binary, place binary, reach binary, data binary"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("data", pa.binary())])
FOUND_SCHEMA = "kind int, doc long, text_hash long, data binary"


def _report(buckets: int, heavy: np.ndarray):
    """Map side: minimizers of every document, first of each segment by bucket, covers of the others.

    The bucket is that of the minimizer, for heavy ones that of minimizer and segment.
    """

    def flush(parts: list, docs: list[tuple[int, int, int]]):
        owner, place, h, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        table_ = np.array(docs, np.int64)
        doc, text, size = table_[owner].T
        order, first, elsewhere = _firsts(h, s, doc, text, place)
        left = np.minimum(place, MIN_LENGTH - K)
        again = order[~first & elsewhere]
        covers = _spans(doc[again], text[again], place[again] - left[again], np.minimum(size, place + MIN_LENGTH)[again])
        for k, row in enumerate(covers):
            yield {"bucket": k % buckets, "doc": row["doc"], "text_hash": row["text_hash"], "data": row["data"]}
        keep = order[first]
        alone = _scramble(h[keep] ^ s[keep]) >> np.uint64(16)
        b = _bucket_of(np.where(_is_heavy(h[keep], heavy), alone, h[keep]), buckets)
        by_bucket = np.argsort(b, kind="stable")
        keep, b = keep[by_bucket], b[by_bucket]
        for k in np.unique(b):
            low, high = np.searchsorted(b, [k, k + 1])
            own = keep[low:high]
            used, local = np.unique(owner[own], return_inverse=True)
            yield {
                "bucket": int(k),
                "keys": _pack(np.diff(h[own], prepend=np.uint64(0))),
                "segments": _pack(s[own]),
                "docs": table_[used].astype("<i8").tobytes(),
                "owner": _pack(local.astype("<u4")),
                "place": _pack(place[own].astype("<i8")),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, int]] = []
        parts: list = []
        held: list[tuple[bytes, int, int, int]] = []
        owners: list[int] = []
        size = entries = 0

        def work():
            nonlocal held, owners, size, entries
            item, place, h, s = minimizers(held)
            parts.append((np.array(owners)[item], place, h, s))
            entries += len(item)
            held, owners, size = [], [], 0

        def rows(found):
            batch = []
            for row in found:
                batch.append(row)
                if len(batch) == 512:
                    yield pa.RecordBatch.from_pylist(batch, _ENTRY_ARROW)
                    batch = []
            if batch:
                yield pa.RecordBatch.from_pylist(batch, _ENTRY_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = _bytes(text.as_py())
                if len(data) < MIN_LENGTH:
                    continue
                if entries >= FLUSH:
                    if held:
                        work()
                    yield from rows(flush(parts, docs))
                    docs, parts, entries = [], [], 0
                doc = doc_id.as_py()
                docs.append((NO_ID if doc is None else doc, _text_hash(data), len(data)))
                for item in slices(data):
                    held.append(item)
                    owners.append(len(docs) - 1)
                    size += len(item[0])
                    if size >= CHUNK:
                        work()
        if held:
            work()
        if parts:
            yield from rows(flush(parts, docs))

    return run


def _compare(heavy: np.ndarray):
    """Bucket side: covers of repeated segments; needs, segments whose minimizer has others too or is heavy."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        parts = []
        for batch in group.to_batches():
            for row in batch.to_pylist():
                if row["data"] is not None:
                    out.append({"kind": COVER, "doc": row["doc"], "text_hash": row["text_hash"], "data": row["data"]})
                    continue
                h = np.cumsum(_unpack(row["keys"], "<u8"), dtype=np.uint64)
                docs = np.frombuffer(row["docs"], "<i8").reshape(-1, 3)[_unpack(row["owner"], "<u4")]
                parts.append((h, _unpack(row["segments"], "<u8"), docs[:, 0], docs[:, 1], _unpack(row["place"], "<i8"), docs[:, 2]))
        if parts:
            h, s, doc, text, at, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order, first, elsewhere = _firsts(h, s, doc, text, at)
            again = order[~first & elsewhere]
            out += _spans(
                doc[again], text[again], np.maximum(at[again] - (MIN_LENGTH - K), 0), np.minimum(size, at + MIN_LENGTH)[again]
            )
            lead = order[first]
            same = h[lead][1:] == h[lead][:-1]
            hot = _is_heavy(h[lead], heavy)
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            for kind, own in ((NEED, lead[several & ~hot]), (HEAVY, lead[hot])):
                if not len(own):
                    continue
                by = own[np.lexsort((at[own], text[own], doc[own]))]
                d, t = doc[by], text[by]
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
                for low, high in zip(cut, [*cut[1:], len(by)], strict=True):
                    pairs = np.column_stack([at[by[low:high]], h[by[low:high]].astype(np.int64)])
                    out.append({"kind": kind, "doc": int(d[low]), "text_hash": int(t[low]), "data": pairs.astype("<i8").tobytes()})
        return pa.Table.from_pylist(out, _FOUND_ARROW)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, s) of the segments of texts."""
    for batch in batches:
        for text in batch.column(0):
            for item in slices(_bytes(text.as_py())):
                _, _, h, s = minimizers([item])
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(s.view(np.int64))], names=["h", "s"])


def heavy_minimizers(texts: DataFrame) -> np.ndarray:
    """Rising keys of the minimizers with very many different segments, judged by a sample of the texts."""
    sample = texts.where((F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0) & (F.octet_length("text") >= MIN_LENGTH))
    counts = sample.mapInArrow(_sampled, "h long, s long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") >= SAMPLED).orderBy(F.desc("n"), "h").limit(MOST_HEAVY).select("h").toPandas()["h"]
    return np.sort(most.to_numpy(np.int64).view(np.uint64))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with heavy needs to (k1, k2, doc, text_hash, at, h): hashes of what lies around each heavy minimizer.

    A string holds the minimizer, `a` bytes before it and the rest behind it. With `a`
    cut to a grid of STEP, two segments with a common string have a common context, which
    is STEP bytes shorter than the string.
    """
    names = ["k1", "k2", "doc", "text_hash", "at", "h"]
    for batch in batches:
        for doc, text_hash, text, needs in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            found, at, h = [], [], []
            for place, key in np.unique(np.frombuffer(b"".join(needs.as_py()), "<i8").reshape(-1, 2), axis=0).tolist():
                for before in range(0, MIN_LENGTH - K - STEP + 1, STEP):
                    low, high = place - before, place - before + MIN_LENGTH - STEP
                    if low >= 0 and high <= len(data):
                        found.append(xxhash.xxh3_128_digest(data[low:high], before))
                        at.append(place)
                        h.append(key)
            keys = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            n = len(at)
            columns = [keys[:, 0], keys[:, 1], np.full(n, doc.as_py()), np.full(n, text_hash.as_py()), np.array(at, np.int64), np.array(h, np.int64)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_hash, text, places of minimizers) to (k1, k2, doc, text_hash, at): the hash of every string around them."""
    for batch in batches:
        for doc, text_hash, text, places in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            starts = np.unique(np.array(places.as_py(), np.int64)[:, None] - np.arange(MIN_LENGTH - K + 1))
            starts = starts[(starts >= 0) & (starts + MIN_LENGTH <= len(data))]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a : a + MIN_LENGTH]) for a in starts.tolist()), "<i8").reshape(-1, 2)
            n = len(starts)
            columns = [keys[:, 0], keys[:, 1], np.full(n, doc.as_py()), np.full(n, text_hash.as_py()), starts]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "doc", "text_hash", "at"])


def _cover_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_hash, starts of repeated strings) to cover rows."""
    for batch in batches:
        out = []
        for doc, text_hash, starts in zip(*batch.columns, strict=True):
            a = np.array(starts.as_py(), np.int64)
            out.append({"kind": COVER, "doc": doc.as_py(), "text_hash": text_hash.as_py(), "data": merge_spans(a, a + MIN_LENGTH).astype("<i8").tobytes()})
        yield pa.RecordBatch.from_pylist(out, _FOUND_ARROW)


def heavy_covers(texts: DataFrame) -> DataFrame:
    """Cover rows of (doc, text_hash, text, needs): strings around heavy minimizers that also start earlier.

    Only minimizers with a context that stands elsewhere too make strings.
    """
    columns = "k1 long, k2 long, doc long, text_hash long, at long"
    contexts = staged(texts.mapInArrow(_contexts, f"{columns}, h long"), "suffix-contexts")
    shared = contexts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
    places = contexts.join(shared, ["k1", "k2"], "left_semi").groupBy("doc", "text_hash").agg(F.collect_set("at").alias("places"))
    near = texts.drop("needs").join(places, ["doc", "text_hash"]).select("doc", "text_hash", "text", "places")
    strings = staged(near.mapInArrow(_strings, columns), "suffix-strings")
    firsts = strings.groupBy("k1", "k2").agg(F.min(F.struct("doc", "text_hash", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = strings.join(firsts.where("n > 1"), ["k1", "k2"]).where(F.struct("doc", "text_hash", "at") > F.col("first"))
    return later.groupBy("doc", "text_hash").agg(F.collect_list("at").alias("starts")).mapInArrow(_cover_strings, FOUND_SCHEMA)


SEGMENT_SCHEMA = "bucket int, doc long, text_hash long, starts binary, sizes binary, body binary"
_SEGMENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())]
)


def _cut_segments(buckets: int):
    """Texts with needs to the segments' bytes, one row a document and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text_hash, text, needs in zip(*batch.columns, strict=True):
                data = _bytes(text.as_py())
                pairs = np.frombuffer(b"".join(needs.as_py()), "<i8").reshape(-1, 2)
                b = _bucket_of(pairs[:, 1].astype(np.uint64), buckets)
                for k in np.unique(b):
                    places = np.unique(pairs[b == k, 0])
                    low = np.maximum(places - (MIN_LENGTH - K), 0)
                    high = np.minimum(places + MIN_LENGTH, len(data))
                    # overlapping segments of one bucket are one piece
                    spans = merge_spans(low, high)
                    out.append({
                        "bucket": int(k), "doc": doc.as_py(), "text_hash": text_hash.as_py(),
                        "starts": spans[:, 0].astype("<i8").tobytes(), "sizes": (spans[:, 1] - spans[:, 0]).astype("<i8").tobytes(),
                        "body": b"".join(data[x:y] for x, y in spans),
                    })
            if out:
                yield pa.RecordBatch.from_pylist(out, _SEGMENT_ARROW)

    return run


def bounded_suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers ordered by at least their first `depth` values, by prefix doubling.

    Values are 8-bit; the end counts as smaller than any value.
    """
    n = len(data)
    packed = np.zeros(n, np.uint64)
    wide = np.concatenate([data, np.zeros(8, data.dtype)])
    for k in range(8):
        packed = (packed << np.uint64(8)) | wide[k : k + n]
    order = np.argsort(packed)
    reach = 8
    sorted_keys = packed[order]
    while True:
        fresh = np.concatenate([[0], (sorted_keys[1:] != sorted_keys[:-1]).astype(np.int64)])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        if reach >= depth or int(fresh.sum()) == n - 1:
            return order
        second = np.zeros(n, np.uint64)
        if reach < n:
            second[: n - reach] = rank[reach:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + second
        order = np.argsort(key)
        sorted_keys = key[order]
        reach *= 2


def common_prefix_borders(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and borders: border[i] says that suffixes i-1 and i of it share under `least` values.

    Backward extension over the Burrows-Wheeler transform, breadth first: the interval
    of w gives those of cw for each c before it, found from the next and the previous
    row with the same value; an interval whose end is a new border lives on. Borders
    come by rising common prefix, and the search stops at `least`.
    """
    n = len(data)
    order = bounded_suffix_order(data, least)
    before = data[order - 1]  # row of suffix 0 takes the last value, as on a circle
    by_value = np.argsort(before, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_value] = np.arange(n, dtype=np.int32)
    values = before[by_value]
    switch = np.concatenate([[True], values[1:] != values[:-1]])
    none = np.array([-1], np.int32)
    previous, following = np.empty(n, np.int32), np.empty(n, np.int32)
    previous[by_value] = np.where(switch, none, np.concatenate([none, by_value[:-1]]))
    following[by_value] = np.where(np.append(switch[1:], True), np.int32(n), np.concatenate([by_value[1:], none]))
    del before, values, by_value
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    low = np.flatnonzero(switch)
    high = np.append(low[1:], n) - 1
    for _ in range(least):
        new = ~border[high + 1]
        new |= high + 1 == n  # the last interval of a value ends at the end, not at a new border
        low, high = low[new], high[new]
        border[high + 1] = True
        if not len(low):
            break
        width = high - low + 1
        single = width == 1
        ends = [lf[high[single]]]
        begins = [ends[0]]
        low, high, width = low[~single], high[~single], width[~single]
        if len(low):
            stop = np.cumsum(width)
            rows = np.arange(stop[-1]) + np.repeat(low - (stop - width), width)
            ends.append(np.sort(lf[rows[following[rows] > np.repeat(high, width)]]))
            begins.append(np.sort(lf[rows[previous[rows] < np.repeat(low, width)]]))
        low, high = np.concatenate(begins), np.concatenate(ends)
    return order, border[:n]


def repeated_spans(pieces: list[tuple[int, int, int, bytes]], length: int = MIN_LENGTH):
    """(doc, text_hash, a, b) arrays: strings of the pieces (doc, text_hash, start, bytes) that also start earlier."""
    body = b"\x00".join(p[3] for p in pieces) + b"\x00"
    data = np.frombuffer(body, np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    inside = np.arange(len(data)) - begins[piece]
    whole = inside + length <= sizes[piece]
    doc, text, start = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
    ranked = np.lexsort((text, doc))
    d, t = doc[ranked], text[ranked]
    rank = np.empty(len(pieces), np.int64)
    rank[ranked] = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
    key = (rank[piece] << 40) + start[piece] + inside
    order, border = common_prefix_borders(data, length)
    cls = np.cumsum(border)
    held = whole[order]
    at, cls = order[held], cls[held]
    if not len(at):
        return doc[:0], text[:0], doc[:0], doc[:0]
    cut = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    least = np.minimum.reduceat(key[at], cut)
    later = np.sort(at[key[at] > np.repeat(least, np.diff(np.append(cut, len(at))))])
    p = piece[later]
    a = start[p] + inside[later]
    return doc[p], text[p], a, a + length


def _expand(group: pa.Table) -> pa.Table:
    pieces = []
    for batch in group.to_batches():
        for row in batch.to_pylist():
            at = 0
            for start, size in zip(np.frombuffer(row["starts"], "<i8").tolist(), np.frombuffer(row["sizes"], "<i8").tolist(), strict=True):
                pieces.append((row["doc"], row["text_hash"], start, row["body"][at : at + size]))
                at += size
    return pa.Table.from_pylist(list(_spans(*repeated_spans(pieces))), _FOUND_ARROW)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows = []
        for doc_id, text, covers in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            found = [np.frombuffer(c, "<i8").reshape(-1, 2) for c in covers.as_py() or ()]
            kept, removed, spans = data, 0, ()
            if found:
                both = np.concatenate(found)
                spans = merge_spans(both[:, 0], both[:, 1])
                edges = [0, *spans.reshape(-1).tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                removed = len(data) - len(kept)
            rows.append((doc_id.as_py(), len(data), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary): one row per input row.

    Null text: no bytes. Texts under MIN_LENGTH bytes stay whole. Rows equal in doc_id
    and text are one document and get one result; other rows of one doc_id are ordered
    by a hash of the text; a null doc_id comes first. `kept` need not be valid UTF-8,
    as a cut may fall inside a character. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a text is found again by doc_id and hash, so rows without doc_id meet as little as others
    keyed = plain.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "doc_id", "text")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4, -(-size * 2 // (MIN_LENGTH - K + 2) // BUCKET_ENTRIES))
    heavy = heavy_minimizers(plain.select("text"))
    free_shuffles(spark)
    reported = plain.mapInArrow(_report(buckets, heavy), ENTRY_SCHEMA)
    found = staged(reported.groupBy("bucket").applyInArrow(_compare(heavy), FOUND_SCHEMA), "suffix-found")
    del reported
    free_shuffles(spark)

    def wanted(kind: int) -> DataFrame:
        needs = found.where(F.col("kind") == kind).groupBy("doc", "text_hash").agg(F.collect_list("data").alias("needs"))
        texts = keyed.select("doc", "text_hash", "text").join(needs, ["doc", "text_hash"])
        # repeated rows are one text
        return texts.groupBy("doc", "text_hash").agg(F.first("text").alias("text"), F.first("needs").alias("needs"))

    need_bytes = (
        found.where(F.col("kind") == NEED).agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0] // 16 * (2 * MIN_LENGTH - K)
    )
    parts = max(4, -(-need_bytes // BUCKET_BYTES))
    segments = wanted(NEED).mapInArrow(_cut_segments(parts), SEGMENT_SCHEMA)
    expanded = staged(segments.groupBy("bucket").applyInArrow(_expand, FOUND_SCHEMA), "suffix-expanded")
    del segments
    free_shuffles(spark)
    all_covers = found.where(F.col("kind") == COVER).unionByName(expanded)
    if len(heavy):
        all_covers = all_covers.unionByName(staged(heavy_covers(wanted(HEAVY)), "suffix-heavy"))
        free_shuffles(spark)
    covers = all_covers.groupBy("doc", "text_hash").agg(F.collect_list("data").alias("covers"))
    return (
        keyed.join(covers, ["doc", "text_hash"], "left")
        .select("doc_id", "text", "covers")
        .mapInArrow(
            _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        )
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
