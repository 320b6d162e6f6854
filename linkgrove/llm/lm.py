"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood n-gram estimates of all orders with a uniform one.
The weights depend on the frequency bucket of the longest context and are learned by
expectation-maximisation: one tenth of the documents is deleted from the counts, its
tokens are the held-out counts, and the rest gives the estimates. Every step adds up the
expected counts of all held-out tokens in the tasks; the driver sees a few sums for each
context bucket. The final estimates use all training documents.

How it runs. Documents become blocks of bounded size (a local vocabulary, token
numbers, document ends) in the shared folder. Every block sends its distinct n-grams,
as sorted 64-bit hashes with their counts, to buckets of the hash range; a bucket adds
the counts of all blocks and answers only where the total differs from what the block
knows by itself. Blocks joined with their answers then hold every count they need.
A frequent n-gram is one entry a block, so no key is hot; buckets follow the number of
tokens, and no task holds more than a block or a bucket. Empty buckets of a block send
nothing, so there are never more rows than entries.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import LOWER, UPPER, free_shuffles, staged, table, unstage

ORDER = 3
FOLDS = 10
#: Documents of this remainder are scored only; of the next, deleted to learn the weights.
HELD_OUT, DELETED = 0, 1
#: Tokens of a block and n-gram entries of a bucket: what one Python task holds.
BLOCK = 1_300_000
BUCKET_ENTRIES = 1_000_000
#: Buckets of the context frequency: 0, 1, 2-3, 4-7, ...
CONTEXTS = 20
#: Bits of an n-gram's key beyond those of the number of tokens: another n-gram has the same key with a chance of 2**-20.
SPARE_BITS = 20
#: Most steps of EM, and the change of a weight below which it ends.
ITERATIONS, TOLERANCE = 30, 1e-3
LEAST_UNIFORM = 1e-4
ALPHA = 0.1
#: Tokens that no word can equal, as they hold a blank.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

BLOCK_SCHEMA = "block long, vocab binary, ids binary, docs binary, tokens long, train long, model long, model_docs long, train_docs long"
COUNT_SCHEMA = "bucket int, kind int, block long, keys binary, model binary, deleted binary"
ANSWER_SCHEMA = "block long, kind int, bucket int, at binary, model binary, deleted binary, known long, known_model long"


def _zip(a: np.ndarray) -> bytes:
    """Bytes by significance, so that equal high bytes stand together, then zstandard."""
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unzip(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, "<u8"), dtype=np.uint64)


def key_bits(tokens: int) -> int:
    """Leading bits of an n-gram's hash that tell the n-grams of a corpus apart; single words keep all 64."""
    return min(64, max(32, int(tokens).bit_length() + SPARE_BITS))


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and the next word's hash."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def remainder(doc_id: int | None) -> int:
    """crc32 of the doc_id as text, modulo FOLDS; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class _Builder:
    """Gathers documents until they fill a block."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int, int]] = []  # doc_id, is null, tokens, remainder
        self.tokens = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        ws = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        number = self.numbers
        ids = np.fromiter(map(number.__getitem__, ws), np.uint32, len(ws))
        self.parts += [ids, np.array([number[b" end"]], np.uint32)]
        self.docs.append((doc_id or 0, int(doc_id is None), len(ws) + 1, remainder(doc_id)))
        self.tokens += len(ws) + 1

    def row(self, block: int) -> dict:
        digest = xxhash.xxh64_intdigest
        vocab = np.fromiter(map(digest, self.numbers), np.uint64, len(self.numbers))
        docs = np.array(self.docs, np.int64)
        train = docs[:, 3] != HELD_OUT
        model = train & (docs[:, 3] != DELETED)
        return {
            "block": block,
            "vocab": vocab.tobytes(),
            "ids": _zip(np.concatenate(self.parts)),
            "docs": docs.tobytes(),
            "tokens": self.tokens,
            "train": int(docs[train, 2].sum()),
            "model": int(docs[model, 2].sum()),
            "model_docs": int(model.sum()),
            "train_docs": int(train.sum()),
        }


def _blocks(size: int):
    schema = pa.schema(
        [(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in BLOCK_SCHEMA.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        builder = _Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                builder.add(doc_id.as_py(), text.as_py())
                if builder.tokens >= size:
                    yield pa.RecordBatch.from_pylist([builder.row(number)], schema)
                    number, builder = number + 1, _Builder()
        if builder.docs:
            yield pa.RecordBatch.from_pylist([builder.row(number)], schema)

    return run


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and each value's place among them; leaner than np.unique."""
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    keys = ranked[fresh]
    del ranked
    at = np.empty(len(values), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return keys, at


class Block:
    """A block's tokens and, for each order, its distinct n-grams."""

    def __init__(self, row: dict, order: int, bits: int):
        self.bits = [64, *[bits] * (order - 1)]
        vocab = np.frombuffer(row["vocab"], np.uint64)
        words = vocab[_unzip(row["ids"], "<u4")]
        self.docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 4)
        ends = np.cumsum(self.docs[:, 2])
        self.begins = ends - self.docs[:, 2]
        rem = np.repeat(self.docs[:, 3], self.docs[:, 2])
        self.deleted_tokens = rem == DELETED
        model_tokens = (rem != DELETED) & (rem != HELD_OUT)
        self.keys, self.at, self.model, self.deleted = [], [], [], []
        grams = words
        for k in range(1, order + 1):
            if k > 1:
                context = np.empty_like(words)
                context[1:] = grams[:-1]
                context[self.begins] = START
                grams = mix(context, words)
            keys, at = _numbered(grams >> np.uint64(64 - self.bits[k - 1]))
            self.keys.append(keys)
            self.at.append(at)
            self.model.append(np.bincount(at[model_tokens], minlength=len(keys)))
            self.deleted.append(np.bincount(at[self.deleted_tokens], minlength=len(keys)))

    def cuts(self, kind: int, buckets: int) -> np.ndarray:
        """Where the key range's buckets begin among this block's keys of an order."""
        edges = np.array([(b << self.bits[kind - 1]) // buckets for b in range(buckets)], np.uint64)
        return np.append(np.searchsorted(self.keys[kind - 1], edges), len(self.keys[kind - 1]))

    def take(self, answer: dict, buckets: int, cuts: dict) -> None:
        kind, bucket = answer["kind"], answer["bucket"]
        if kind not in cuts:
            cuts[kind] = self.cuts(kind, buckets)
        at = cuts[kind][bucket] + _unzip(answer["at"], "<u4").astype(np.int64)
        self.model[kind - 1][at] = _unzip(answer["model"], "<u8")
        self.deleted[kind - 1][at] = _unzip(answer["deleted"], "<u8")

    def estimates(self, counts: list[np.ndarray], total: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(orders x tokens) maximum-likelihood estimates and each token's longest context count."""
        out = np.zeros((len(counts), len(self.at[0])))
        out[0] = counts[0][self.at[0]] / max(1, total)
        context = np.full(len(self.at[0]), total, np.int64)
        for k in range(1, len(counts)):
            context = np.empty(len(self.at[0]), np.int64)
            context[1:] = counts[k - 1][self.at[k - 1][:-1]]
            context[self.begins] = docs
            np.divide(counts[k][self.at[k]], context, out=out[k], where=context > 0)
        return out, context


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXTS - 1)


def _send(order: int, buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order, bits)
                for kind in range(1, order + 1):
                    cuts = block.cuts(kind, buckets)
                    out = []
                    for b in range(buckets):
                        own = slice(cuts[b], cuts[b + 1])
                        if own.start == own.stop:
                            continue
                        out.append({
                            "bucket": b,
                            "kind": kind,
                            "block": row["block"],
                            "keys": _zip_sorted(block.keys[kind - 1][own]),
                            "model": _zip(block.model[kind - 1][own].astype("<u4")),
                            "deleted": _zip(block.deleted[kind - 1][own].astype("<u4")),
                        })
                    yield pa.RecordBatch.from_pylist(out, _COUNT_ARROW)

    return run


_COUNT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("model", pa.binary()), ("deleted", pa.binary())]
)
_ANSWER_ARROW = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("at", pa.binary()), ("model", pa.binary()), ("deleted", pa.binary()), ("known", pa.int64()), ("known_model", pa.int64())]
)


def _add_up(group: pa.Table) -> pa.Table:
    """Totals of one bucket and order; a row for each block whose counts differ, and one with distinct counts."""
    rows = group.to_pylist()
    keys = [_unzip_sorted(r["keys"]) for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    distinct, at = _numbered(np.concatenate(keys))
    del keys
    own, total = {}, {}
    for what in ("model", "deleted"):
        own[what] = np.concatenate([_unzip(r[what], "<u4") for r in rows])
        total[what] = np.bincount(at, weights=own[what], minlength=len(distinct)).astype(np.uint64)
    out = [{
        "block": -1, "kind": rows[0]["kind"], "bucket": rows[0]["bucket"],
        "known": int(((total["model"] + total["deleted"]) > 0).sum()), "known_model": int((total["model"] > 0).sum()),
    }]
    for r, end, begin in zip(rows, ends, [0, *ends[:-1]], strict=True):
        here = at[begin:end]
        m, d = total["model"][here], total["deleted"][here]
        differs = np.flatnonzero((m != own["model"][begin:end]) | (d != own["deleted"][begin:end]))
        if len(differs):
            out.append({
                "block": r["block"], "kind": r["kind"], "bucket": r["bucket"], "at": _zip(differs.astype("<u4")),
                "model": _zip(m[differs].astype("<u8")), "deleted": _zip(d[differs].astype("<u8")),
            })
    return pa.Table.from_pylist(out, _ANSWER_ARROW)


def _answered(own: pa.Table, answers: pa.Table, order: int, buckets: int, bits: int) -> Block:
    block = Block(own.to_pylist()[0], order, bits)
    cuts: dict[int, np.ndarray] = {}
    for batch in answers.to_batches():
        for row in batch.to_pylist():
            block.take(row, buckets, cuts)
    return block


HELD_SCHEMA = "context binary, p binary"


def _held(order: int, buckets: int, bits: int, stats: dict):
    """The deleted tokens' context buckets (bytes) and estimates (orders x tokens, 32-bit floats), one row a block."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        context, p = np.empty(0, np.int64), np.empty((order, 0))
        if own.num_rows:
            block = _answered(own, answers, order, buckets, bits)
            p, context = block.estimates(block.model, stats["model"], stats["model_docs"])
            p, context = p[:, block.deleted_tokens], context[block.deleted_tokens]
        data = [context_bucket(context).astype(np.uint8).tobytes()], [p.astype("<f4").tobytes()]
        return pa.table([pa.array(x, pa.binary()) for x in data], names=["context", "p"])

    return run


def expectations(context: np.ndarray, p: np.ndarray, uniform: float, weights: np.ndarray) -> np.ndarray:
    """(CONTEXTS x order+1) expected counts of each estimate, by the tokens' context buckets."""
    share = np.vstack([np.full(len(context), uniform), p]) * weights[context].T
    share /= share.sum(axis=0)
    return np.column_stack([np.bincount(context, x, CONTEXTS) for x in share])


def _expect(order: int, uniform: float, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape)
        for batch in batches:
            for context, p in zip(*batch.columns, strict=True):
                c = np.frombuffer(context.as_py(), np.uint8).astype(np.int64)
                if len(c):
                    total += expectations(c, np.frombuffer(p.as_py(), "<f4").reshape(order, -1).astype(np.float64), uniform, weights)
        cells = [np.repeat(np.arange(CONTEXTS, dtype=np.int32), order + 1), np.tile(np.arange(order + 1, dtype=np.int32), CONTEXTS), total.ravel()]
        yield pa.record_batch([pa.array(x) for x in cells], names=["bucket", "part", "n"])

    return run


def learn_weights(expect: Callable[[np.ndarray], np.ndarray], order: int) -> np.ndarray:
    """(CONTEXTS x order+1) mixture weights by EM from equal ones: uniform first, then rising orders.

    `expect` gives the expected counts under weights. A context bucket without held-out
    tokens takes the weights of the next lower one.
    """
    weights = np.full((CONTEXTS, order + 1), 1 / (order + 1))
    some = np.zeros(CONTEXTS, bool)
    for _ in range(ITERATIONS):
        counts = expect(weights)
        some = counts.sum(axis=1) > 0
        after = weights.copy()
        after[some] = counts[some] / counts[some].sum(axis=1, keepdims=True)
        after[:, 0] = np.maximum(after[:, 0], LEAST_UNIFORM)
        after /= after.sum(axis=1, keepdims=True)
        change = np.abs(after - weights).max()
        weights = after
        if change < TOLERANCE:
            break
    for b in range(1, CONTEXTS):
        if not some[b]:
            weights[b] = weights[b - 1]
    return weights


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, buckets: int, bits: int, stats: dict, weights: np.ndarray):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            empty = [[], [], [], [], [], [], []]
        else:
            block = _answered(own, answers, order, buckets, bits)
            counts = [m + d for m, d in zip(block.model, block.deleted, strict=True)]
            p, context = block.estimates(counts, stats["train"], stats["train_docs"])
            w = weights[context_bucket(context)]
            mixed = w[:, 0] / (stats["v"] + 1)
            for k in range(order):
                mixed = mixed + w[:, k + 1] * p[k]
            c = counts[0][block.at[0]]
            base = np.log10((c + ALPHA) / (stats["train"] + ALPHA * (stats["v"] + 1)))
            add = lambda x: np.add.reduceat(x, block.begins)
            d = block.docs
            empty = [
                np.where(d[:, 1] == 1, None, d[:, 0]).tolist(), d[:, 3] == HELD_OUT, d[:, 2], add((c > 0).astype(np.int64)),
                np.full(len(d), stats["train"]), add(base), add(np.log10(mixed)),
            ]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
        return pa.table([pa.array(x, k) for x, k in zip(empty, kinds, strict=True)], names=names)

    return run


def score_documents(docs: DataFrame, order: int = ORDER, block: int = BLOCK, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per input row, see SCORE_SCHEMA; logarithms to base 10.

    Null or empty text: the end token alone. Null doc_id: the crc32 of no bytes
    decides its fold. Repeated rows count as often as they appear. No training
    documents, or no documents: every estimate is zero and the uniform one is left.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = staged(plain.mapInArrow(_blocks(block), BLOCK_SCHEMA), "lm-blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train", "model", "model_docs", "train_docs")]).first()
    stats = sums.asDict()
    buckets = max(4, -(-stats["tokens"] // bucket_entries))
    bits = key_bits(stats["tokens"])
    sent = blocks.mapInArrow(_send(order, buckets, bits), COUNT_SCHEMA)
    answers = staged(sent.groupBy("bucket", "kind").applyInArrow(_add_up, ANSWER_SCHEMA), "lm-answers")
    del sent
    free_shuffles(spark)
    seen = answers.where("block = -1 and kind = 1").agg(
        F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("known_model"), F.lit(0)).alias("v_model")
    )
    stats |= seen.first().asDict()
    to_blocks = answers.where("block >= 0").groupBy("block")
    held = staged(blocks.groupBy("block").cogroup(to_blocks).applyInArrow(_held(order, buckets, bits, stats), HELD_SCHEMA), "lm-held")
    free_shuffles(spark)

    def expect(weights: np.ndarray) -> np.ndarray:
        parts = held.mapInArrow(_expect(order, 1 / (stats["v_model"] + 1), weights), "bucket int, part int, n double")
        out = np.zeros(weights.shape)
        for bucket, part, n in parts.groupBy("bucket", "part").agg(F.sum("n")).collect():  # one row a weight
            out[bucket, part] = n
        return out

    weights = learn_weights(expect, order)
    unstage(held)
    free_shuffles(spark)
    return (
        blocks.groupBy("block").cogroup(to_blocks).applyInArrow(_scores(order, buckets, bits, stats, weights), SCORE_SCHEMA)
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


__all__ = ["learn_weights", "op2_lm_scoring", "score_documents", "unstage"]
