"""Hierarchical packing of token ids into sequences of several context sizes.

Documents are tokenized and packed where they are read, in pools of bounded size, so
nothing is shuffled. In a pool every whole window of the longest tier is a sequence
of its own; each tail goes to the smallest tier that holds it, tiers are packed from
the longest down, gaps of long windows are filled with whole tails of shorter tiers,
best fit first, and then with a piece cut from one. Only what the pool's end leaves
is cut into powers of two, so no sequence needs padding.

Sequences of one tier form step groups of equal token counts; a snake deal over the
attention cost, the sum of squared piece lengths, balances the groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import table
from linkgrove.llm.tokens import encoded, encoder

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Tokens of a pool; a worker holds one pool, and at least one document.
POOL = 2_000_000
#: Tokens of a step group: 32 of the longest sequences or as many shorter ones.
STEP_TOKENS = 32 * 1024
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


@dataclass
class Sequence:
    tier: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # (document of the pool, start, length)
    used: int = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.used += length

    @property
    def cost(self) -> int:
        return sum(n * n for _, _, n in self.pieces)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Sequence]:
    """Sequences that hold every token of documents of these lengths in one piece exactly.

    Tiers must be falling powers of two. Every sequence is full: its length is a tier
    or, at the end only, a smaller power of two. Documents of length 0 have no piece.
    """
    top = tiers[0]
    out: list[Sequence] = []
    tails: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # ascending (length, doc, start)
    for doc, n in enumerate(lengths):
        for at in range(0, n - top + 1, top):
            whole = Sequence(top)
            whole.add(doc, at, top)
            out.append(whole)
        if tail := n % top:
            tails[min(t for t in tiers if t >= tail)].append((tail, doc, n - tail))
    for own in tails.values():
        own.sort()

    def fill(seq: Sequence, below: list[int]) -> None:
        """Fill what `seq` lacks from these tiers, longest first; cut one piece for the rest."""
        while (gap := seq.tier - seq.used) and any(tails[t] for t in below):
            fit = next((t for t in below if tails[t] and tails[t][0][0] <= gap), None)
            if fit is not None:
                length, doc, start = tails[fit].pop(bisect_right(tails[fit], (gap, 1 << 62, 0)) - 1)
                seq.add(doc, start, length)
                continue
            source = next(t for t in reversed(below) if tails[t])
            length, doc, start = tails[source].pop(0)
            seq.add(doc, start, gap)
            rest = length - gap
            insort(tails[min(t for t in tiers if t >= rest)], (rest, doc, start + gap))

    for k, tier in enumerate(tiers):
        while tails[tier]:
            if sum(n for t in tiers[k:] for n, _, _ in tails[t][: 2 * tier]) < tier:
                break  # less than a window is left in this and all shorter tiers
            length, doc, start = tails[tier].pop()
            seq = Sequence(tier)
            seq.add(doc, start, length)
            fill(seq, list(tiers[k:]))
            out.append(seq)
    rest = [x for t in tiers for x in tails[t]]
    left = sum(n for n, _, _ in rest)
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        seq = Sequence(size)
        while seq.used < size:
            length, doc, start = rest.pop()
            take = min(length, size - seq.used)
            seq.add(doc, start, take)
            if take < length:
                rest.append((length - take, doc, start + take))
        out.append(seq)
        left -= size
    return out


def step_groups(sequences: list[Sequence], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: one tier, equal token counts, attention costs dealt by snake."""
    out = [0] * len(sequences)
    first = 0
    for tier in sorted({s.tier for s in sequences}, reverse=True):
        own = sorted((i for i, s in enumerate(sequences) if s.tier == tier), key=lambda i: -sequences[i].cost)
        n = max(1, -(-len(own) * tier // step_tokens))
        for rank, i in enumerate(own):
            lap, place = divmod(rank, n)
            out[i] = first + (place if lap % 2 == 0 else n - 1 - place)
        first += n
    return out


def _pool_rows(ids: list[int | None], tokens: list[np.ndarray], base: int, group_base: int) -> tuple[pa.RecordBatch, int, int]:
    sequences = pack([len(t) for t in tokens])
    groups = step_groups(sequences)
    rows: list[tuple] = []
    for k, seq in enumerate(sequences):
        offset = 0
        for doc, start, length in seq.pieces:
            crc = zlib.crc32(tokens[doc][start : start + length].tobytes())
            rows.append(
                (ids[doc], start, length, crc, len(tokens[doc]), base + k, offset, seq.tier, group_base + groups[k])
            )
            offset += length
    columns = list(zip(*rows, strict=True))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    return batch, len(sequences), max(groups) + 1


def packer(path: str, end_id: int = END_ID, pool: int = POOL):
    """The function that mapInArrow runs: (doc_id, text) batches to piece rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, joined=True)
        base = group_base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, own in encoded(enc, batch.column(0), batch.column(1)):
                ids.append(doc_id)
                tokens.append(np.append(own, np.uint32(end_id)).astype("<u4"))
                held += len(own) + 1
                if held >= pool:
                    out, n, g = _pool_rows(ids, tokens, base, group_base)
                    yield out
                    base, group_base, ids, tokens, held = base + n, group_base + g, [], [], 0
        if ids:
            yield _pool_rows(ids, tokens, base, group_base)[0]

    return run


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece, see SCHEMA: every id of every document in exactly one piece.

    `tokenizer` is the vocabulary file, the same path on all machines. Null or empty
    text: one id, the end. Repeated rows and null doc_ids are packed like others, each
    on its own. A sequence_id is unique in the result and its offsets have no gaps.
    Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        packer(tokenizer), SCHEMA
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
