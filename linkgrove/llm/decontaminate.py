"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A document holds a copy of an item if an alignment over words either matches SIMILARITY
of the item's words, or matches SIMILARITY of its own columns over half of the item
(and at least LEAST words): so whole copies, edited ones and passages of an item count.

The items are taken in blocks of bounded size, so what every task gets is bounded too.
A block makes two passes over the documents. The first counts in how many documents
each seed of the items stands. An alignment of a copy keeps a number of the item's
seeds that can be told from the length alone, `kept_seeds`, whatever the edits are. So
a third of that many seeds, the most frequent ones, open nothing: the second pass joins
documents to items by the other, rarer seeds only, and still every copy shows two
thirds of that number, on diagonals that one alignment can reach. Only a document and
an item with so many are aligned. Which they are comes from one sort of the hits of
many documents; pairs that merely share a phrase are never written, nor looked at one
by one, and no copy is lost because its words are frequent.

Documents are never shuffled or joined with each other; rows stay where they were read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import staged, table

#: Words of a seed; shorter than the five words of other operators, as five clean words need not remain in an edited copy.
SEED = 3
#: Words of a seed of items with at most SHORT words, of which an edit may leave no longer run.
SHORT_SEED, SHORT = 2, 5
#: Share of words that an alignment must match, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Least words of a passage of an item that count as a copy; items of fewer words count as a whole.
LEAST = 13
#: (match, other column) of the two alignments: the first bridges long edits, the second stops where copying stops.
LOOSE, TIGHT = (2, -1), (1, -3)
#: Bounds of a pass: items, and words of all its items, which bound what is sent to every task.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 500_000
#: Characters of texts, and entries of seeds in items, that a task handles at once.
PIECE, ENTRIES = 1 << 21, 1 << 21
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def least_span(n: int) -> int:
    """Words of an item of n words that a copy of a passage must span."""
    return max(-(-n // 2), min(n, LEAST))


@cache
def kept_seeds(n: int) -> int:
    """Seeds of an item of n words that every copy keeps.

    A span of s words with m matches has at most m / 4 edits. An edit of an item's word
    breaks as many seeds as a seed has words, an added word one less.
    """
    q = SHORT_SEED if n <= SHORT else SEED
    a, b = SIMILAR
    s = least_span(n) if n > SHORT else n
    left = s
    for changed in range(s // (q + 1) + 1):
        edits = (s - changed) * (b - a) // a
        if edits >= changed:
            left = min(left, s - (q - 1) - q * changed - (q - 1) * (edits - changed))
    return max(1, left)


def reach(n: int) -> int:
    """Words by which a copy of an item of n words may be longer or shorter: one edit for every four matches."""
    return n * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[0] + 1


class Items:
    """A block of items: vocabulary, seeds, and where each seed stands."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [r[0] for r in rows]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(r[1])], np.int64) for r in rows]
        self.base = len(self.vocab) + 1
        self.short = any(SEED <= len(w) <= SHORT for w in self.words)
        own = [self._own(w) for w in self.words]
        flat = np.concatenate([*own, np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(rows)), [len(k) for k in own])
        self.seeds, at = np.unique(flat, return_inverse=True)
        #: Entries (seed, item, place of the seed in the item) in the order of seeds.
        order = np.argsort(at, kind="stable")
        place = np.concatenate([*map(np.arange, map(len, own)), np.empty(0, np.int64)]).astype(np.int64)
        self.entry_seed, self.owner, self.place = at[order], owner[order], place[order]

    def _own(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers)
        if n < SEED:
            return np.empty(0, np.int64)
        return self.keys(numbers, SHORT_SEED if n <= SHORT else SEED)

    def keys(self, numbers: np.ndarray, q: int) -> np.ndarray:
        """Seed keys of q neighbouring words; 0 where a word is unknown. Keys of different q differ."""
        n = len(numbers) - q + 1
        if n < 1:
            return np.empty(0, np.int64)
        key, known = numbers[:n].copy(), numbers[:n] > 0
        for k in range(1, q):
            key = key * self.base + numbers[k : k + n]
            known &= numbers[k : k + n] > 0
        return np.where(known, key, 0)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, 0 for unknown words and after each text, and where each text starts."""
        found = [words(t) for t in texts]
        ends = np.cumsum([len(w) + 1 for w in found])
        get = self.vocab.get
        flat = np.fromiter(map(get, chain.from_iterable((*w, "") for w in found), repeat(0)), np.int64, int(ends[-1]) if len(ends) else 0)
        return flat, np.concatenate([[0], ends]).astype(np.int64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed numbers) of the block's seeds."""
        places, seeds = [], []
        for q in (SEED, SHORT_SEED) if self.short else (SEED,):
            keys = self.keys(numbers, q)
            some = np.flatnonzero(keys)
            if len(some) and len(self.seeds):
                at = np.minimum(np.searchsorted(self.seeds, keys[some]), len(self.seeds) - 1)
                true = self.seeds[at] == keys[some]
                places.append(some[true])
                seeds.append(at[true])
        none = np.empty(0, np.int64)
        return np.concatenate([*places, none]), np.concatenate([*seeds, none])

    def close(self, frequency: np.ndarray) -> None:
        """Let each item's most frequent seeds open nothing, a third of those that every copy keeps."""
        order = np.lexsort((self.entry_seed, -frequency[self.entry_seed], self.owner))
        sizes = np.bincount(self.owner, minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = np.array([kept_seeds(len(w)) for w in self.words], np.int64)
        closed = kept // 3
        opens = np.ones(len(order), bool)
        opens[order] = rank >= closed[self.owner[order]]
        #: Open entries by seed, and how many of its open seeds a copy of each item shows.
        self.entry_seed, self.owner, self.place = self.entry_seed[opens], self.owner[opens], self.place[opens]
        self.first = np.searchsorted(self.entry_seed, np.arange(len(self.seeds) + 1))
        self.least = kept - closed
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.far = np.array([reach(len(w)) for w in self.words], np.int64)

    def common(self, k: int, window: np.ndarray) -> int:
        """Words that item k and a window have in common, repeats counted: no alignment matches more."""
        own, times = np.unique(self.words[k], return_counts=True)
        at = np.minimum(np.searchsorted(own, window), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == window], minlength=len(own)), times).sum())


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about PIECE characters with the place of their first."""
    start, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= PIECE:
            yield start, part
            start, part, size = k + 1, [], 0
    if part:
        yield start, part


def _count(items: Items):
    """(seed, n): in how many rows of the task each seed stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.seeds), np.int64)
        for batch in batches:
            for _, part in _pieces(batch.column(0)):
                numbers, starts = items.numbers(part)
                places, seeds = items.hits(numbers)
                row = np.searchsorted(starts, places, "right")
                once = np.unique(row * max(1, len(total)) + seeds)
                total += np.bincount(once % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["seed", "n"])

    return run


def _cells(item: np.ndarray, text: np.ndarray, rule: tuple[int, int], anchored: bool) -> tuple[int, int, int, int]:
    """Best cell of an alignment matrix: (score, matches, words of the item, words of the text) before it.

    A cell holds its score above 32 bits of matches, so of equal scores the one with more
    matches wins; ties then go to the first cell. A row is a few vector operations on the
    row before, gaps along it a running maximum, so memory is in proportion to the text.
    Local alignments start anywhere, anchored ones at the first word of both.
    """
    match, other = (rule[0] << 32) + 1, rule[1] << 32
    ramp = np.arange(len(text) + 1, dtype=np.int64) * -other
    row = -ramp if anchored else np.zeros(len(text) + 1, np.int64)
    best, at = 0, (0, 0)
    for i, word in enumerate(item.tolist()):
        step = np.where(text == word, match, other)
        step += row[:-1]
        row = row + other
        np.maximum(row[1:], step, out=row[1:])
        if not anchored:
            np.maximum(row, 0, out=row)
        row += ramp
        np.maximum.accumulate(row, out=row)
        row -= ramp
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best >> 32, best & 0xFFFFFFFF, *at


def align(item: np.ndarray, text: np.ndarray, rule: tuple[int, int] = LOOSE) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of two word arrays: (matches, score, start and end in `item`, start and end in `text`).

    Unknown words, number 0 of `text`, match nothing.
    """
    score, matches, i, j = _cells(item, text, rule, False)
    _, _, back, over = _cells(item[:i][::-1], text[:j][::-1], rule, True)
    return matches, score, i - back, i, j - over, j


def copied(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int, int, int] | None:
    """(similarity, matches, score, start, end in `text`) if the text holds a copy of the item, else None."""
    n, (a, b) = len(item), SIMILAR
    matches, score, _, _, start, end = align(item, text)
    if b * matches >= a * n:
        return matches / n, matches, score, start, end
    if b * matches < a * least_span(n):
        return None
    matches, score, first, last, start, end = align(item, text, TIGHT)
    edits = (TIGHT[0] * matches - score) // -TIGHT[1]
    if last - first >= least_span(n) and b * matches >= a * (matches + edits):
        return matches / (matches + edits), matches, score, start, end
    return None


def _windows(items: Items, places: np.ndarray, seeds: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of word ranges where an item from `low` to `high` shows the open seeds of a copy.

    Ranges of one item are disjoint and rise; `places` are those of one or more texts, far enough apart.
    """
    fan = items.first[seeds + 1] - items.first[seeds]
    keys, size, base = [], int(places.max(initial=0)) + 1, int(items.sizes.max(initial=0))
    size += base
    at = 0
    for stop in _cuts(fan):
        f = fan[at:stop]
        entry = np.repeat(items.first[seeds[at:stop]] - (np.cumsum(f) - f), f) + np.arange(f.sum())
        owner = items.owner[entry]
        own = (owner >= low) & (owner < high)
        diagonal = np.repeat(places[at:stop], f)[own] - items.place[entry[own]] + base
        keys.append(owner[own] * size + diagonal)
        at = stop
    key = np.sort(np.concatenate([*keys, np.empty(0, np.int64)]))
    item, diagonal = key // size, key % size
    ahead = np.arange(len(key)) + items.least[item] - 1
    good = np.flatnonzero(ahead < len(key))
    ahead = ahead[good]
    good, ahead = (x[(item[ahead] == item[good]) & (diagonal[ahead] - diagonal[good] <= items.far[item[good]])] for x in (good, ahead))
    last = (-1, 0, 0)
    for k, a, b in zip(item[good].tolist(), (diagonal[good] - base).tolist(), (diagonal[ahead] - base).tolist(), strict=True):
        a, b = a - int(items.far[k]), b + int(items.sizes[k] + items.far[k])
        if k == last[0] and a <= last[2]:
            last = (k, last[1], max(last[2], b))
            continue
        if last[0] >= 0:
            yield last
        last = (k, a, b)
    if last[0] >= 0:
        yield last


def _cuts(fan: np.ndarray) -> Iterator[int]:
    """Ends of runs of hits with about ENTRIES entries each."""
    total = np.cumsum(fan)
    at = 0
    while at < len(fan):
        at = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ENTRIES, "right")))
        yield at


def _leaks(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, tuple[float, int, int, int, int]]]:
    """(row, item, what `copied` returns) of all copies in an array of texts; the most similar of an item's, then the first."""
    for first, part in _pieces(texts):
        numbers, starts = items.numbers(part)
        places, seeds = items.hits(numbers)
        order = np.argsort(places, kind="stable")
        places, seeds = places[order], seeds[order]
        row = np.searchsorted(starts, places, "right") - 1
        fan = items.first[seeds + 1] - items.first[seeds]
        heavy = np.bincount(row, fan, minlength=len(part))
        ends = np.searchsorted(row, np.arange(len(part) + 1))
        for r in np.flatnonzero(heavy).tolist():
            mine = slice(ends[r], ends[r + 1])
            text = numbers[starts[r] : starts[r + 1] - 1]
            # a text with very many entries takes the items in parts, so memory stays bounded
            parts = np.linspace(0, len(items.ids), int(heavy[r] // ENTRIES) + 2).astype(np.int64)
            best: dict[int, tuple] = {}
            for low, high in zip(parts, parts[1:], strict=False):
                for k, a, b in _windows(items, places[mine] - starts[r], seeds[mine], low, high):
                    a, window = max(a, 0), text[max(a, 0) : b]
                    if SIMILAR[1] * items.common(k, window) < SIMILAR[0] * least_span(int(items.sizes[k])):
                        continue
                    found = copied(items.words[k], window)
                    if found and (k not in best or found[0] > best[k][0]):
                        best[k] = (*found[:3], a + found[3], a + found[4])
            yield from ((first + r, k, found) for k, found in best.items())


LEAK_SCHEMA = "doc_id long, item_id long, similarity double, matches int, item_words int, score int, start_word int, end_word int"


def _find(items: Items):
    names = [c.split()[0] for c in LEAK_SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in LEAK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, k, (similarity, matches, *rest) in _leaks(items, batch.column(1)):
                rows.append((batch.column(0)[r].as_py(), items.ids[k], similarity, matches, len(items.words[k]), *rest))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _clean(items: Items):
    """Column function of texts: whether they hold no copy of any item."""

    def run(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), bool)
        keep[[r for r, _, _ in _leaks(items, texts)]] = False
        return pa.array(keep)

    return F.arrow_udf(run, "boolean")


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Items]:
    """The items with SEED words or more, at most `most` and about BLOCK_WORDS words at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        n = len(words(text))
        if n < SEED:
            continue
        block.append((item_id, text))
        size += n
        if len(block) == most or size >= BLOCK_WORDS:
            yield Items(block)
            block, size = [], 0
    if block:
        yield Items(block)


def _weighed(items: Items, texts: DataFrame) -> Items:
    """The block with its frequent seeds closed by their document frequency among all texts."""
    counts = texts.mapInArrow(_count(items), "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(items.seeds), np.int64)
    for seed, n in counts.collect():  # one row a seed of this block at most
        frequency[seed] = n
    items.close(frequency)
    return items


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document row and item of which it holds a copy, see LEAK_SCHEMA.

    similarity is the share of the item's words that the document's best alignment
    matches, after lower-casing and without punctuation, or, where only a passage of the
    item is there, the share of that alignment's columns; start_word and end_word bound
    it. A text with several copies of one item gives one row. Null texts and items have no
    words; items under SEED words are too common to be evidence and are never found.
    Repeated rows and items give repeated rows. Other columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark, block_items):
        out = out.unionByName(plain.mapInArrow(_find(_weighed(items, plain.select("text"))), LEAK_SCHEMA))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows without a copy of any item, with all their columns, whatever these are called.

    Every row is judged by its own text, so rows of one doc_id, or of none, go or stay each
    on its own. Nothing is shuffled: a pass hands on the rows that it keeps. Only texts go
    to Python and only a flag comes back, so a task's buffers outside the heap stay small.
    """
    text = F.col("text").cast("string")
    rows = docs
    for turn, items in enumerate(_blocks(benchmark, block_items)):
        if turn:
            rows = staged(rows, "leak-free")
        rows = rows.where(_clean(_weighed(items, docs.select(text.alias("text"))))(text))
    return rows


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
