"""Token ids through the tokenizers library, each distinct piece of text encoded once.

Both vocabularies treat text piecewise: a piece never spans the border between a
non-space and a following space or newline, nor that between a word and one comma or
full stop after it. Texts are cut at such borders only where that is certain; any other
text is encoded whole. Pieces that a worker doesn't know yet go to the library in one
call, parted by a special token; known ones come from a bounded cache that keeps the
most frequent.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import threading
import time
import unicodedata
from collections import defaultdict
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps, and those that stay when these are too many: its memory bound.
CACHE_PIECES = 800_000
KEEP_PIECES = 400_000
#: Seconds without use after which a worker gives up its encoders: Spark keeps workers for the stages that follow.
IDLE = 5.0
#: Pieces of one call of the library.
CALL = 4096
#: White space that is no single blank or newline, or control characters: no cutting.
_ODD = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\x85]")
#: Mark of a text's first piece, which has no blank before it.
FIRST = "\x00"
#: Signs that are parted from the word before them when a piece is new.
TAILS = ",."


def _plain(text: str) -> bool:
    """Only single blanks and newlines between words, and none at the ends."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.replace("\n", "").isprintable() or not _ODD.search(text)


def _segments(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of `flat` in a row, and their ends there."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # the k-th value of a segment lies k after its start
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], ends


class Encoder:
    """Encodes whole texts to ids (uint32); special tokens' strings are plain text.

    `joined` says whether a piece keeps the blank before it, as byte-level
    vocabularies need; others drop white space and letter case.
    """

    def __init__(self, path: str, joined: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.joined = joined
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        added = self.marked.get_added_tokens_decoder()
        self.mark_id = min(added)
        self.mark = added[self.mark_id].content
        self.marks = [t.content for t in added.values()]
        self.signs = {t: np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in TAILS}
        self._reset({}, np.empty(0, np.uint32), np.empty(0, np.int64))

    def _reset(self, index: dict[str, int], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.index: defaultdict[str, int] = defaultdict(None, index)
        self.index.default_factory = self.index.__len__
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.seen = np.zeros(len(index), np.int64)

    def _shown(self, piece: str) -> str:
        """A piece as it stands in a text."""
        if piece[0] == FIRST:
            return piece[1:]
        return " " + piece if self.joined and piece[0] != "\n" else piece

    def _library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and each piece's count."""
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(pieces), CALL):
            part = pieces[at : at + CALL]
            body = self.mark.join(part)
            if sum(body.count(m) for m in self.marks) != len(part) - 1:  # a piece holds such a string itself
                own = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                flat.append(np.array([i for x in own for i in x], np.uint32))
                lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
                continue
            ids = np.array(self.marked.encode_batch_fast([body], add_special_tokens=False)[0].ids, np.uint32)
            marks = ids == self.mark_id
            flat.append(ids[~marks])
            lengths.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(lengths)

    def _learn(self, known: int) -> None:
        """Find the ids of the pieces that the index has got since it had `known`.

        A word with one comma or full stop after it is the word's ids and the sign's.
        """
        new = list(islice(reversed(self.index), len(self.index) - known))[::-1]
        bases = [p[:-1] if p[-1] in TAILS and len(p) > 1 and p[-2].isalnum() else p for p in new]
        ask: dict[str, int] = {}
        get = self.index.get

        def place(base: str, piece: str) -> int:
            """Where the base's ids are: in the index, or past it among those to ask for."""
            if base is not piece and (at := get(base, known)) < known:
                return at
            return known + ask.setdefault(base, len(ask))

        at = np.fromiter(map(place, bases, new), np.int64, len(new))
        flat, lengths = self._library_ids([self._shown(p) for p in ask])
        signs = np.concatenate([self.signs[t] for t in TAILS])
        every = np.concatenate([self.flat, flat, signs])
        lengths_of = np.concatenate([self.lengths, lengths])
        starts_of = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        sign = np.fromiter((TAILS.index(p[-1]) if b is not p else -1 for b, p in zip(bases, new, strict=True)), np.int64, len(new))
        # each new piece is its base's ids, then its sign's, if it has one
        n = np.column_stack([lengths_of[at], (sign >= 0).astype(np.int64)])
        begin = np.column_stack([starts_of[at], len(self.flat) + len(flat) + np.maximum(sign, 0)]).reshape(-1)
        self.flat = np.concatenate([self.flat, _segments(every, begin, n.reshape(-1))[0]])
        self.lengths = np.concatenate([self.lengths, n.sum(axis=1)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    def _shrink(self) -> None:
        """Keep the most frequent pieces."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[:KEEP_PIECES])
        names = np.array(list(self.index), object)[keep]
        lengths = self.lengths[keep]
        flat = self._gather(keep)[0]
        self._reset(dict(zip(names.tolist(), range(len(keep)), strict=True)), flat, lengths)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in a row, and the ids' count up to each piece's end."""
        return _segments(self.flat, self.starts[at], self.lengths[at])

    def prepared(self, text: str) -> str | None:
        """A text whose pieces are parted by single blanks, or none where cutting isn't certain."""
        if not text or not _plain(text):
            return None
        if self.joined:
            return FIRST + text.replace("\n", " \n")
        if "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return None  # lower-casing a final sigma, or before composing, may differ
        return text.lower().replace("\n", " ")

    def encode_many(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """All ids of each text; null: none. Splitting and numbering of pieces run in Arrow."""
        out: list[np.ndarray | None] = [None] * len(texts)
        where: list[int] = []
        ready: list[str] = []
        for k, text in enumerate(texts):
            own = self.prepared(text or "")
            if own is None:
                out[k] = np.array(self.library.encode(text or "", add_special_tokens=False).ids, np.uint32)
            else:
                ready.append(own)
                where.append(k)
        if ready:
            cut = pc.split_pattern(pa.array(ready, pa.string()), " ")
            numbered = cut.flatten().dictionary_encode()
            distinct = numbered.dictionary.to_pylist()
            known = len(self.index)
            index = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
            if len(self.index) > known:
                self._learn(known)
            local = numbered.indices.to_numpy()
            self.seen[index] += np.bincount(local, minlength=len(index))
            flat, stops = self._gather(index[local])
            ends = cut.offsets.to_numpy()[1:]
            for k, ids in zip(where, np.split(flat, stops[ends - 1][:-1]), strict=True):
                out[k] = ids
            if len(self.index) > CACHE_PIECES:
                self._shrink()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
_LOCK = threading.Lock()
_last_use = 0.0


def _used() -> None:
    global _last_use
    _last_use = time.monotonic()


def _give_up() -> None:
    """Waits until the encoders are idle, then frees them; what a running task holds stays with it."""
    while (left := _last_use + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    with _LOCK:
        _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, which else keeps what is freed
    if trim:
        trim(0)


def encoder(path: str, joined: bool) -> Encoder:
    """This worker's encoder for a vocabulary file, kept from task to task until it is idle."""
    _used()
    with _LOCK:
        if not _ENCODERS:
            threading.Thread(target=_give_up, daemon=True).start()
        if (path, joined) not in _ENCODERS:
            _ENCODERS[path, joined] = Encoder(path, joined)
        return _ENCODERS[path, joined]


def encoded(enc: Encoder, ids, texts, size: int = 1 << 21):
    """(id, token ids) of each row of two Arrow columns; about `size` characters are encoded at once."""
    keys = ids.to_pylist()
    at = held = 0
    waiting: list[str | None] = []
    for k, text in enumerate(texts):
        waiting.append(text.as_py())
        held += len(waiting[-1] or "")
        if held >= size or k == len(keys) - 1:
            yield from zip(keys[at : k + 1], enc.encode_many(waiting), strict=True)
            _used()
            at, held, waiting = k + 1, 0, []
