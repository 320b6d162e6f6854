"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file follows the public zstandard seekable format: frames that decompress on their
own, then one skippable frame with each frame's compressed size, decompressed size
and checksum, the low 32 bits of its content's XXH64. A part is two such files, `.ids`
with the ids as little-endian 16- or 32-bit integers and `.docs` with three int64 a
document: doc_id, first id, id count. A reader of one document touches the seek table
and only the frames that hold its ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgrove.llm.common import new_path, staged, table
from linkgrove.llm.tokens import encoded, encoder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Decompressed bytes of a frame.
FRAME = 1 << 18
LEVEL = 1
END_ID = 1
#: Stands for a null doc_id in the .docs file.
NO_ID = -(1 << 63)


class FrameWriter:
    """Writes bytes as frames of `frame` bytes each, then the seek table."""

    def __init__(self, sink, frame: int = FRAME, level: int = LEVEL):
        self.sink, self.frame = sink, frame
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.held: list[bytes] = []
        self.size = 0
        self.entries: list[tuple[int, int, int]] = []

    def write(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame:
            whole = b"".join(self.held)
            cut = self.size - self.size % self.frame
            for at in range(0, cut, self.frame):
                self._frame(whole[at : at + self.frame])
            self.held, self.size = [whole[cut:]], self.size - cut

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.sink.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        body = b"".join(struct.pack("<III", *e) for e in self.entries)
        body += struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to the decompressed bytes; each frame read is checked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < 17:
            raise ValueError("too short for a seek table")
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * count - 8)
        head, length = struct.unpack("<II", source.read(8))
        if head != SKIPPABLE_MAGIC or length != 12 * count + 9:
            raise ValueError("damaged seek table")
        table_ = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(table_[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table_[:, 1])])
        self.sums = table_[:, 2]
        self.last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def __len__(self) -> int:
        return int(self.plain[-1])

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(int(self.packed[k]))
            packed = self.source.read(int(self.packed[k + 1] - self.packed[k]))
            data = zstandard.ZstdDecompressor().decompress(packed, int(self.plain[k + 1] - self.plain[k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self.last = (k, data)
            self.frames_read += 1
        return self.last[1]

    def read(self, start: int, stop: int) -> bytes:
        out = []
        k = int(np.searchsorted(self.plain, start, "right")) - 1
        while start < stop:
            low, high = int(self.plain[k]), int(self.plain[k + 1])
            out.append(self.frame(k)[start - low : min(stop, high) - low])
            start, k = min(stop, high), k + 1
        return b"".join(out)


def write_part(where: str, documents: Iterable[tuple[int | None, np.ndarray]], wide: bool) -> tuple[int, int]:
    """Write one part under the URI `where`; (documents, ids) written.

    Both files appear by renaming when complete, so an attempt that dies or runs
    twice leaves either nothing or the whole.
    """
    store, base = pafs.FileSystem.from_uri(where)
    store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    mark = uuid.uuid4().hex
    docs = total = 0
    kind = "<u4" if wide else "<u2"
    with (
        store.open_output_stream(f"{base}.ids.{mark}") as ids_file,
        store.open_output_stream(f"{base}.docs.{mark}") as docs_file,
    ):
        ids_out, docs_out = FrameWriter(ids_file), FrameWriter(docs_file)
        for doc_id, ids in documents:
            ids_out.write(ids.astype(kind).tobytes())
            docs_out.write(struct.pack("<qqq", NO_ID if doc_id is None else doc_id, total, len(ids)))
            docs, total = docs + 1, total + len(ids)
        ids_out.close()
        docs_out.close()
    for ext in ("ids", "docs"):
        store.move(f"{base}.{ext}.{mark}", f"{base}.{ext}")
    return docs, total


class PartReader:
    """Documents of one part, by their place in it."""

    def __init__(self, where: str, wide: bool):
        store, base = pafs.FileSystem.from_uri(where)
        self.ids = FrameReader(store.open_input_file(f"{base}.ids"))
        self.docs = FrameReader(store.open_input_file(f"{base}.docs"))
        self.kind = np.dtype("<u4" if wide else "<u2")

    def __len__(self) -> int:
        return len(self.docs) // 24

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """(doc_id, its first id's place in the part, its ids)."""
        doc_id, first, count = struct.unpack("<qqq", self.docs.read(24 * k, 24 * k + 24))
        w = self.kind.itemsize
        ids = np.frombuffer(self.ids.read(first * w, (first + count) * w), self.kind)
        return (None if doc_id == NO_ID else doc_id), first, ids.astype("<u4")


def _writer(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, joined=False)
        wide = enc.library.get_vocab_size() > 1 << 16
        part = TaskContext.get().partitionId()

        def documents():
            for batch in batches:
                for doc_id, ids in encoded(enc, batch.column(0), batch.column(1)):
                    yield doc_id, np.append(ids, np.uint32(end_id))

        where = f"{folder}/part-{part:07d}"
        docs, ids = write_part(where, documents(), wide)
        yield pa.record_batch(
            [pa.array([part], pa.int32()), pa.array([where]), pa.array([wide]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())],
            names=["part", "path", "wide", "docs", "ids"],
        )

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order; the staged manifest of parts.

    Manifest: part, path, wide, docs, ids; parts in order hold ascending doc_ids, null
    first, and repeated doc_ids ordered by text. Null text: only the end id. `folder`
    is a URI that all machines see. Part sizes follow Spark's shuffle settings.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return staged(
        ordered.mapInArrow(
            _writer(tokenizer, folder, end_id), "part int, path string, wide boolean, docs long, ids long"
        ),
        "token-manifest",
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader = PartReader(row["path"], row["wide"])
            for low in range(0, len(reader), 20_000):
                ids, starts, counts, sums = [], [], [], []
                for k in range(low, min(low + 20_000, len(reader))):
                    doc_id, first, tokens = reader.document(k)
                    ids.append(doc_id)
                    starts.append(row["base"] + first)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.tobytes()))
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in (ids, starts, counts, sums)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Only the manifest, one short row a part, is ordered in one place.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = max(1, manifest.count())
    return placed.repartition(parts, "part").mapInArrow(
        _read_back, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-files")
    )
    return read_token_files(manifest)
