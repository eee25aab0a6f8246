"""Token ids in seekable binary files.

A file is a run of independent zstandard frames over the ids (little-endian
unsigned 32-bit) of its documents in ascending key order, a skippable frame with
the document index, and a skippable frame with the seek table of the public
seekable format: compressed size, size and checksum of each frame, then the
count of frames.  A reader finds the table from the end of a file, the
documents from the index, and decompresses only the frames they lie in.

Files are written under a temporary name and then renamed, and a task that runs
again writes the same bytes to the same name.  A null or empty text is a document of its end id alone;
null keys come first; rows of equal keys are ordered by their texts.
A table without rows gives no documents.  Extra columns are ignored."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipsift.llm.common import pieces
from dipsift.llm.tokens import encoder
from dipsift.operators.lineage import materialise

# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1
CHECKED = 0x80

FRAME_BYTES = 1 << 20
FILE_BYTES = 128_000_000
END = 2


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """One file; close() adds index and table and gives it its name."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.system, self.path = _place(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.system.open_output_stream(self.temporary)
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes, self.held, self.table = frame_bytes, bytearray(), []
        self.keys: list[int] = []
        self.known: list[bool] = []
        self.sizes: list[int] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.press.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.sizes.append(len(ids) // 4)
        self.held += ids
        while len(self.held) >= self.frame_bytes:
            self._frame(bytes(self.held[:self.frame_bytes]))
            del self.held[:self.frame_bytes]

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        index = zstandard.ZstdCompressor(level=3).compress(
            np.array(self.keys, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array(self.known, np.uint8).tobytes())
        self.out.write(struct.pack("<III", INDEX, len(index) + 4, len(self.keys)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.system.move(self.temporary, self.path)


class Reader:
    """Reads the table and index at once, frames as they are asked for."""

    def __init__(self, path: str):
        system, name = _place(path)
        self.file = system.open_input_file(name)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError(f"{path} has no seek table")
        head = end - 9 - 12 * count - 8
        raw = self._at(head + 8, 12 * count)
        self.table = np.frombuffer(raw, "<u4").reshape(count, 3).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.offset = np.concatenate(([0], np.cumsum(self.table[:, 1])))
        kind, size, docs = struct.unpack("<III", self._at(int(self.begin[-1]), 12))
        if kind != INDEX:
            raise ValueError(f"{path} has no document index")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[-1]) + 12, size - 4), max_output_size=13 * docs + 1)
        self.keys = np.frombuffer(index, "<i8", docs)
        self.sizes = np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64)
        self.known = np.frombuffer(index, np.uint8, docs, 12 * docs).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.frames_read = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return raw

    def document(self, k: int) -> bytes:
        """The ids of the k-th document: only the frames that hold it are decompressed."""
        begin, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        first = int(np.searchsorted(self.offset, begin, side="right")) - 1
        last = int(np.searchsorted(self.offset, end, side="left"))
        raw = b"".join(self.frame(f) for f in range(first, last))
        return raw[begin - int(self.offset[first]):end - int(self.offset[first])]

    def documents(self) -> Iterator[bytes]:
        """All documents in order; each frame is decompressed once."""
        held, f = bytearray(), 0
        for size in self.sizes:
            while len(held) < 4 * size:
                held += self.frame(f)
                f += 1
            yield bytes(held[:4 * size])
            del held[:4 * size]


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents below ``folder``; one row for each file: path, part, docs, tokens.

    Files follow each other in key order, so ``part`` orders the whole corpus."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // file_bytes + 1)
    # Equal keys are dealt by text, so a key that very many rows have is still split.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")

    def run(batches):
        part = TaskContext.get().partitionId()
        tokenizer, out, docs_, tokens = encoder(vocabulary), None, 0, 0
        tail = np.array([end], "<u4").tobytes()
        path = f"{folder}/part-{part:07d}.tokens"
        for whole in batches:
            for batch in pieces(whole, 256):
                out = out or Writer(path)
                for number, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist())):
                    out.add(number, ids + tail)
                    docs_ += 1
                    tokens += len(ids) // 4 + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": [part], "docs": [docs_], "tokens": [tokens]},
                                             schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))
    return materialise(rows.select("key", "text").mapInArrow(run, "path string, part long, docs long, tokens long"), "token-files")


def read(files: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    # One row a file: its own small table, cumulated in one task.
    based = files.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = materialise(based.select("path", "part", "base"), "token-bases")
    count = max(1, based.count())

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                out = [[] for _ in kinds]
                for k, ids in enumerate(file.documents()):
                    for column, value in zip(out, (int(file.keys[k]) if file.known[k] else None, base + int(file.starts[k]), len(ids) // 4,
                                                   zlib.crc32(ids), ids)):
                        column.append(value)
                    if len(out[0]) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                        out = [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = [key, "start", "n_tokens", "ids_crc32", "ids"][:len(kinds)]
    return based.repartitionByRange(count, "part").select("path", "base").mapInArrow(
        run, f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
