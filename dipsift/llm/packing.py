"""Packing of tokenised documents by Karmarkar-Karp multiway differencing.

Documents are read in blocks of bounded size.  Within a block, pieces of at
most ``max_piece`` tokens are spread over k windows: the two partial partitions with the
largest imbalance are merged, the fullest window of one with the emptiest of the other, until one
partition is left, whose windows are nearly equal.  k starts at the least count
that can hold the block and rises while a window exceeds the capacity.

A null or empty text is a document of its end id alone.  Repeated rows are
packed each by itself.  Tables without rows give no pieces.  Extra columns are
ignored.  Very long documents fill whole sequences first."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import pieces
from dipsift.llm.tokens import encoder

LENGTH = 4096
MAX_PIECE = 1024
BLOCK_TOKENS = 1_000_000
END = 2
SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Members of each of k windows, nearly equal in total size."""
    if not sizes:
        return [[] for _ in range(k)]
    # A node: totals of its k slots, descending; merged nodes remember which slots came together.
    totals = {n: np.concatenate(([s], np.zeros(k - 1, np.int64))) for n, s in enumerate(sizes)}
    joined: dict[int, tuple[int, int, np.ndarray]] = {}
    heap = [(-s, n) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = totals.pop(a) + totals.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        totals[fresh] = both[order]
        joined[fresh] = (a, b, order)
        heapq.heappush(heap, (-int(both[order[0]] - both[order[-1]]), fresh))
        fresh += 1
    windows: list[list[int]] = [[] for _ in range(k)]
    open_ = [(heap[0][1], np.arange(k))]  # node, and the window of each of its slots
    while open_:
        node, place = open_.pop()
        if node < len(sizes):
            windows[place[0]].append(node)
            continue
        a, b, order = joined.pop(node)
        back = np.empty(k, np.int64)
        back[order] = place
        open_ += [(a, back), (b, back[::-1])]
    return windows


def pack(lengths: list[int], capacity: int = LENGTH, max_piece: int = MAX_PIECE) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); each token is in exactly one."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            full.append([(doc, at, capacity)])
            at += capacity
        count = -(-(n - at) // max_piece)
        for k in range(count):
            stop = n - (n - at) * (count - 1 - k) // (count - k) if count - k > 1 else n
            rest.append((doc, at, stop - at))
            at = stop
    total = sum(r[2] for r in rest)
    k = -(-total // capacity)
    while rest:
        found = differencing([r[2] for r in rest], k)
        if max(sum(rest[i][2] for i in w) for w in found) <= capacity:
            full += [[rest[i] for i in sorted(w)] for w in found if w]
            break
        k += 1
    return full


def sequences(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = LENGTH,
              max_piece: int = MAX_PIECE, block_tokens: int = BLOCK_TOKENS, end: int = END) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``sequence_id`` numbers the sequences of a partition after its own number, so
    it is unique and the same when a lost task runs again on the same files."""
    rows = docs.select(F.col(key), text)
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, {SCHEMA}"

    def run(batches):
        tokenizer = encoder(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        serial = TaskContext.get().partitionId() << 33
        held_keys, held, amount = [], [], 0

        def flush():
            nonlocal serial
            out = ([], [], [], [], [], [], [], [])
            for window in pack([len(x) // 4 for x in held], capacity, max_piece):
                at = 0
                for doc, start, length in window:
                    ids = held[doc][4 * start:4 * (start + length)]
                    for column, value in zip(out, (held_keys[doc], start, length, zlib.crc32(ids), len(held[doc]) // 4, serial, at, ids)):
                        column.append(value)
                    at += length
                serial += 1
            kinds = [key_type] + [pa.int64()] * 6 + [pa.binary()]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

        key_type = pa.int64()
        for whole in batches:
            key_type = whole.schema.field(0).type
            for batch in pieces(whole, 256):
                keys = batch.column(0).to_pylist()
                for k, ids in enumerate(tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])):
                    held_keys.append(keys[k])
                    held.append(ids + tail)
                    amount += len(ids) // 4 + 1
                    if amount >= block_tokens:
                        yield flush()
                        held_keys, held, amount = [], [], 0
        if held:
            yield flush()
    return rows.mapInArrow(run, schema)
