"""Token counts by byte-pair merging, without token ids.

A piece of text is a linked list of byte symbols; a heap holds its adjacent pairs by
merge rank.  The lowest rank (leftmost first) is popped again and again and its pair
joined; entries whose pair is gone are passed over.  A piece counts its first
symbols less its merges, and no token is ever looked up.  Pieces are those of the
vocabulary's own split; each worker remembers the counts of short ones (a bounded memo).

Special strings in a text are one token each, as the library has it by default.  A null
or empty text has no tokens.  Null and repeated keys and repeated rows give a row each;
an empty table gives none; extra columns are ignored.  Long texts are split block by block."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import pieces, utf8
from dipsift.llm.tokens import byte_pieces

MEMO = 500_000
MEMO_CHARS = 64
BLOCK_CHARS = 1 << 20
# A blank after a visible character begins a piece in every text.
_CUT = re.compile(r"(?<=\S)\x20")
_STATE: dict[str, "Merger"] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters for themselves, the others from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        number: dict[str, int] = {}
        for symbol in byte_symbols():
            number.setdefault(symbol, len(number))
        joins = []
        for rank, pair in enumerate(rules["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            joins.append((rank, number.setdefault(a, len(number)), number.setdefault(b, len(number)), number.setdefault(a + b, len(number))))
        self.width = len(number)
        #: pair of symbols -> (rank, joined symbol)
        self.joins = {a * self.width + b: (rank, ab) for rank, a, b, ab in joins}
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges."""
        joins, width, n = self.joins, self.width, len(piece)
        symbol = list(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            pair = symbol[at] * width + symbol[at + 1]
            if pair in joins:
                heap.append((joins[pair][0], at, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, at, pair = heapq.heappop(heap)
            to = after[at]
            if symbol[at] < 0 or to >= n or symbol[at] * width + symbol[to] != pair:
                continue  # one of the two was joined elsewhere
            symbol[at], symbol[to] = joins[pair][1], -1
            last = after[at] = after[to]
            merges += 1
            if last < n:
                before[last] = at
                new = symbol[at] * width + symbol[last]
                if new in joins:
                    heapq.heappush(heap, (joins[new][0], at, new))
            first = before[at]
            if first >= 0:
                new = symbol[first] * width + symbol[at]
                if new in joins:
                    heapq.heappush(heap, (joins[new][0], first, new))
        return n - merges

    def _plain(self, text: str) -> int:
        found = byte_pieces(text)
        new = set(found).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set(found)
        long = [p for p in new if len(p) > MEMO_CHARS]
        self.memo.update((p, self.merged(p.encode("utf-8"))) for p in new)
        total = sum(map(self.memo.__getitem__, found))
        for p in long:
            del self.memo[p]
        return total

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        return total + sum(self._plain(block) for part in parts for block in blocks(part))


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks of about ``size`` characters, cut where a piece begins."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


def merger(path: str) -> Merger:
    """One merger for each worker process and vocabulary."""
    if path not in _STATE:
        _STATE[path] = Merger(path)
    return _STATE[path]


def counts(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tokens = merger(vocabulary)
        for whole in batches:
            for batch in pieces(whole, 256):
                _, offsets, _ = utf8(batch.column(1))
                got = np.array([tokens.count(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(got), pa.array(got > limit)], schema=schema)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")
