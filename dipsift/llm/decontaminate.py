"""Benchmark decontamination by q-gram lemma filtering.

A benchmark text is cut into overlapping windows of two lengths.  Any stretch of 80 folded characters
of it is found that a document holds with at most 5 edits, wherever the stretch begins; and any long
window with at most 9, even if its edits lie close together.  A window of m characters
that occurs in a document with at most k edits shares at least m + 1 - q(k + 1)
of its q-grams with the document, all of them on diagonals that differ by at most k.
The q-grams of whole items are indexed once.  Those that a batch of documents shares are counted in
diagonal bands that overlap by the most edits; bands with enough of them on a stretch are kept, and
in these a banded alignment decides on each window that has its number.

Letters are compared without case (ASCII and Latin-1), and every run of other
ASCII characters counts as one blank.  Null and empty texts, and texts shorter
than a window less its edits, match nothing.  Repeated benchmark rows give
repeated hits under their own ids, which may be null; null benchmark texts and those of less than
``q`` characters are left out.  Documents with null or repeated ids are judged row by row.  Long and
repetitive texts are taken slice by slice, so that memory is bounded.  Empty tables give an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import MIX, utf8

Q = 8
WINDOW = 120
STEP = 60
#: Short windows beside the long ones, so that each stretch of SHORT + SHORT_STEP - 1 characters holds a whole one wherever it begins.
SHORT = 72
SHORT_STEP = 9
EDIT_RATE = 0.08
BLOCK_CHARS = 500_000
PAIRS = 500_000
TEXT_BYTES = 2_000_000
BORDER = b"\xff"  # in no UTF-8 text, so no q-gram runs from one text into the next
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def normal(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of a text, and the place of each in the raw bytes."""
    if not len(raw):
        return raw, np.zeros(0, np.int64)
    folded = _FOLD[raw]
    upper = np.flatnonzero(raw[:-1] == 0xC3) + 1  # two-byte Latin-1 letters: upper to lower case
    upper = upper[(raw[upper] >= 0x80) & (raw[upper] <= 0x9E) & (raw[upper] != 0x97)]
    folded[upper] += 32
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return folded[at], at


def gram_numbers(text: np.ndarray, q: int) -> np.ndarray:
    """The bytes of each q-gram as one 64-bit number (q is at most 8)."""
    if len(text) < q:
        return np.zeros(0, np.uint64)
    room = np.concatenate((text, np.zeros(8, np.uint8)))
    grams = np.ndarray((len(text) - q + 1,), "<u8", room, 0, (1,)).copy()
    return grams if q == 8 else grams & np.uint64((1 << 8 * q) - 1)


def slots(grams: np.ndarray, size: int) -> np.ndarray:
    """The place of each q-gram in a bit filter of ``size``, a power of two."""
    return ((grams * MIX) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def distance_at(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Least edits of the whole pattern against any stretch of ``text`` (start and
    end free), with that stretch; None beyond k.  The text is one band of
    diagonals wide, so the table is the band."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, c in enumerate(pattern, 1):
        diagonal = row[:-1] + (text != c)
        up = row[1:] + 1
        best = np.empty(n + 1, np.int64)
        best[0] = i
        take = diagonal <= up
        best[1:] = np.where(take, diagonal, up)
        origin = np.empty(n + 1, np.int64)
        origin[0] = start[0]
        origin[1:] = np.where(take, start[:-1], start[1:])
        along = best - steps  # moves along the text: a running minimum
        low = np.minimum.accumulate(along)
        source = np.maximum.accumulate(np.where(along == low, steps, 0))
        row, start = low + steps, origin[source]
        if row.min() > k:
            return None
    end = int(np.argmin(row))
    return (int(row[end]), int(start[end]), end) if row[end] <= k else None


@dataclass
class Windows:
    """One block of benchmark texts: an index of the q-grams of whole items, and the windows that are aligned."""
    item: list[int | None]
    text: list[np.ndarray]
    #: of each item: start, size, edits and q-grams needed of its windows, longest first
    spots: list[np.ndarray]
    gram: np.ndarray  # sorted, each occurrence in an item once
    number: np.ndarray  # of the item
    offset: np.ndarray
    seen: np.ndarray  # bit filter over hashes
    bounds: list[tuple[int, int]]  # of windows of like size: least q-grams shared, longest stretch that holds them
    #: of each item, for its shortest and its longest windows: the same bounds
    need: np.ndarray
    reach: np.ndarray
    band: int  # most edits of a window, at least 1
    q: int


def windows_of(items: list[tuple[int | None, str]], q: int = Q, window: int = WINDOW, step: int = STEP,
               rate: float = EDIT_RATE) -> Windows:
    names, texts, spots = [], [], []
    for name, text in items:
        folded, _ = normal(np.frombuffer(text.encode("utf-8"), np.uint8))
        folded = folded[(1 if len(folded) and folded[0] == 32 else 0):]
        folded = folded[:len(folded) - (1 if len(folded) and folded[-1] == 32 else 0)]
        if len(folded) < q:
            continue
        own = set()
        for size, every in ((window, step), (min(SHORT, window), min(SHORT_STEP, step))):
            last = max(0, len(folded) - size)
            own |= {(at, min(at + size, len(folded)) - at) for at in (*range(0, last, every), last)}
        rows = np.array(sorted(own, key=lambda x: (-x[1], x[0])), np.int64)
        edits = np.minimum((rows[:, 1] * rate).astype(np.int64), np.maximum(0, (rows[:, 1] - q) // q))
        names.append(name)
        texts.append(folded)
        spots.append(np.column_stack((rows, edits, rows[:, 1] + 1 - q * (edits + 1))))
    whole = np.concatenate(spots) if spots else np.zeros((0, 4), np.int64)
    sizes = whole[:, 1]
    bounds = [(int(whole[sizes // 8 == x, 3].min()), int((whole[:, 1] + whole[:, 2])[sizes // 8 == x].max()) - q + 1) for x in sorted(set((sizes // 8).tolist()))]
    # Rows are sorted by size: the last is a shortest window, the first a longest.
    ends = np.array([[(r[k, 3], r[k, 1] + r[k, 2] - q + 1) for k in (-1, 0)] for r in spots], np.int64).reshape(-1, 2, 2)
    grams = [gram_numbers(t, q) for t in texts]
    gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    once = np.unique(gram)
    seen = np.zeros(1 << max(16, (len(once) * 24).bit_length()), bool)
    seen[slots(once, len(seen))] = True
    return Windows(names, texts, spots, gram[order], np.repeat(np.arange(len(texts)), [len(g) for g in grams])[order] if grams else np.zeros(0, np.int64),
                   np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64), seen, bounds,
                   ends[:, :, 0], ends[:, :, 1], max(1, int(whole[:, 2].max(initial=1))), q)


def dense(text: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The q-grams of a text, and the places of those that may be in a benchmark
    text and lie in a stretch with enough of them for the weakest bound."""
    grams = gram_numbers(text, w.q)
    maybe = np.flatnonzero(w.seen[slots(grams, len(w.seen))])
    cover = np.zeros(len(maybe) + 1, np.int64)
    for least, reach in w.bounds:
        if least <= len(maybe):
            first = np.flatnonzero(maybe[least - 1:] - maybe[:len(maybe) - least + 1] < reach)  # enough from this one on
            np.add.at(cover, first, 1)
            np.add.at(cover, np.searchsorted(maybe, maybe[first] + reach), -1)
    return grams, maybe[np.cumsum(cover[:-1]) > 0]


def slices(maybe: np.ndarray, times: np.ndarray, reach: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of places with about ``most`` index entries; neighbours overlap by two windows, so that none is cut."""
    total, a = np.concatenate(([0], np.cumsum(times))), 0
    while a < len(maybe):
        b = max(int(np.searchsorted(total, total[a] + most)), int(np.searchsorted(maybe, maybe[a] + 4 * reach)))
        yield a, min(b, len(maybe))
        if b >= len(maybe):
            return
        a = max(a + 1, int(np.searchsorted(maybe, maybe[b - 1] - 2 * reach)))


def bands(at: np.ndarray, number: np.ndarray, offset: np.ndarray, w: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, first diagonal, places, offsets) of the bands that hold enough shared q-grams on a stretch.

    Bands are two widths of the most edits wide and overlap by one, so that diagonals that differ by
    no more lie in one of them.  ``at`` ascends."""
    low = (at - offset) // w.band
    key = np.repeat(number << 44, 2) + np.column_stack((low, low - 1)).ravel() + (1 << 43)
    order = np.argsort(key, kind="stable")
    key, pair = key[order], order // 2
    place, item = at[pair], key >> 44
    good = np.zeros(len(key), bool)
    for kind in (0, 1):
        later = np.arange(len(key)) + w.need[item, kind] - 1
        inside = later < len(key)
        later = np.where(inside, later, 0)
        good |= inside & (key[later] == key) & (place[later] - place < w.reach[item, kind])
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tail = np.append(head[1:], len(key))
    kept = head[np.add.reduceat(good, head) > 0] if len(head) else head
    number_, tail = (key[kept] & ((1 << 44) - 1)) - (1 << 43), tail[np.searchsorted(head, kept)]
    # Every eighth band first: those between lie within what these find, where a text goes on and on.
    for k in np.argsort(number_ % 8 != 0, kind="stable"):
        a, b = kept[k], tail[k]
        yield int(item[a]), int(number_[k]) * w.band, place[a:b], offset[pair[a:b]]


def batch_hits(texts: list[bytes], w: Windows, most: int = PAIRS) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in raw bytes, one for each text, item and region found."""
    joined = np.frombuffer(BORDER.join(texts), np.uint8)
    text, place = normal(joined)
    grams, maybe = dense(text, w)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    # Where each text begins and ends among the folded bytes.
    edge = np.searchsorted(place, begin)
    lo, hi = np.searchsorted(w.gram, grams[maybe]), np.searchsorted(w.gram, grams[maybe], side="right")
    maybe, lo, times = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    found: dict[tuple[int, int], list[list[int]]] = {}
    for a, b in slices(maybe, times, int(w.reach.max(initial=1)), most):
        t = times[a:b]
        entry = np.repeat(lo[a:b], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        for item, first, at, offset in bands(np.repeat(maybe[a:b], t), w.number[entry], w.offset[entry], w):
            row = np.searchsorted(edge, at, side="right") - 1
            for r in np.unique(row).tolist():
                _align(text, int(edge[r]), int(edge[r + 1]), w, item, first, at[row == r], offset[row == r], found.setdefault((r, item), []))
    out = []
    for (r, item), regions in found.items():
        out += [(r, item, int(place[s]) - int(begin[r]), int(place[e - 1]) + 1 - int(begin[r]), k) for s, e, k in regions]
    return sorted(out)


def _align(text: np.ndarray, begin: int, end: int, w: Windows, item: int, first: int, at: np.ndarray, offset: np.ndarray, regions: list[list[int]]) -> None:
    """Verify the windows of an item that have enough q-grams in a band of one text; merges what is found into ``regions``."""
    if any(s <= at[0] and at[-1] + w.q <= e for s, e, _ in regions):
        return
    start, size, _, need = w.spots[item].T
    once = np.unique(offset)
    enough = np.searchsorted(once, start + size - w.q, side="right") - np.searchsorted(once, start) >= need
    for o, m, k in w.spots[item][enough, :3].tolist():
        inside = (offset >= o) & (offset <= o + m - w.q)
        diagonal, count = np.unique((at - offset)[inside], return_counts=True)
        d = int(diagonal[np.argmax(count)])
        if any(s <= o + d and o + d + m <= e for s, e, _ in regions):
            continue  # within what is known
        pattern = w.text[item][o:o + m]
        if begin <= o + d and o + d + m <= end and np.array_equal(text[o + d:o + d + m], pattern):
            got = (0, o + d, o + d + m)
        else:
            from_, to = max(begin, o + first - k), min(end, o + first + 2 * w.band + m + k)
            best = distance_at(pattern, text[from_:to], k)
            if best is None:
                continue
            got = (best[0], from_ + best[1], from_ + best[2])
        near = [x for x in regions if x[0] <= got[2] and x[1] >= got[1]]
        for x in near:
            regions.remove(x)
        regions.append([min([got[1], *(x[0] for x in near)]), max([got[2], *(x[1] for x in near)]), max([got[0], *(x[2] for x in near)])])


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """Benchmark rows in blocks of about ``block_chars`` characters, each small enough to ship to all tasks."""
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    count = total // block_chars + 1
    for k in range(count):
        yield sorted(((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()), key=lambda x: (x[0] is not None, x))


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``TEXT_BYTES`` of text, and the texts."""
    data, cuts, _ = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + TEXT_BYTES, side="right")) - 1)
        yield batch.slice(a, b - a), [data[x:y].tobytes() for x, y in zip(cuts[a:b], cuts[a + 1:b + 1])]
        a = b


def _points(raw: bytes, to: int) -> int:
    """Code points before a byte."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8, to) & 0xC0) != 0x80)) if to else 0


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", block_chars: int = BLOCK_CHARS, **limits) -> DataFrame:
    """One row for each document, benchmark item and region found: key, item,
    start and end (code points of the document) and the most edits of a window aligned in the region.
    The benchmark goes to the tasks in blocks of bounded size, one pass over the documents for each."""
    schema = f"`{key}` long, `{item}` long, start long, end long, edits int"
    out = None
    for block in blocks(benchmark, item, item_text, block_chars):
        w = windows_of(block, **limits)

        def run(batches, w=w):
            for whole in batches:
                for batch, texts in _batches(whole, 1):
                    ids, rows = batch.column(0).to_pylist(), []
                    for r, number, begin, end, edits in batch_hits(texts, w):
                        rows.append((ids[r], w.item[number], _points(texts[r], begin), _points(texts[r], end), edits))
                    columns = list(zip(*rows)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32()])],
                        names=[key, item, "start", "end", "edits"])
        part = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          block_chars: int = BLOCK_CHARS, **limits) -> DataFrame:
    """The rows of ``docs`` in which no benchmark text was found, each judged by its own text; all columns stay."""
    for block in blocks(benchmark, item, item_text, block_chars):
        w = windows_of(block, **limits)

        def run(batches, w=w, at=docs.columns.index(text)):
            for whole in batches:
                for batch, texts in _batches(whole, at):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[r for r, *_ in batch_hits(texts, w)]] = False
                    yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
