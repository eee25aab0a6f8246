"""Word shingles as 64-bit numbers, computed with array arithmetic over many
texts at once.  A-Z count as a-z; words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which no longer UTF-8 sequence contains."""

from __future__ import annotations

import numpy as np
import xxhash

from dipsift.llm.common import mixed

WORDS = 5
LONG = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = bytes(1 if c in (9, 10, 11, 12, 13, 32) else 0 for c in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_numbers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word and a 64-bit number for it, eight bytes at a time."""
    gap = np.frombuffer(text.translate(_GAP), np.int8)
    edge = np.flatnonzero(np.diff(gap, prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    room = text.translate(_LOWER) + bytes(8)
    eight = np.ndarray((len(text) + 1,), "<u8", room, 0, (1,))
    left = end - begin
    number = left.astype(np.uint64)
    at, still = begin, None
    for _ in range(LONG // 8):
        part = mixed((eight[at] & _MASK[np.minimum(left, 8)]) + np.uint64(0x9E3779B97F4A7C15))
        if still is None:
            number = number * np.uint64(0xD6E8FEB86659FD93) + part
            still = np.flatnonzero(left > 8)
        else:
            number[still] = number[still] * np.uint64(0xD6E8FEB86659FD93) + part
            still = still[left > 8]
        if not len(still):
            break
        at = at[left > 8] + 8
        left = left[left > 8] - 8
    for k in still:
        number[k] = xxhash.xxh64_intdigest(room[begin[k]:end[k]])
    return begin, number


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle numbers of each text; one for the whole of a shorter
    sequence, none without words."""
    begin, number = word_numbers(b" ".join(texts))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(begin, starts)
    rolled = np.full(max(0, len(number) - words + 1), words, np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + number[k:k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < words:
            x = np.full(min(1, b - a), b - a, np.uint64)
            for k in range(a, b):
                x = x * np.uint64(0xD6E8FEB86659FD93) + number[k]
            out.append(mixed(x))
            continue
        x = np.sort(rolled[a:b - words + 1])
        new = x[1:] != x[:-1]
        out.append(x if new.all() else x[np.concatenate(([True], new))])
    return out
