"""Token ids of whole texts by the tokenizers library, piece by piece.

Both vocabularies split a text into pieces that are encoded independently, so
each worker keeps the ids of pieces it has met (a bounded memo) and gives the
library only new ones, many at once.  The result equals encoding the text as a whole."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import regex
import unicodedata

MEMO = 800_000
# Texts of these characters alone can be split by an equal pattern of plain character
# classes, which is faster: ASCII and Latin letters without numbers beyond 0-9.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]*")
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_LATIN_BYTES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
# The fixed split of byte-level vocabularies.
_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_STATE: dict[str, "Encoder"] = {}


def byte_pieces(text: str) -> list[str]:
    """The pieces that byte-level vocabularies encode one by one."""
    return (_LATIN_BYTES if _PLAIN.fullmatch(text) else _BYTES).findall(text)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.lower = rules["normalizer"] is not None
        if self.lower:
            split = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.pattern, self.latin = regex.compile(split["pattern"]["Regex"]), _LATIN_WORDS
        else:
            self.pattern, self.latin = _BYTES, _LATIN_BYTES
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            part = pieces[at:at + 20_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            cuts = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            raw = np.array(found.ids, dtype="<u4").tobytes()
            self.memo.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.lower:
            texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
            texts = [_lower(t) for t in texts]
        split = [(self.latin if _PLAIN.fullmatch(t) else self.pattern).findall(t) for t in texts]
        used = set(chain.from_iterable(split))
        new = used.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = used
        if new:
            self._learn(list(new))
        ids = self.memo.__getitem__
        return [b"".join(map(ids, row)) for row in split]


def _lower(text: str) -> str:
    """Lower case of each character by itself, as the library does (no final sigma)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]
