"""Alignment of the tokens of two tokenizers by pointer jumping.

Tokens of both sides cover the same bytes.  Every token points to the token of the other side
that reaches farthest right among those that overlap it; where both sides end together, the
token of the second side points to itself.  Doubling the successors of all tokens of many
texts at once, ``next = next[next]``, ends at the terminal token of each connected component:
its label.  A group is a component; its two terminals, which end together, are linked.

Links are counted over all documents.  A task names the distinct id pairs of a block of documents once, so
that a pair of half the corpus is one row a block; the counts come back to the blocks by a join.

A text that is null, empty, or that a side does not give back byte for byte (foreign blanks, unknown
pieces) has no tokens: zeros and an empty string.  Long texts are cut where both
sides begin a token anyway.  Null and repeated keys and repeated rows give a row each;
ties of counts are all best; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.llm.token_counts import byte_symbols
from dipsift.llm.tokens import encoder
from dipsift.operators.lineage import materialise

BLOCK_BYTES = 4_000_000
STEP_CHARS = 500_000
MEMO = 250_000
MEMO_CHARS = 48
_STATE: dict[tuple[str, str], "Pair"] = {}
# A blank run with the visible run after it; blanks at the end go with the last.
_CHUNK = re.compile(r"\x20+[^\x20]+(?:\x20+\Z)?|\x20+\Z")
_CUT = re.compile(r"(?<=\S)\x20(?=[^\x20])")


@dataclass
class Groups:
    """Components of the tokens of several texts: ids, ends in bytes and labels of both sides."""
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    #: tokens in which each group ends
    a_last: np.ndarray
    b_last: np.ndarray


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of both sides, and the terminals of the groups on both sides.

    Ends ascend and the last ones are equal."""
    n = len(a_end)
    over_a = np.searchsorted(b_end, a_end)  # the token of the other side over the last byte reaches farthest
    over_b = np.searchsorted(a_end, b_end)
    ends = a_end[over_b] == b_end
    own = np.arange(n, n + len(b_end))
    point = np.concatenate((over_a + n, np.where(ends, own, over_b)))
    while True:
        onward = point[point]
        if np.array_equal(onward, point):
            break
        point = onward
    label = np.cumsum(ends) - 1
    group = label[point - n]
    return group[:n], group[n:], over_b[ends], np.flatnonzero(ends)


class Pair:
    """Both tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: str):
        from sentencepiece import SentencePieceProcessor
        self.first = encoder(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.a_bytes[number] = bytes(map(byte.__getitem__, entry))
        self.second = SentencePieceProcessor(model_file=model)
        names = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode("utf-8") for k, p in enumerate(names)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        #: No piece continues over a blank, so words are encoded alone.
        self.by_word = not any(re.search("[^▁]▁", p) for p in names)
        self.memo: dict[str, np.ndarray] = {}
        self.signs = [f"{k}{end}".encode() for side, tail in ((self.a_bytes, "|"), (self.b_bytes, ";")) for k in range(len(side)) for end in (",", tail)]

    def encode_second(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with a blank, which the model adds by itself."""
        if not self.by_word:
            return [np.array(x, "<i4") for x in self.second.encode([t[1:] for t in texts], num_threads=1)]
        rows = [_CHUNK.findall(t) for t in texts]
        used = {c for row in rows for c in row}
        new = used.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = used
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.memo.update((c, np.array(x, "<i4").tobytes()) for c, x in zip(part, self.second.encode([c[1:] for c in part], num_threads=1)))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, row)), "<i4") for row in rows]
        for c in new:
            if len(c) > MEMO_CHARS:
                del self.memo[c]
        return out

    def groups(self, texts: list[str]) -> tuple[np.ndarray, list[int], Groups | None]:
        """Which texts (beginning with a blank) both sides give back, their bytes, and the groups of all those together."""
        a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.first.encode(texts)]
        b = self.encode_second(texts)
        raw = [t.encode("utf-8") for t in texts]
        good = np.array([b"".join(map(self.a_bytes.__getitem__, x.tolist())) == r and b"".join(map(self.b_bytes.__getitem__, y.tolist())) == r
                         for x, y, r in zip(a, b, raw)], bool)
        kept = np.flatnonzero(good)
        if not len(kept):
            return good, [], None
        a_ids, b_ids = np.concatenate([a[k] for k in kept]), np.concatenate([b[k] for k in kept]).astype(np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        return good, [len(raw[k]) for k in kept], Groups(a_ids, b_ids, a_end, b_end, *components(a_end, b_end))

    def written(self, g: Groups) -> list[int]:
        """Numbers of the signs that write all groups in order: ids of the first side, ``|``, ids of the second, ``;``."""
        n = len(g.a_last)
        a_before = np.concatenate(([0], g.a_last + 1))  # tokens of a side up to each group
        b_before = np.concatenate(([0], g.b_last + 1))
        out = np.empty(len(g.a) + len(g.b), np.int64)
        last = np.zeros(len(g.a), np.int64)
        last[g.a_last] = 1
        out[np.arange(len(g.a)) + b_before[:n][g.a_group]] = 2 * g.a + last
        last = np.zeros(len(g.b), np.int64)
        last[g.b_last] = 1
        out[np.arange(len(g.b)) + a_before[1:][g.b_group]] = 2 * (len(self.a_bytes) + g.b) + last
        return out


def pair(vocabulary: str, model: str) -> Pair:
    if (vocabulary, model) not in _STATE:
        _STATE[vocabulary, model] = Pair(vocabulary, model)
    return _STATE[vocabulary, model]


def parts(text: str, whole: bool) -> Iterator[str]:
    """A blank and the text, in parts that begin with a blank where both sides begin a token."""
    text, at = " " + text, 0
    while not whole and len(text) - at > STEP_CHARS and (cut := _CUT.search(text, at + STEP_CHARS)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def steps(texts: list[str | None], p: Pair) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of the texts with the number of their text, about ``STEP_CHARS`` characters at a time."""
    owner, held, size = [], [], 0
    for k, text in enumerate(texts):
        for part in parts(text, not p.by_word) if text else ():
            owner.append(k)
            held.append(part)
            size += len(part)
            if size >= STEP_CHARS:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


@dataclass
class Found:
    """What is known of one text."""
    n_a: int = 0
    n_b: int = 0
    links: list[np.ndarray] = field(default_factory=list)
    digest: "hashlib._Hash | None" = None
    good: bool = True


def block(keys: list[int | None], texts: list[str | None], p: Pair) -> dict[str, list]:
    """One row for a block of documents: their figures, the distinct linked pairs with counts, and the links by number of pair."""
    found = [Found() for _ in texts]
    for owner, held in steps(texts, p):
        good, sizes, g = p.groups(held)
        for k, ok in zip(owner, good.tolist()):
            found[k].good &= ok
        if g is None:
            continue
        # Where each part ends: in bytes, then in tokens and groups of both sides.
        ends = np.cumsum(sizes)
        to_a, to_b = np.searchsorted(g.a_end, ends, side="right"), np.searchsorted(g.b_end, ends, side="right")
        to_g = np.searchsorted(g.b_last, to_b)
        code = g.b[g.b_last] << 32 | g.a[g.a_last]
        signs = p.written(g)
        a0 = b0 = g0 = 0
        for k, a1, b1, g1 in zip(np.array(owner)[good].tolist(), to_a.tolist(), to_b.tolist(), to_g.tolist()):
            f = found[k]
            text = b"".join(map(p.signs.__getitem__, signs[a0 + b0:a1 + b1].tolist()))[:-1]
            if f.digest is None:
                f.digest = hashlib.sha256(text)
            else:
                f.digest.update(b";" + text)
            f.n_a, f.n_b = f.n_a + a1 - a0, f.n_b + b1 - b0
            f.links.append(code[g0:g1])
            a0, b0, g0 = a1, b1, g1
    found = [f if f.good else Found() for f in found]
    links = [x for f in found for x in f.links]
    codes, which, times = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    return {"keys": keys, "n_a": [f.n_a for f in found], "n_b": [f.n_b for f in found], "n_groups": [sum(map(len, f.links)) for f in found],
            "sha": [f.digest.hexdigest() if f.digest else "" for f in found], "codes": codes, "times": times,
            "links": which.astype("<u2" if len(codes) <= 1 << 16 else "<u4").tobytes()}


_BLOCK = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
                    ("n_groups", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("codes", pa.list_(pa.int64())),
                    ("times", pa.list_(pa.int64())), ("links", pa.binary())])
_BLOCK_SQL = ("block long, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, codes array<long>, "
              "times array<long>, links binary")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Keys and texts of a batch, up to ``BLOCK_BYTES`` characters at a time (one text at least)."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        keys.append(key.as_py())
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= BLOCK_BYTES:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def blocks(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The aligned documents in blocks, written once."""
    def run(batches):
        p, number = pair(vocabulary, model), TaskContext.get().partitionId() << 36
        for batch in batches:
            for keys, texts in _slices(batch):
                row = block(keys, texts, p)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for f, x in zip(_BLOCK, [number, *row.values()])], schema=_BLOCK)
                number += 1
    return materialise(_rows(docs, key, text).mapInArrow(run, _BLOCK_SQL), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(b_id, a_id, n, best): links of each id pair over all documents, and whether no pair of that second id has more."""
    entries = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("e")).select("e.codes", "e.times")
    n = materialise(entries.groupBy("codes").agg(F.sum("times").alias("n")), "pairs")
    second = F.shiftright("codes", 32)
    top = n.groupBy(second.alias("b_id")).agg(F.max("n").alias("top"))  # at most one row for each id of the second vocabulary
    return n.withColumn("b_id", second).join(top, "b_id").select(
        "codes", "b_id", F.col("codes").bitwiseAND(F.lit((1 << 32) - 1)).alias("a_id"), "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures of every document: tokens of both sides, groups, links, links that are best for their second id,
    the counts of all links added up, and a digest of the groups."""
    aligned = blocks(docs, vocabulary, model, key, text)
    counts = materialise(pair_counts(aligned).select("codes", "n", "best"), "counts")
    entries = aligned.select(F.col("block").alias("of"), F.posexplode("codes").alias("at", "codes")).join(counts, "codes").select("of", "at", "n", "best")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in names])

    def run(one: pa.Table, known: pa.Table) -> pa.Table:
        row = {c: one.column(c)[0].as_py() for c in ("keys", "n_a", "n_b", "n_groups", "sha", "links")}
        order = np.argsort(known.column("at").to_numpy())
        n, best = known.column("n").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]
        which = np.frombuffer(row["links"], "<u2" if len(n) <= 1 << 16 else "<u4")
        to = np.concatenate(([0], np.cumsum(row["n_groups"], dtype=np.int64)))
        total = [np.concatenate(([0], np.cumsum(x[which], dtype=np.int64))) for x in (best.astype(np.int64), n)]
        sums = [pa.array(x[to[1:]] - x[to[:-1]], pa.int64()) for x in total]
        return pa.Table.from_arrays([pa.array(row["keys"], pa.int64()), *[pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_groups")],
                                     *sums, pa.array(row["sha"], pa.string())], schema=schema)
    whole = aligned.drop("codes", "times").groupBy("block").cogroup(entries.groupBy("of"))
    return whole.applyInArrow(run, ", ".join(f"`{c}` {'string' if c == 'groups_sha256' else 'long'}" for c in names))


def token_groups(docs: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every group of every document: key, its place among the groups, end in bytes of a blank and
    the text, and the ids of both sides."""
    names = [key, "group", "end", "a_ids", "b_ids"]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2

    def run(batches):
        p = pair(vocabulary, model)
        for batch in batches:
            for one, text_ in zip(batch.column(0), batch.column(1)):
                out, end, number = [], 0, 0
                for _, held in steps([text_.as_py()], p):
                    good, sizes, g = p.groups(held)
                    if not good.all():
                        out = []
                        break
                    a, b = np.split(g.a, g.a_last[:-1] + 1), np.split(g.b, g.b_last[:-1] + 1)
                    out += [(one.as_py(), number + k, end + int(e), x.tolist(), y.tolist()) for k, (e, x, y) in enumerate(zip(g.b_end[g.b_last], a, b))]
                    end, number = end + sum(sizes), number + len(a)
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    return _rows(docs, key, text).mapInArrow(run, f"`{key}` long, group long, end long, a_ids array<long>, b_ids array<long>")
