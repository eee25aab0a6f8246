"""Quality scores by a factorisation machine.

A document is a sparse vector of hashed words (their shares, scaled), structure
statistics and metadata.  The machine adds to a linear score all pairwise
interactions, each the product of two low-rank vectors, by the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2,
so scoring takes time in proportion to the entries.

Null and empty texts are scored from their statistics, all zero.  Repeated rows get
equal scores.  Without labels of both kinds every score is 0.5.  Empty tables give empty
results; all columns pass through, and those named like the appended one are replaced."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dipsift.llm.common import bounded_sample, pieces
from dipsift.llm.shingles import word_numbers

BITS = 15
RANK = 8
STATISTICS = 14
SIZE = (1 << BITS) + STATISTICS
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = (0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in (9, 10, 11, 12, 13, 32)
                  else 4 if _c in (44, 46) else 5 if _c < 128 else 6)


def statistics(text: str, raw: bytes, words: np.ndarray, meta: float | None) -> np.ndarray:
    """Structure of a text, each number about 0 to 1."""
    n = max(1, len(raw))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n if raw else np.zeros(7)
    lines = text.split("\n")
    distinct = len(set(lines)) / len(lines)
    unique = len(np.unique(words)) / max(1, len(words))
    sentences = len(re.findall(r"[.!?](?:\s|$)", text))
    return np.array([*kinds, np.log1p(len(words)) / 10, min(1.0, len(raw) / n / max(1, len(words)) * n / 20), 1 - distinct, 1 - unique,
                     min(1.0, sentences / max(1, len(words)) * 5), min(1.0, len(lines) / max(1, len(words)) * 5), np.log1p(meta or 0.0) / 15])


def vector(text: str | None, meta: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's entries."""
    text = text or ""
    raw = text.encode("utf-8")
    _, words = word_numbers(raw)
    fixed = np.arange(1 << BITS, SIZE)
    stats = statistics(text, raw, words, meta)
    if not len(words):
        return fixed, stats
    at, times = np.unique((words >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return np.concatenate((at, fixed)), np.concatenate((times / np.sqrt((times * times).sum()), stats))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * (total @ total - (v * v).sum()))


def _encoded(key: str, label: str):
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 256):
                rows = [vector(t, m) for t, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()),
                     pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())], names=[key, label, "at", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", meta: str = "n_chars", label: str = "quality",
        per_label: int = 3000, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4) -> Machine | None:
    """Learn from about ``per_label`` labelled rows of each label (a bounded sample; the bound is
    this parameter), both labels weighing alike; AdaGrad on the logistic loss."""
    chosen = bounded_sample(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1)),
                            "_key", label, per_label)
    # The sample is bounded by its parameter, so it can go to all tasks.
    rows = docs.select(key, text, F.col(meta).cast("double").alias("_meta")).join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    got = rows.select(F.col(key).cast("string").alias(key), label, text, "_meta").mapInArrow(
        _encoded(key, label), f"`{key}` string, `{label}` int, at binary, x binary").collect()
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    if len({r[1] for r in got}) < 2:
        return None
    data = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32).astype(float), 2.0 * r[1] - 1) for r in got]
    weight = {y: len(data) / 2 / sum(d[2] == y for d in data) for y in (-1.0, 1.0)}
    random = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(SIZE), random.normal(0, 0.05, (SIZE, RANK)))
    gl, gf, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for k in random.permutation(len(data)):
            at, x, y = data[k]
            factors = m.factors[at]
            v = factors * x[:, None]
            total = v.sum(axis=0)
            z = m.bias + m.linear[at] @ x + 0.5 * (total @ total - (v * v).sum())
            g = -y * weight[y] / (1 + np.exp(min(30.0, max(-30.0, y * z))))
            g1 = g * x + decay * m.linear[at]
            g2 = g * (x[:, None] * total[None, :] - factors * (x * x)[:, None]) + decay * factors
            gb += g * g
            gl[at] += g1 * g1
            gf[at] += g2 * g2
            m.bias -= rate * g / np.sqrt(gb)
            m.linear[at] -= rate * g1 / np.sqrt(gl[at])
            m.factors[at] -= rate * g2 / np.sqrt(gf[at])
    return Machine(m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", meta: str = "n_chars", out: str = "score") -> DataFrame:
    """Append the probability of a good document."""
    rest = [c for c in docs.columns if c != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    at_text, at_meta = rest.index(text), rest.index(meta)

    def one(value, n):
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, machine.logit(*vector(value, n))))))) if machine else 0.5

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 256):
                found = [one(t, m) for t, m in zip(batch.column(at_text).to_pylist(), batch.column(at_meta).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))
