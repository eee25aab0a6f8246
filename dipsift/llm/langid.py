"""Language identification: sparse multinomial logistic regression.

Features are relative frequencies of hashed character 1- to 3-grams (lower
case, every run of other characters becomes one blank) times their inverse
document frequency.  Weights are learnt by follow-the-regularised-leader with
elastic-net penalties; one temperature is then fitted on rows kept back.

Null texts and texts without a letter give ``und`` with score 0.  Repeated
rows are scored alike; an empty table gives an empty result; a table without
labels gives ``und`` everywhere.  Long texts are read whole, in blocks of 2^18
characters that no n-gram crosses.  All columns pass through, and three are
appended; columns that have their names are replaced."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from dipsift.llm.common import bounded_sample, pieces

BITS = 16
BLOCK = 1 << 18
UNKNOWN = "und"
HAS_LETTER = re.compile(r"[^\W\d_]")
_LETTERS: list[np.ndarray] = []


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # buckets x labels, idf folded in
    bias: np.ndarray
    temperature: float


def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters; the last entry stands for all beyond."""
    if not _LETTERS:
        table = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), dtype=bool, count=1 << 16)
        table[-1] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """Bucket numbers of all 1-, 2- and 3-grams of a text (at most ``BLOCK`` characters), blanks at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[np.minimum(raw, (1 << 16) - 1)]
    codes = np.where(letter, raw, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([np.uint64(32)], codes[keep], [np.uint64(32)]))
    shift = np.uint64(64 - BITS)
    one = codes * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + one[2:]
    both = np.concatenate((one, two * np.uint64(0x9E3779B97F4A7C15), three * np.uint64(0xD6E8FEB86659FD93)))
    return (both >> shift).astype(np.int64)


def _features(key: str, label: str):
    schema = pa.schema([(key, pa.string()), (label, pa.string()), ("at", pa.binary()), ("share", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                out = ([], [], [], [])
                for doc, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if text is None or not HAS_LETTER.search(text):
                        continue
                    found, times = np.unique(np.concatenate([grams(text[at:at + BLOCK]) for at in range(0, len(text), BLOCK)]),
                                             return_counts=True)
                    out[0].append(doc)
                    out[1].append(name)
                    out[2].append(found.astype(np.int32).tobytes())
                    out[3].append((times / times.sum()).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)
    return run


def _counted(batches):
    """(bucket, n): in how many texts of a task each bucket occurs; bucket -1 counts the texts with a letter."""
    seen, texts = np.zeros(1 << BITS, np.int64), 0
    for whole in batches:
        for batch in pieces(whole):
            for text in batch.column(0).to_pylist():
                if text is None or not HAS_LETTER.search(text):
                    continue
                texts += 1
                seen[np.unique(np.concatenate([np.unique(grams(text[at:at + BLOCK])) for at in range(0, len(text), BLOCK)]))] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], texts), pa.int64())], names=["bucket", "n"])


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts with a letter; over all rows."""
    got = docs.select(text).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(1 << BITS)
    for r in got:
        if r["bucket"] >= 0:
            seen[r["bucket"]] = r["n"]
    return seen, sum(r["n"] for r in got if r["bucket"] < 0)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float,
          l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    z = np.zeros((1 << BITS, classes))
    n = np.zeros((1 << BITS, classes))
    bias = np.zeros(classes)

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(at)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
            bias -= 0.02 * p
    return weights(np.arange(1 << BITS)), bias


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 1500,
        epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> LanguageModel:
    """Learn from about ``per_label`` rows of every label (a bounded sample; the
    bound is this parameter), a fifth of them kept back for the temperature.  Document
    frequencies are those of all labelled rows."""
    known = docs.select(F.col(key).cast("string").alias(key), F.col(label).cast("string").alias(label), text).where(
        F.col(text).isNotNull())
    schema = f"`{key}` string, `{label}` string, at binary, share binary"
    got = bounded_sample(known, key, label, per_label).mapInArrow(_features(key, label), schema).collect()
    labels = sorted({r[1] for r in got})
    if not labels:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    number = {x: k for k, x in enumerate(labels)}
    got.sort(key=lambda r: (r[1], r[0] or "", bytes(r[2])))
    read = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32).astype(float), number[r[1]]) for r in got]
    seen, texts = frequencies(known.where(F.col(label).isNotNull()), text)
    idf = np.log((1.0 + texts) / (1.0 + seen)) + 1.0
    rows = [(at, x * idf[at] * 30.0, y) for at, x, y in read]
    back = [r for k, r in enumerate(rows) if k % 5 == 4]
    w, bias = _ftrl([r for k, r in enumerate(rows) if k % 5 != 4] or rows, len(labels), epochs, alpha, beta, l1, l2)
    temperature = 1.0
    if back:
        logits = np.stack([x @ w[at] + bias for at, x, _ in back])
        truth = np.array([y for _, _, y in back])

        def loss(t):
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]))
        temperature = float(min(np.geomspace(0.25, 8.0, 61), key=loss))
    return LanguageModel(labels, (w * idf[:, None] * 30.0).astype(np.float32), bias.astype(np.float32), temperature)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", label_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """Append the predicted language and its calibrated probability."""
    rest = [c for c in docs.columns if c not in (label_out, score_out)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = StructType([*rows.schema.fields, StructField(label_out, StringType()), StructField(score_out, DoubleType())])
    column = rest.index(text)

    def one(value):
        if value is None or not model.labels or not HAS_LETTER.search(value):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(model.labels)), 0
        for at in range(0, len(value), BLOCK):
            found = grams(value[at:at + BLOCK])
            total, n = total + model.weights[found].sum(axis=0, dtype=float), n + len(found)
        s = (total / n + model.bias) / model.temperature
        p = np.exp(s - s.max())
        k = int(np.argmax(p))
        return model.labels[k], float(p[k] / p.sum())

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                found = [one(t) for t in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*batch.schema.names, label_out, score_out])
    return rows.mapInArrow(run, schema)
