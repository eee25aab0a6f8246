"""Exact top-k search by inner product with a three-phase uniform threshold.

Components are integers floor(scale * x).  The dimensions are cut into m lists;
a vector has a local score in each list, and its score is their sum.

1. Each task gathers the k best local scores of every list for every query. The vectors they
   name are resolved, list by list; the k-th best sum of a query over all tasks is a safe cutoff t.
2. The cutoffs go to all tasks.  A vector whose score is at least t has a local score of at
   least t / m in some list, so only entries that reach this are collected.  An entry is given up as soon
   as what it has collected and the threshold in its other lists stay below t.
3. The remaining scores of the collected entries are resolved exactly; those of at
   least t compete for the k places, ties to the smaller key.

Sums are made for the entries that the lists hand on, never for all vectors.  Each task passes
on k rows a query at most, so equal vectors, however many, cost no more.  Queries are taken in
blocks of at most about ``block`` rows, each small enough to ship to all tasks; the rows of a block are written
before the next one is read, so that one block at a time is in the driver.

Vectors that are null or hold a null or a component that is not finite take no part.
Vectors of unequal length are compared as if the shorter ended in zeros.
Components must keep scores within 63 bits.  Repeated rows are candidates each by
itself; rows with a query's own key never are its results.  Rows without a key
take no part.  Empty tables give an empty result; extra columns are ignored."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipsift.llm.common import pieces
from dipsift.operators.lineage import materialise, scratch_dir

LISTS = 4
BLOCK = 1024


def integers(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """Rows of floor(scale * x), padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point only where it is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2.0 ** 52:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _best(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score descending, key ascending."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((key[some], -score[some]))[:k]]


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: float = 1024.0,
           lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the k best of all other rows for each row that ``is_query`` holds for."""
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & value.isNotNull() & ~bad).select(F.col(key).cast("long").alias("key"), value.alias("x"))
    queries = rows.where(is_query)
    size = queries.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    count = -(-size // block)
    spark = rows.sparkSession
    if not count:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    folder = f"{scratch_dir(spark)}/top-{uuid.uuid4().hex}"
    for number in range(count):
        mine = queries.where(F.pmod(F.xxhash64("key"), F.lit(count)) == number).toArrow()
        ids, q = np.asarray(mine.column("key")), integers(mine.column("x"), scale, width)
        _block(rows, ids, q, k, width, scale, lists).write.parquet(f"{folder}/block={number}")
    return spark.read.parquet(folder).select("query_id", "rank", F.col("key").alias(key), "score")


def _block(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, width: int, scale: float, lists: int) -> DataFrame:
    schema = "query long, key long, score long"
    names = ["query", "key", "score"]
    bounds = np.linspace(0, width, lists + 1).astype(int)
    spans = [(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if b > a] or [(0, 0)]

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = [len(x) for x, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(found)), n)), pa.array(np.concatenate([x for x, _ in found])),
                                           pa.array(np.concatenate([y for _, y in found]))], names=names)

    def merged(held, new):
        """Per query the k best of what is held and what is new; a repeated row stays two rows."""
        out = []
        for (key, score), (more, also) in zip(held, new):
            key, score = np.concatenate((key, more)), np.concatenate((score, also))
            at = _best(score, key, k)
            out.append((key[at], score[at]))
        return out

    def local_scores(batches):
        for whole in batches:
            for batch in pieces(whole, 2048):
                key, v = np.asarray(batch.column(0)), integers(batch.column(1), scale, width)
                yield key, [products(q[:, a:b], v[:, a:b]) for a, b in spans]

    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def resolved(local, i, at):
        """Exact scores of the vectors at ``at`` for query ``i``."""
        return sum(s[i, at] for s in local)

    def gather(batches):
        held = [nothing] * len(ids)
        for key, local in local_scores(batches):
            new = []
            for i in range(len(ids)):
                free = np.flatnonzero(key != ids[i])
                lead = np.unique(np.concatenate([free[_best(s[i, free], key[free], k)] for s in local]))
                new.append((key[lead], resolved(local, i, lead)))
            held = merged(held, new)
        yield batch_of(held)

    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    first = materialise(rows.mapInArrow(gather, schema), "first")
    # The k-th best sum so far; without k of them nothing is cut.
    cutoff = np.full(len(ids), np.iinfo(np.int64).min)
    for r in (first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query", "score").collect()):
        cutoff[r["query"]] = r["score"]
    known = cutoff > np.iinfo(np.int64).min
    floor = [-(-int(t) // len(spans)) for t in cutoff]  # least local score of a vector that can reach the cutoff

    def collect(batches):
        held = [nothing] * len(ids)
        low = np.array(floor, np.int64)[:, None]
        for key, local in local_scores(batches):
            enough = np.zeros(local[0].shape, bool)
            for s in local:
                enough |= s >= low
            new = []
            for i in range(len(ids)):
                at = np.flatnonzero(enough[i])
                at = at[key[at] != ids[i]]
                if known[i]:
                    # What was collected counts, a list without an entry stays below the threshold.
                    most = sum(np.maximum(s[i, at], floor[i] - 1) for s in local)
                    at = at[most >= cutoff[i]]
                score = resolved(local, i, at)
                good = score >= cutoff[i]
                new.append((key[at[good]], score[good]))
            held = merged(held, new)
        yield batch_of(held)

    best = rows.mapInArrow(collect, schema).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    # Numbers of this block's queries to their ids: at most about ``block`` rows.
    names_table = rows.sparkSession.createDataFrame(list(enumerate(ids.tolist())), "query long, query_id long")
    return best.join(F.broadcast(names_table), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score")
