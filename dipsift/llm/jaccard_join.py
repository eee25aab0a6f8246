"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d = 1 - |A n B| / |A u B| is a metric; two documents link when
d <= 1 - similarity.  Equal sets are one node from the start.

1. *Living nodes.*  In hash order, the first |A| - ceil(sA) + l shingles of two
   linked sets share at least l of them (l about |A| / 5).  Nodes with fewer shared
   shingles among these have no partner and go.  Exact: only nodes without links go.
2. *Pivots.*  Over the living nodes, shingles are ordered from rare to common; two
   linked sets share one of the first |A| - ceil(sA) + 1, so these are cells in which
   all linked pairs meet.  The most central node of a cell (its shingles are
   the most common ones) is the pivot; cells of equal membership are one.
3. *Regions.*  A pivot's Voronoi region holds the nodes for which it is the nearest
   pivot they meet; nodes that meet it but lie nearer to another are replicated
   into it.  The exact distance to the pivot is computed for all of them.  Those
   within the limit link to the pivot.  Two others can only link if their
   distances to the pivot differ by at most the limit (triangle inequality),
   so each band of distances is compared with itself and its neighbours, and only
   where what both share with the pivot leaves room for enough in common.
4. *Recursion.*  A region whose nodes are all of one component is done.  A large open
   one takes further pivots, which only meet nodes of other components; a small
   one, or one that no longer shrinks, is compared pair by pair within the windows.

Documents of a class need not be compared with each other once they are connected, so very large
groups of near copies cost about their number of members, and no link between different classes is lost.
``all_links`` lists the links within classes too: their number grows with the square of a group, and so does its cost.

Null texts, empty texts and texts of white space have an empty set and link with
nothing.  Repeated rows are copies of each other.  Null ids are allowed: such a row's
node is named by a hash if no other row has its set.  Empty tables give empty results.
Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipsift.llm.common import pieces
from dipsift.llm.graph import components
from dipsift.llm.shingles import WORDS, shingle_sets
from dipsift.operators.lineage import materialise

PERCENT = 80
SMALL = 32
PIVOTS = 8
DEPTH = 4
GROUP = 500_000
TILE = 128
TILE_SHINGLES = 1_000_000
TILE_COLUMNS = 4096
_BLOB = "part int, owner binary, at binary, gram binary, seen binary, times binary"


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def _name(shingles: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(np.frombuffer(both, "<i8").tolist())


def _set_rows(words: int):
    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 256):
                sets = shingle_sets(_texts(batch, 1), words)
                names = [_name(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()),
                     pa.array([y for _, y in names], pa.int64())], names=["key", "n", "a", "b"])
    return run


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _filter_rows(words: int, percent: int, parts: int):
    """Hash-order prefixes, cut by hash into ``parts``.  A shingle that two sets of a
    batch share is counted at once and travels without owners, so a
    shingle that very many documents have stays one entry a batch."""
    def emit(sets):
        by_name = {_name(s)[0]: s for s in sets if len(s)}
        if not by_name:
            return
        owner = np.fromiter(by_name, np.int64, len(by_name))
        n = np.array([len(s) for s in by_name.values()], np.int64)
        take = n - _least(n, percent) + -(-n // 5)
        gram = np.concatenate([s[:k] for s, k in zip(by_name.values(), take)])
        at = np.repeat(np.arange(len(owner)), take)
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        times = np.diff(np.append(head, len(gram)))
        shared = np.repeat(times > 1, times)
        local = np.bincount(at[shared], minlength=len(owner))
        gram, at = gram[head], np.where(times > 1, -1, at[head])
        cut = np.searchsorted(gram, (np.arange(parts + 1).astype(object) * (1 << 64) // parts)[:-1].astype(np.uint64))
        cut = np.append(cut, len(gram))
        report = int(np.bitwise_xor.reduce(owner)) % parts
        for part in range(parts):
            a, b = cut[part], cut[part + 1]
            if a == b and part != report:
                continue
            own, place = np.unique(at[a:b], return_inverse=True)
            some = np.flatnonzero(local) if part == report else np.zeros(0, np.int64)
            ids = np.where(own < 0, 0, owner[np.maximum(own, 0)])
            yield (part, np.concatenate(([len(own) and int(own[0] < 0)], ids)).astype(np.int64).tobytes(), place.astype(np.uint32).tobytes(),
                   gram[a:b].tobytes(), owner[some].tobytes(), local[some].astype(np.int32).tobytes())

    def run(batches):
        for part in (p for whole in batches for p in pieces(whole, 4096)):
            sets = [s for batch in pieces(part, 256) for s in shingle_sets(_texts(batch, 0), words)]
            rows = list(emit(sets))
            for k in range(0, len(rows), 64):
                columns = list(zip(*rows[k:k + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]],
                                                 names=["part", "owner", "at", "gram", "seen", "times"])
    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one part: how many of its shingles each owner shares with another set."""
    owners, grams, flags, counted = [], [], [], []
    for _, owner, at, gram, seen, times in zip(*(c.to_pylist() for c in table.columns)):
        own = np.frombuffer(owner, np.int64)
        place = np.frombuffer(at, np.uint32)
        owners.append(own[1:][place] if len(place) else own[:0])
        flags.append((place == 0) & (own[0] == 1))
        grams.append(np.frombuffer(gram, np.uint64))
        counted.append((np.frombuffer(seen, np.int64), np.frombuffer(times, np.int32).astype(np.int64)))
    owner, gram, many = np.concatenate(owners), np.concatenate(grams), np.concatenate(flags)
    order = np.lexsort((owner, gram))
    owner, gram, many = owner[order], gram[order], many[order]
    first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))) if len(gram) else np.zeros(0, bool)
    owner, gram, many = owner[first], gram[first], many[first]
    head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(gram)))
    any_many = np.logical_or.reduceat(many, head) if len(head) else np.zeros(0, bool)
    shared = np.repeat((size > 1) | any_many, size) & ~many
    ids, times = np.unique(owner[shared], return_counts=True)
    ids = np.concatenate([ids] + [x for x, _ in counted])
    times = np.concatenate([times] + [y for _, y in counted])
    return pa.table({"a": pa.array(ids, pa.int64()), "times": pa.array(times, pa.int64())})


def _intersections(batches):
    for batch in batches:
        got = []
        for left, right in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            got.append(int(np.count_nonzero(y[at] == x)) if len(y) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.int64())], names=["x", "y", "xn", "yn", "both"])


def _distances(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Exact distances of distinct pairs (x, y)."""
    pairs = materialise(pairs.distinct(), f"{name}-pairs")
    left = materialise(pairs.join(sets.select(F.col("node").alias("x"), F.col("n").alias("xn"), F.col("grams").alias("xs")), "x"),
                       f"{name}-left")
    rows = left.join(sets.select(F.col("node").alias("y"), F.col("n").alias("yn"), F.col("grams").alias("ys")), "y")
    got = rows.select("x", "y", "xn", "yn", "xs", "ys").mapInArrow(_intersections, "x long, y long, xn long, yn long, both long")
    return materialise(got.withColumn("d", 1 - F.col("both") / (F.col("xn") + F.col("yn") - F.col("both"))), name)


def _links(distances: DataFrame, percent: int) -> DataFrame:
    return distances.where(F.col("both") * 100 >= F.lit(percent) * (F.col("xn") + F.col("yn") - F.col("both"))).select(
        F.col("x").alias("u"), F.col("y").alias("v"))


def _may_link(x: str, y: str, percent: int):
    """What sizes and shared parts allow: linked sets have s (|A| + |B|) / (1 + s) shingles in
    common, all of them among those that each shares with any other set."""
    sizes = F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * F.lit(percent)
    return sizes & (F.least(f"{x}m", f"{y}m") * (100 + percent) >= (F.col(f"{x}n") + F.col(f"{y}n")) * F.lit(percent))


def node_table(docs: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): each row with the name (a, b) of its set; each set with its node number."""
    rows = materialise(docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(
        _set_rows(words), "key long, n long, a long, b long"), "rows")
    nodes = rows.groupBy("a", "b", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    twice = nodes.where("first IS NOT NULL").groupBy("first").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(
        "first", F.lit(True).alias("_twice"))
    nodes = nodes.join(twice, "first", "left").select(
        "a", "b", "n", "copies", "first", F.when(F.col("_twice") | F.col("first").isNull(), F.col("a")).otherwise(F.col("first")).alias("node"))
    return rows, materialise(nodes, "nodes")


def living_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(node, n, grams) of the nodes that step 1 leaves."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(64, int(total * 0.4) // GROUP)
    shared = (docs.select(text).mapInArrow(_filter_rows(words, percent, parts), _BLOB)
              .groupBy("part").applyInArrow(_shared, "a long, times long").groupBy("a").agg(F.sum("times").alias("times")))
    least = F.ceil(F.ceil(F.col("n") * percent / 100) / 5)
    living = materialise(nodes.where("n > 0").join(shared, "a").where(F.col("times") >= least).select("a", "b", "n", "node", "first"), "living")
    by_key = living.where("first IS NOT NULL").select(F.col("first").alias("_key"), "node", "n", F.col("a").alias("_a"), F.col("b").alias("_b"))

    def sets(batches):
        for whole in batches:
            for batch in pieces(whole, 256):
                found = shingle_sets(_texts(batch, 4), words)
                # A repeated id may stand for several texts: only the named set is the node's.
                fit = [k for k, s in enumerate(found) if _name(s) == (batch.column(2)[k].as_py(), batch.column(3)[k].as_py())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit, pa.int64())), batch.column(1).take(pa.array(fit, pa.int64())),
                                                  pa.array([found[k].tobytes() for k in fit], pa.binary())], names=["node", "n", "grams"])
    named = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(by_key.hint("shuffle_hash"), "_key")
    out = named.select("node", "n", "_a", "_b", "_text").mapInArrow(sets, "node long, n long, grams binary")
    return materialise(out.dropDuplicates(["node"]), "sets")


def cells(sets: DataFrame, percent: int) -> DataFrame:
    """(cell, node, n, m, rank, size, pivot): the rare ends of the living sets, cells of equal
    membership merged; m is how many of the n shingles other sets share."""
    def explode(batches):
        for batch in batches:
            for small in pieces(batch, 64):
                found = [np.frombuffer(g, np.int64) for g in small.column(2).to_pylist()]
                size = np.array([len(x) for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(np.repeat(np.asarray(small.column(0)), size)), pa.array(np.repeat(size, size))],
                    names=["cell", "node", "n"])
    entries = sets.mapInArrow(explode, "cell long, node long, n long")
    many = materialise(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    # Of the first n - ceil(sn) + 1 shingles from rare to common, those of one set alone come first.
    limit = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("found"))
    rare = (entries.join(many, "cell").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "cell"))).alias("found"))
            .where(F.size("found") * 100 >= F.col("n") * percent)
            .select("node", "n", F.size("found").cast("long").alias("m"), F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("rank"),
                    F.explode(F.slice("found", F.lit(1), F.greatest(limit, F.lit(0)).cast("int"))).alias("e"))
            .select(F.col("e.cell").alias("cell"), "node", "n", "m", (F.col("rank") / F.col("n")).alias("rank")))
    rare = materialise(rare, "rare")
    alike = (rare.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("f"),
                                      F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("g"), F.max(F.struct("rank", "node")).alias("top"))
             .where("size > 1").groupBy("size", "f", "g").agg(F.min("cell").alias("cell"), F.first("top").alias("top")))
    alike = materialise(alike.select("cell", "size", F.col("top.node").alias("pivot")), "cells")
    return materialise(rare.join(alike, "cell"), "members")


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs within small groups: at most SMALL members each."""
    listed = rows.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("node", "n", "m"))).alias("v")).select("v").distinct()
    one = listed.select("v", F.posexplode("v").alias("k", "p"))
    two = one.select(F.col("p.node").alias("x"), F.col("p.n").alias("xn"), F.col("p.m").alias("xm"),
                     F.explode(F.slice("v", F.col("k") + 2, SMALL)).alias("q"))
    return two.select("x", "xn", "xm", F.col("q.node").alias("y"), F.col("q.n").alias("yn"), F.col("q.m").alias("ym")).where(
        _may_link("x", "y", percent)).select("x", "y")


def _regions(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, regions): all links within small cells and with pivots; (pivot, node, n, m, rank, d, b) of the
    large cells, d and b being the distance to the pivot and what is shared with it."""
    members = cells(sets, percent)
    small = _distances(_within(members.where(F.col("size") <= SMALL), percent), sets, "small")
    found = _links(small, percent)
    rows = members.where(F.col("size") > SMALL).select("pivot", "node", "n", "m", "rank").distinct()
    met = _distances(rows.where("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")), sets, "met")
    found = found.unionByName(_links(met, percent))
    region = materialise(rows.join(met.select(F.col("x").alias("node"), F.col("y").alias("pivot"), "d", F.col("both").alias("b")), ["node", "pivot"], "left")
                         .withColumns({"d": F.coalesce("d", F.lit(0.0)), "b": F.coalesce("b", "n")}), "region")
    return found, region


def _tile_links(percent: int):
    """Links within one tile: of its left half with its right half, or of all its nodes (half 2) with each other."""
    def run(table: pa.Table) -> pa.Table:
        node, half = np.asarray(table["node"]), np.asarray(table["half"])
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        gram, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        times = np.diff(np.append(head, len(gram)))
        at, column = at[np.repeat(times > 1, times)], np.repeat(np.arange(np.count_nonzero(times > 1)), times[times > 1])
        both = np.zeros((len(sets), len(sets)), np.int64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_COLUMNS):
            a, b = np.searchsorted(column, (low, low + TILE_COLUMNS))
            held = np.zeros((len(sets), TILE_COLUMNS), np.float32)
            held[at[a:b], column[a:b] - low] = 1
            both += np.rint(held @ held.T).astype(np.int64)
        pair = (half[:, None] == 0) & (half[None, :] == 1) | (half[:, None] == 2) & (half[None, :] == 2) & (node[:, None] < node[None, :])
        x, y = np.nonzero(pair & (both * 100 >= percent * (n[:, None] + n[None, :] - both)))
        return pa.table({"u": pa.array(np.minimum(node[x], node[y]), pa.int64()), "v": pa.array(np.maximum(node[x], node[y]), pa.int64())})
    return run


def all_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every link (u, v) between different nodes, once, with u < v.

    Small cells list theirs.  In a region, links lie within a band of distances to the pivot or between
    neighbouring ones; bands are dealt into blocks, and each pair of blocks is a tile of bounded
    size, so that a large group of near copies is many even groups."""
    found, region = _regions(sets, percent)
    rows = region.select("pivot", "node", "n", F.floor(F.col("d") / F.lit(1 - percent / 100 + 1e-9)).cast("int").alias("band"))
    cut = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    cuts = rows.groupBy("pivot", "band").agg(cut.alias("cuts")).groupBy("pivot").agg(F.map_from_entries(F.collect_list(F.struct("band", "cuts"))).alias("cuts"))
    rows = rows.join(cuts, "pivot").withColumn("block", F.pmod(F.xxhash64("node", "pivot"), F.element_at("cuts", F.col("band"))).cast("int"))

    def tiles(band, make):
        count = F.coalesce(F.element_at("cuts", band), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), make)).otherwise(F.array().cast(
            "array<struct<low:int,left:int,high:int,right:int,half:int>>"))

    def tile(low, left, high, right, half):
        return F.struct(low.cast("int").alias("low"), left.cast("int").alias("left"), high.cast("int").alias("high"), right.cast("int").alias("right"), half.cast("int").alias("half"))
    band, block = F.col("band"), F.col("block")
    own = tiles(band, lambda o: tile(band, F.least(block, o), band, F.greatest(block, o), F.when(o == block, 2).when(block < o, 0).otherwise(1)))
    up = tiles(band + 1, lambda o: tile(band, block, band + 1, o, F.lit(0)))
    down = tiles(band - 1, lambda o: tile(band - 1, o, band, block, F.lit(1)))
    dealt = rows.select("pivot", "node", F.explode(F.concat(own, up, down)).alias("t")).select("pivot", "node", "t.*")
    near = dealt.join(sets.select("node", "grams"), "node").groupBy("pivot", "low", "left", "high", "right").applyInArrow(
        _tile_links(percent), "u long, v long")
    return materialise(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(near).distinct(), "all-links")


def links_of(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between nodes that connect exactly the components of all links."""
    limit = 1 - percent / 100
    found, region = _regions(sets, percent)
    left = region.count()
    for depth in range(DEPTH + 1):
        if not left:
            break
        label = components(found)
        region = region.drop("c").join(label.select("node", F.col("component").alias("c")), "node", "left").withColumn(
            "c", F.coalesce("c", "node"))
        region = materialise(region, "open")
        state = region.groupBy("pivot").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1")
        region = materialise(region.join(materialise(state.select("pivot", "size"), "state"), "pivot"), "open")
        before, left = left, region.count()
        last = depth == DEPTH or (depth and left > 0.9 * before)
        done = region if last else region.where(F.col("size") <= SMALL)
        band = F.floor(F.col("d") / F.lit(limit + 1e-9))
        one = done.select("pivot", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("m").alias("xm"), F.col("b").alias("xb"), F.col("d").alias("xd"), F.col("c").alias("xc"), band.alias("band"))
        two = done.select("pivot", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("m").alias("ym"), F.col("b").alias("yb"), F.col("d").alias("yd"), F.col("c").alias("yc"),
                          F.explode(F.array(band - 1, band, band + 1)).alias("band"))
        window = one.join(two, ["pivot", "band"]).where(
            (F.col("x") < F.col("y")) & (F.col("xc") != F.col("yc")) & (F.abs(F.col("xd") - F.col("yd")) <= limit + 1e-9)
            & _may_link("x", "y", percent)
            # In common they have at most what both have of the pivot, and of the rest what others share.
            & ((F.least("xb", "yb") + F.least(F.col("xm") - F.col("xb"), F.col("ym") - F.col("yb"))) * (100 + percent)
               >= (F.col("xn") + F.col("yn")) * percent)).select("x", "y")
        found = found.unionByName(_links(_distances(window, sets, "window"), percent))
        if last:
            break
        region = region.where(F.col("size") > SMALL).drop("size")
        # Further pivots: the most central node of each of several components, then any by hash.
        lead = region.groupBy("pivot", "c").agg(F.max(F.struct("rank", "node", "n", "m")).alias("top"), F.count(F.lit(1)).alias("k"))
        lead = lead.withColumn("o", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("k"), "c"))).where(
            F.col("o") <= PIVOTS).drop("o")
        more = region.withColumn("s", F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(PIVOTS))).groupBy("pivot", "c", "s").agg(
            F.max(F.struct(F.xxhash64("node", F.lit(depth)).alias("h"), "node", "n", "m")).alias("top")).join(
            lead.select("pivot", "c"), ["pivot", "c"], "left_semi")
        seeds = materialise(lead.select("pivot", "c", F.col("top.node").alias("q"), F.col("top.n").alias("qn"), F.col("top.m").alias("qm")).unionByName(
            more.select("pivot", "c", F.col("top.node").alias("q"), F.col("top.n").alias("qn"), F.col("top.m").alias("qm"))).distinct().withColumnRenamed("c", "qc"), "seeds")
        meet = region.withColumnsRenamed({"n": "xn", "m": "xm"}).join(seeds, "pivot").where((F.col("c") != F.col("qc")) & _may_link("x", "q", percent))
        found = found.unionByName(_links(_distances(meet.select(F.least("node", "q").alias("x"), F.greatest("node", "q").alias("y")),
                                                    sets, "meet"), percent))
        left = region.count()
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                    count_links: bool = False) -> DataFrame:
    """(key, n_shingles, component_id, copies) and, if asked for, links: one row for each input row.

    ``component_id`` is the smallest key reachable by links (null only where no row of the component
    has a key); ``copies`` is the number of rows with the same set; ``links`` is the number of different
    sets that the row's set links to.  Rows with an empty set are their own component, without links."""
    rows, nodes = node_table(docs, key, text, words)
    sets = living_sets(docs, rows, nodes, key, text, words, percent)
    found = all_links(sets, percent) if count_links else links_of(sets, percent)
    label = components(found)
    named = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = []
    if count_links:
        ends = found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        named = named.join(ends, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        more = ["links"]
    lowest = named.where("first IS NOT NULL").groupBy("component").agg(F.min("first").alias("lowest"))
    named = materialise(named.join(lowest, "component", "left").select("a", "b", "copies", "lowest", *more), "classes")
    out = rows.join(named, ["a", "b"])
    empty = F.col("n") == 0
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.when(empty, F.col("key")).otherwise(F.col("lowest")).alias("component_id"),
                      F.when(empty, F.lit(1)).otherwise(F.col("copies")).alias("copies"), *more)


def link_table(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(x, y, x_copies, y_copies): every link between different sets once, each set by the smallest key of
    its rows (null where none has one) and with the number of its rows, which all have the link."""
    rows, nodes = node_table(docs, key, text, words)
    found = all_links(living_sets(docs, rows, nodes, key, text, words, percent), percent)
    x = nodes.select(F.col("node").alias("u"), F.col("first").alias("x"), F.col("copies").alias("x_copies"))
    y = nodes.select(F.col("node").alias("v"), F.col("first").alias("y"), F.col("copies").alias("y_copies"))
    return found.join(x, "u").join(y, "v").select("x", "y", "x_copies", "y_copies")
