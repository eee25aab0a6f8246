"""Hand-computed and brute-force checks of the operators, with hot keys."""
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import physics
from dipsift.functions.expr import depth_floor, in_eclipse, lit
from dipsift.operators import gaps, incumbent, matching, pairs, queue, rank, sampling, search, sets, split, views
from dipsift.operators.ordered import islands, locate, with_neighbours
from dipsift.sources import artifacts, curves


def curve(spark, times, tic=1, sector=1):
    return spark.createDataFrame([(tic, sector, float(t)) for t in times], "tic bigint, sector bigint, time double")


def hot_rows(n=600, seed=5):
    """Two thirds of the rows under one key, clustered and tied in time."""
    rnd = random.Random(seed)
    return [(1 if rnd.random() < 0.66 else rnd.randint(2, 5), round(rnd.random() * 12 if rnd.random() < 0.5 else 4 + rnd.random(), 3), i)
            for i in range(n)]


def test_gap_distance_matches_hand_values(spark):
    lc = curve(spark, [i * 0.02 for i in range(501)] + [15 + i * 0.02 for i in range(501)])
    ev = spark.createDataFrame([(1, 1, 0, 5.0), (1, 1, 1, 9.92)], "tic bigint, sector bigint, event_id bigint, event_time double")
    got = {r["event_id"]: r["gap_proximity"] for r in gaps.gap_distance(lc, ev, "event_time").collect()}
    assert got[0] == pytest.approx(5.0) and got[1] == pytest.approx(0.08)


def test_single_cadence_curve_has_no_gap_distance(spark):
    ev = spark.createDataFrame([(1, 1, 0, 5.0)], "tic bigint, sector bigint, event_id bigint, event_time double")
    assert gaps.gap_distance(curve(spark, [5.0]), ev, "event_time").first()["gap_proximity"] is None


def test_duplicate_groups(spark):
    rows = [(1, 1, i, t, float(i)) for i, t in enumerate([100.0, 100.01, 100.02, 105.0, 105.5])]
    ev = spark.createDataFrame(rows, "tic bigint, sector bigint, event_id bigint, event_time double, snr double")
    got = sorted((r["event_id"], r["multiplicity"], r["is_canonical"]) for r in gaps.duplicate_groups(ev).collect())
    assert got == [(0, 3, 0), (1, 3, 0), (2, 3, 1), (3, 1, 1), (4, 1, 1)]


@pytest.mark.parametrize("gap", [0.003, 0.4])
def test_islands_and_neighbours_equal_brute_force_on_hot_key(spark, gap):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k bigint, t double, i bigint")
    want, prev = {}, {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, i) for kk, t, i in rows if kk == key)
        n = 0
        for j, (t, i) in enumerate(mine):
            n += int(j > 0 and t - mine[j - 1][0] > gap)
            want[i], prev[i] = n, mine[j - 1][0] if j else None
    got = {r["i"]: r["island"] for r in islands(df, ["k"], "t", gap, tie=["i"], width=0.5).collect()}
    assert got == want
    near = with_neighbours(df, ["k"], "t", ["i"], ["i"], 0.5).collect()
    assert {r["i"]: r["_prev"]["t"] if r["_prev"] else None for r in near} == prev


def test_locate_equals_brute_force_on_hot_key(spark):
    pts, qs = hot_rows(400, 1), hot_rows(150, 2)
    got = {r["i"]: r for r in locate(spark.createDataFrame(pts, "k bigint, t double, j bigint").drop("j"),
                                     spark.createDataFrame(qs, "k bigint, t double, i bigint"), ["k"], "t", width=0.7).collect()}
    for key, t, i in qs:
        mine = [p for kk, p, _ in pts if kk == key]
        assert got[i]["n_lt"] == sum(p < t for p in mine) and got[i]["n_le"] == sum(p <= t for p in mine)
        low, high = [p for p in mine if p <= t], [p for p in mine if p >= t]
        assert (got[i]["prev"]["t"] if got[i]["prev"] else None) == (max(low) if low else None)
        assert (got[i]["next"]["t"] if got[i]["next"] else None) == (min(high) if high else None)


def test_quantiles_exact_on_hot_key_with_outliers(spark):
    rows = [(kk, t if i % 50 else 1e6, i) for kk, t, i in hot_rows(900, 3)]
    got = {r["k"]: r for r in rank.quantiles(spark.createDataFrame(rows, "k bigint, t double, i bigint"), ["k"], "t",
                                             {"m": 0.5, "q": 0.9}).collect()}
    for key in got:
        v = sorted(t for kk, t, _ in rows if kk == key)
        h = (len(v) - 1) * 0.9
        assert got[key]["m"] == pytest.approx(statistics.median(v)) and got[key]["n"] == len(v)
        lo, hi = v[math.floor(h)], v[math.ceil(h)]
        assert got[key]["q"] == pytest.approx(lo + (hi - lo) * (h - math.floor(h)))


def test_rank_is_total_under_heavy_ties(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3 / lit(10)).alias("s"))
    got = sorted((r["rank"], -r["s"], r["id"]) for r in rank.ranked(df, "s", ["id"]).collect())
    assert [g[0] for g in got] == list(range(1, 501)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_perfect_and_useless_rankers(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.5, 1), ("b", 0.5, 0)], "k string, s double, y int")
    got = {r["k"]: r for r in rank.ranking_quality(df, ["k"], "s", "y").collect()}
    assert got["a"]["roc_auc"] == 1 and got["a"]["average_precision"] == 1
    assert got["b"]["roc_auc"] == 0.5 and got["b"]["average_precision"] == 0.5


PAIR_SCHEMA = "tic bigint, event_id bigint, event_time double, duration double, depth double, period double"


def test_partner_never_one_period_away(spark):
    ev = spark.createDataFrame([(1, 0, 100.0, 0.3, 0.01, 11.5), (1, 1, 111.5, 0.3, 0.01, 11.5)], PAIR_SCHEMA)
    assert {r["n_candidates"] for r in pairs.nearest_partner(ev, ["tic"]).collect()} == {0}


def test_partner_ratio(spark):
    ev = spark.createDataFrame([(1, 0, 100.0, 0.55, 0.01, 11.5), (1, 1, 102.3, 0.064, 0.005, 11.5)], PAIR_SCHEMA)
    got = {r["event_id"]: r for r in pairs.nearest_partner(ev, ["tic"]).collect()}
    assert got[0]["n_candidates"] == 1 and got[0]["pair_duration_ratio"] < 0.3 and got[0]["partner_depth"] == 0.005


def test_recurring_dip_separates_from_one_off(spark):
    period, rows = 11.5, []
    for cycle in range(12):
        for i in range(-60, 61):
            t = cycle * period + 0.30 * period + i / 48
            rows.append((1, 1, t, 1.0 - (0.01 if abs(i) <= 3 else 0.0) * (1 if cycle >= 0 else 0), (t / period) % 1, cycle * 1000 + i))
    def depth(recurs):
        data = [(a, b, t, f if recurs or c // 1000 == 2 and abs(c - 2000) < 100 else 1.0, ph, c) for a, b, t, f, ph, c in rows]
        lc = spark.createDataFrame(data, "tic bigint, sector bigint, time double, flux double, phase double, cadence bigint")
        ev = spark.createDataFrame([(1, 7, 2 * period + 0.30 * period, 0.30, 0.01, 0.2, period)],
                                   "tic bigint, event_id bigint, event_time double, phase double, depth double, duration double, period double")
        # The event sits in cycle 2; shift its epoch so that its own cycle is 0.
        stack = views.stacked(views.fold_pairs(lc, ev, ["cadence"]), spark.createDataFrame([(7, 1e-4)], "event_id bigint, local_scatter double"), ["event_id"])
        return views.recurrence_scalars(stack, ["event_id"]).first()
    assert depth(True)["rec_depth_med"] - depth(False)["rec_depth_med"] > 0.3


def test_eclipse_mask_wraps_at_phase_one(spark):
    df = spark.createDataFrame([(0.003,), (0.997,), (0.1,)], "p double")
    got = [r[0] for r in df.select(in_eclipse(F.col("p"), (lit(1.0), lit(0.01)))).collect()]
    assert got == [True, True, False]


def test_physics_uses_wrapped_spacing(spark):
    df = spark.range(1).select(*physics.eccentricity(lit(1.0002), lit(5.3e-05), lit(0.02), lit(0.02)))
    ec, es, e = df.first()
    assert ec == pytest.approx(math.pi / 2 * (0.999853 - 0.5)) and es == 0 and e <= 0.95


def test_depth_floor(spark):
    row = spark.range(1).select(depth_floor(lit(1e-9), lit(1e-3)).alias("a"), depth_floor(lit(1e-2), lit(1e-4)).alias("b")).first()
    assert row["a"] == pytest.approx(3e-3) and row["b"] == pytest.approx(1e-2)


COMPARATOR = "ingest int, filename string, best_fit string, " + ", ".join(f"{c} double" for c in [*k.AIC_COLUMNS, *k.RMSE_COLUMNS])


def test_incumbent_block_keeps_dropped_keys(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    rows = spark.createDataFrame([(2, "a", "T", 1.0, 14.0, 20.0, 18.0, 1.0, 2.0, 3.0, 4.0), (1, "a", "T", 10.0, 14.0, 20.0, 18.0, 1.0, 2.0, 3.0, 4.0)], COMPARATOR)
    got = {r["filename"]: r for r in incumbent.incumbent_block(keys, rows, "ingest").collect()}
    assert [got["a"][f"delta_{c}"] for c in k.AIC_COLUMNS] == [0, 4, 10, 8] and got["a"]["best_fit_T"] == 1
    assert len(k.INCUMBENT_COLUMNS) == 17 and len(k.CORE_SCALARS + k.INCUMBENT_COLUMNS + k.HOST_SCALARS + k.PAIR_SCALARS) == 39
    assert all(got[x]["incumbent_valid"] == 0 and got[x]["rmse_transit"] == 0 for x in "bc")


def test_unknown_class_fails(spark):
    keys = spark.createDataFrame([("a",)], "filename string")
    rows = spark.createDataFrame([(1, "a", "WAT", *[1.0] * 8)], COMPARATOR)
    with pytest.raises(Exception, match="best_fit outside"):
        incumbent.incumbent_block(keys, rows, "ingest").collect()


def test_feature_gate_refuses_audit_and_missing(spark):
    df = spark.range(1).select(*[lit(0).alias(c) for c in k.INCUMBENT_COLUMNS], F.lit(1).alias("label"))
    assert incumbent.gated_features(df, "b0").columns == k.INCUMBENT_COLUMNS
    assert (len(incumbent.arm_columns("b")), len(incumbent.arm_columns("b_nopair"))) == (37, 33)
    with pytest.raises(AssertionError):
        incumbent.gated_features(df, "b0", features=[*k.INCUMBENT_COLUMNS, "label"])
    with pytest.raises(KeyError):
        incumbent.gated_features(df, "b")


def test_split_is_disjoint_pinned_and_verifiable(spark):
    rnd = random.Random(0)
    rows = [(1000 + s, int(rnd.random() < 0.3), s % 30) for s in range(120) for _ in range(rnd.randint(1, 39))]
    ev = spark.createDataFrame(rows, "tic bigint, label int, n_cycles_raw bigint")
    host = spark.createDataFrame([(1000 + s, rnd.uniform(5, 40), rnd.uniform(8, 15)) for s in range(120)], "tic bigint, period double, tmag double")
    done = split.stratified_split(split.system_table(ev, host), [1003, 1007]).cache()
    got = {r["tic"]: r["split"] for r in done.collect()}
    assert len(got) == done.count() == 120 and got[1003] == got[1007] == "test"
    good = ev.join(done.select("tic", "split"), "tic")
    assert split.split_violations(good, done, [1003]).count() == 0
    bad = good.withColumn("split", F.when(F.col("tic") == 1001, "moved").otherwise(F.col("split")))
    assert split.split_violations(bad, done).select("tic").distinct().collect()[0][0] == 1001


def test_rebalance_matches_rates_and_leaves_positives(spark):
    rows = [(i, 1, i % 2) for i in range(200)] + [(1000 + i, 0, int(i % 10 < 3)) for i in range(1000)]
    out = sampling.rebalance(spark.createDataFrame(rows, "id bigint, label int, inverted int"), "s", "id")
    rep = sampling.rebalance_report(out).first()
    assert out.count() == 1200 and out.where("label = 1 and rebalance_keep = 0").count() == 0
    assert rep["gap_after"] < 0.01 < rep["gap_before"]


def test_planted_dip_is_recovered(spark):
    rnd = random.Random(4)
    rows = [(1, 1, i / 48, 1 + rnd.gauss(0, 2e-4) - (0.01 if abs(i / 48 - 6.0) < 0.15 else 0)) for i in range(576)]
    lc = spark.createDataFrame(rows, "tic bigint, sector bigint, time double, flux double")
    found = search.search(lc, ["tic", "sector"], [1.0, 2.0, 3.0], 1.5 / 48, 1 / 48, 0.2).orderBy(F.desc("snr")).first()
    assert abs(found["event_time"] - 6.0) < 0.15 and found["n_detrend_detections"] >= 3 and found["depth"] == pytest.approx(0.01, rel=0.2)


def test_curve_files_round_trip_and_quarantine(spark, tmp_path):
    path = str(tmp_path / "lc")
    lc = spark.createDataFrame([(12, 3, 1.5, 0.25, 1e-3, 0.125), (12, 3, 2.5, float("nan"), 1e-3, 0.5), (13, 104, 1.0, 1.0, 1e-3, 0.0)],
                               "tic bigint, sector bigint, time double, flux double, flux_err double, phase double")
    curves.write_curves(lc, path)
    (tmp_path / "lc" / "TIC_14_05.txt").write_text("TIME FLUX FLUX_ERR PHASE ECL_MASK\n")
    got = sorted(tuple(r)[:4] for r in curves.scan_curves(spark, path).collect())
    assert got == [(12, 3, 1.5, 0.25), (12, 3, 2.5, None), (13, 104, 1.0, 1.0)]
    expected = spark.createDataFrame([("TIC_12_03.txt",), ("TIC_13_104.txt",), ("TIC_14_05.txt",)], "file string")
    assert {r["file"]: r["n_rows"] for r in curves.unusable_files(spark, path, expected).collect()} == {"TIC_13_104.txt": 1, "TIC_14_05.txt": 0}
    with pytest.raises(Exception, match="too many unusable"):
        curves.unusable_files(spark, path, expected, 1).collect()


def test_digest_gate_and_guarded_join(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "file string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "file string, sha256 string")
    assert {(r[0], r[1]) for r in artifacts.digest_mismatches(a, b).collect()} == {("y", "changed"), ("z", "missing")}
    with pytest.raises(Exception, match="digests differ"):
        artifacts.digest_gate(a, a, b).collect()
    table = spark.createDataFrame([(1, "p"), (1, "q")], "k bigint, v string")
    with pytest.raises(Exception, match="repeats"):
        sets.many_to_one(spark.createDataFrame([(1,)], "k bigint"), table, ["k"], ["k"]).collect()


def test_incumbent_block_needs_an_order_and_keeps_the_first_row(spark):
    keys = spark.createDataFrame([("a",)], "filename string")
    rows = spark.createDataFrame([(1, "a", "Sin", 10.0, *[9.0] * 7), (2, "a", "T", 1.0, *[9.0] * 7)], COMPARATOR)
    got = incumbent.incumbent_block(keys, rows, "ingest").first()
    assert got["best_fit_Sin"] == 1 and got["best_fit_T"] == 0
    with pytest.raises(KeyError, match="ingest order"):
        incumbent.incumbent_block(keys, rows.drop("ingest"), "ingest")


def test_rebalance_thins_a_null_stratum(spark):
    rows = [(i, 1, int(i % 10 < 2), None) for i in range(200)] + [(1000 + i, 0, int(i % 2), None) for i in range(500)]
    rows += [(5000 + i, 0, int(i % 2), "s") for i in range(500)]
    out = sampling.rebalance(spark.createDataFrame(rows, "id bigint, label int, inverted int, stratum string"), "s", "id", ["stratum"])
    kept = {r["stratum"]: r["n"] for r in out.where("label = 0 and rebalance_keep = 1").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 1200 and kept[None] == kept["s"] == 250 + 62


def test_rollup_keeps_missions_without_events(spark):
    ev = spark.createDataFrame([("planet", "A", 1, True)], "kind string, mission string, matched int, passed boolean")
    kn = spark.createDataFrame([("planet", "A"), ("planet", "B"), ("planet", "B")], "kind string, mission string")
    got = {r["mission"]: (r["d1"], r["n_pass"], r["d2"], r["wilson_lo"] is None) for r in matching.mission_rollup(ev, kn).collect()}
    assert got == {"A": (1, 1, 1, False), "B": (0, 0, 2, True)}


@pytest.mark.parametrize("n", [1 << 14, 1 << 17])
def test_design_points_never_repeat(spark, n):
    d = sampling.design_points(spark.range(n), "id")
    axes = d.select(*[F.count_distinct(c) for c in ("depth", "duration", "impact", "u1", "u2")]).first()
    assert all(x == n for x in axes) and d.where("warp > 0").select(F.count_distinct("warp"), F.count("*")).first()[0] > 0.29 * n


def test_split_follows_its_targets_at_any_size(spark):
    s = spark.range(10_000).select(F.col("id").alias("tic"), F.lit("3to9|lo|lo").alias("stratum"), (1 + F.floor(F.lit(4000) / (F.col("id") + 1))).alias("n_events"))
    done = split.stratified_split(s).join(s.select("tic", "n_events"), "tic").groupBy("split").agg(F.sum("n_events").alias("m")).collect()
    total, worst = sum(r["m"] for r in done), 4001 * math.log2(10_000)
    shares = {r["split"]: r["m"] for r in done}
    assert all(abs(shares[x] - g * total) <= worst for x, g in zip(k.SPLITS, k.SPLIT_TARGETS))


def test_positions_in_a_group_with_most_rows(spark):
    s = spark.range(3000).select(F.col("id").alias("tic"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.col("id") % 7).alias("n"))
    got = sorted(tuple(r) for r in queue.rank_in_group(s, "g", "n", "tic").collect())
    want = []
    for g in "ab":
        mine = [x for x in range(3000) if (x % 10 == 0) == (g == "b")]
        want += [(x, g, i + 1) for i, x in enumerate(sorted(mine, key=lambda x: (-(x % 7), x)))]
    assert got == sorted(want)


def test_map_digest_ignores_order_only(spark):
    rows = [(i, "train" if i % 3 else "val") for i in range(50)]
    one, two = (split.map_digest(spark.createDataFrame(r, "tic bigint, split string")).first()[0] for r in (rows, rows[::-1]))
    other = split.map_digest(spark.createDataFrame([*rows[:-1], (49, "val")], "tic bigint, split string")).first()[0]
    assert one == two != other


def test_ranges_hold_their_share_whatever_the_values(spark):
    v = F.when(F.col("id") == 7, lit(1e9)).when(F.col("id") % 2 == 0, F.rand(1) * 1e-9).otherwise(F.randn(2))
    df = spark.range(100_000).select("id", v.alias("v"))
    rows = rank.ranges(df, ["v", "id"], share=2_000).groupBy("_b").agg(
        F.count(lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert sum(r["n"] for r in rows) == 100_000 and max(r["n"] for r in rows) <= 4_000
    assert all(a["hi"] <= b["lo"] for a, b in zip(rows, rows[1:]))
    one = rank.ranked(df, "v", ["id"]).where("rank <= 2").orderBy("rank").collect()
    assert one[0]["id"] == 7 and one[1]["v"] < 10
