"""Planted answers and invariants for what SQL cannot state."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bandweave import schema
from bandweave.functions import augment, geo, keys, labels as L, masks as M, rules as R, spectral as S
from bandweave.operators import aggregates as A, curate as C, endmembers as E, evaluate, fitting, graph, grid as H, joins as J, prepare, ranking, review, sampling, split
from bandweave.session import collect_bounded, cut_lineage
from bandweave.sources import log, scans, sinks


# ------------------------------------------------------------------- contracts

def test_band_columns_order_and_errors():
    assert schema.band_columns(["m1", "m0", "tile_id", "m2"]) == ["m0", "m1", "m2"]
    assert schema.rename_bands(["band_00", "band_01"], ["m0", "m1"]) == {"m0": "band_00", "m1": "band_01"}
    for bad in (["m0", "m2"], ["m0", "band_00"], ["tile_id"]):
        with pytest.raises(ValueError):
            schema.band_columns(bad)
    with pytest.raises(ValueError):
        schema.rename_bands(["band_00"], ["m0", "m1"])


def test_channel_order_is_fatal():
    schema.check_channels(["a", "b"], ["a", "b"])
    with pytest.raises(ValueError):
        schema.check_channels(["b", "a"], ["a", "b"])


def test_smoothing_contradiction():
    assert schema.resolve_smoothing(True, None) is True
    with pytest.raises(ValueError):
        schema.resolve_smoothing(True, False)


def test_collect_bound(spark):
    assert len(collect_bounded(spark.range(5), 5, "x")) == 5
    with pytest.raises(ValueError):
        collect_bounded(spark.range(6), 5, "x")


# --------------------------------------------------------------------- ranking

@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_totals_any_partitioning(spark, parts):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = ranking.running_totals(df, ["k"], ["v"], {"c": F.lit(1)}, partitions=parts)
    assert out.where(F.col("c") != F.floor(F.col("v") / 3) + 1).count() == 0


def test_hot_group_percentiles(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    got = {r["k"]: r for r in ranking.exact_percentiles(df, ["k"], "v", {"p": 0.37}).collect()}
    rows = df.toPandas()
    for k in ("hot", "cold"):
        assert math.isclose(got[k]["p"], np.percentile(rows.v[rows.k == k], 37))


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["p"] for r in ranking.exact_percentiles(df, ["k"], "v", {"p": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_large_cap_takes_the_first_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = ranking.first_per_group(df, ["k"], [F.asc("v")], 1500).groupBy("k").agg(F.count("v").alias("n"), F.max("v").alias("m")).collect()
    assert sorted((r["k"], r["n"], r["m"]) for r in out) == [(0, 1500, 2998), (1, 1500, 2999)]


def test_caps_of_every_size_and_their_rounds(spark):
    """Null and hot groups, equal rows and rows that tie; a tournament of three rounds beyond the group limit."""
    hot = [("hot", i % 7, {"m": i}) for i in range(3000)] + [(None, i, None) for i in range(5)] + [("same", 1, None)] * 40
    df = spark.createDataFrame(hot, "k string, v int, `odd.name` map<string,int>").repartition(5)
    for n in (1, 3, 900, 1100):
        out = ranking.first_per_group(df, ["k"], [F.desc("v")], n)
        got = {r["k"]: (r["n"], r["least"]) for r in out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).collect()}
        want = sorted((v for k, v, _ in hot if k == "hot"), reverse=True)[:n]
        assert got == {"hot": (n, min(want)), None: (min(n, 5), max(5 - n, 0)), "same": (min(n, 40), 1)}
        assert out.columns == df.columns and str(out._jdf.queryExecution().optimizedPlan()).count("Window [row_number") == (3 if n > ranking.GROUP_LIMIT else 1)
    assert ranking.first_per_group(df.limit(0), ["k"], [F.asc("v")], 2).count() == 0


# ---------------------------------------------------------------------- medoids

def medoid_rows(spark, groups):
    rows = [(g, f"{g}-{i:04d}", [float(x) for x in v]) for g, vectors in groups.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "class string, uid string, spectrum array<double>")


def test_medoids_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    close = rng.normal(size=12) + np.linspace(1, 3, 12)
    groups = {"far": rng.normal(size=(150, 12)), "close": close + 0.05 * rng.normal(size=(150, 12)), "tight": close + 1e-5 * rng.normal(size=(40, 12)),
              "equal": np.tile(close, (9, 1)), "opposed": np.concatenate([np.tile(close, (4, 1)), np.tile(-close, (5, 1))]),
              "zero": np.concatenate([np.zeros((3, 12)), rng.normal(size=(20, 12))]), "two": rng.normal(size=(2, 12)), "lone": rng.normal(size=(1, 12))}
    df = medoid_rows(spark, groups)
    for count in (1, 4):
        angles = E.mean_angles(df, ["class"], "uid").collect()
        want = set()
        for g in groups:
            own = sorted((round(r["mean_angle"], 12), r["uid"]) for r in angles if r["class"] == g)
            want |= {(g, uid, "medoid" if k == 0 else f"candidate{k + 1}") for k, (_, uid) in enumerate(own[:count])}
        got = {(r["class"], r["uid"], r["kind"]) for r in E.medoids(df, ["class"], "uid", count).collect()}
        assert got == want


def test_medoids_with_null_groups_bad_bands_and_no_rows(spark):
    rows = [(None, "a", [1.0, 0.0]), (None, "b", [1.0, 0.1]), (None, "c", [0.0, 1.0]), ("x", "d", [1.0, None]), ("x", "e", None), ("x", "f", [2.0, float("nan")]), ("x", "g", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "class string, uid string, spectrum array<double>")
    assert {(r["class"], r["uid"]) for r in E.medoids(df, ["class"], "uid").collect()} == {(None, "b"), ("x", "g")}
    assert E.medoids(df.limit(0), ["class"], "uid").count() == 0


def test_angle_bounds_hold():
    rng = np.random.default_rng(5)
    for spread in (1e-7, 1e-5, 1e-3, 0.1, 1.0, 30.0):
        u = rng.normal(size=8) + spread * rng.normal(size=(300, 8))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        angle = np.arccos(np.clip(u @ u.T, -1, 1)).sum(axis=1) / 299
        low, high = E.angle_bounds(u, 300, u.sum(axis=0), u.T @ u)
        assert (low <= angle + E.BOUND_SLACK).all() and (angle <= high + E.BOUND_SLACK).all()


def test_few_rows_are_measured_for_the_medoids(spark, sf_dir):
    """Pairs measured on the given vectors, as a share of all pairs of their classes."""
    from bandweave.plans.spectral_plans import polygons
    df = polygons(spark, sf_dir.replace("sf0.001", "sf0.1"))
    sizes = df.groupBy("class").agg(F.count(F.lit(1)).alias("__n"))
    blocks = E._packed(df.select("class", "vec_id", "spectrum"), ["class"], "vec_id", "spectrum")
    asked = E.medoid_candidates(blocks, ["class"], "vec_id", "spectrum", 1).join(sizes, "class").agg(F.sum("__n")).first()[0]
    print("share of pairs measured", asked / sizes.agg(F.sum(F.col("__n") * F.col("__n"))).first()[0])
    assert asked < 0.2 * sizes.agg(F.sum(F.col("__n") * F.col("__n"))).first()[0]


# -------------------------------------------------------------------- spectral

def test_hull_equals_brute_force():
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.random(12)), rng.random((40, 12))
    hull = S.upper_hull(x, y)
    for row, got in zip(y, hull):
        want = [max([row[i]] + [row[a] + (row[b] - row[a]) * (x[i] - x[a]) / (x[b] - x[a]) for a in range(i + 1) for b in range(i, 12) if b > a]) for i in range(12)]
        assert np.allclose(got, want)


def test_continuum_edge_cases(spark):
    line = [0.1 + 0.001 * i for i in range(59)]
    dip = [v * (0.8 if 30 <= i <= 34 else 1.0) for i, v in enumerate(line)]
    bad = [float("nan")] + line[1:]
    df = spark.createDataFrame([(0, line), (1, [0.0] * 59), (2, dip), (3, bad), (4, None)], "id int, s array<double>")
    r = {x["id"]: x for x in df.select("id", S.hull_removed("s").alias("h"), S.linear_removed("s").alias("l")).collect()}
    assert all(v == 1.0 for v in r[1]["h"]) and all(v == 1.0 for v in r[1]["l"])
    assert all(v == 1.0 for v in r[3]["h"]) and all(v == 1.0 for v in r[3]["l"])
    assert max(r[2]["h"]) <= 1.0 and min(r[2]["h"][30:35]) < 0.85
    assert [r[2]["h"][i] for i in (16, 17, 18, 19)] == [1.0] * 4
    assert r[4]["h"] is None


@pytest.mark.parametrize("name", ["hull_continuum", "dual_continuum", "linear_continuum", "patch_continuum", "ready_for_angles", "mean_band_depth"])
def test_faint_bands_equal_the_check_sql(spark, tmp_path, name):
    from bandweave.plans import catalog
    from oracle_check import compare, connect
    rows = np.random.default_rng(5).uniform(0.05, 0.5, (12, 64)).astype(np.float32)
    rows[1, 0], rows[2, 63], rows[3, 1], rows[4, [0, 63]], rows[5, 0], rows[6] = 5e-7, 5e-7, 5e-7, 9e-7, 0.0, rows[6] * 1e-6
    table = pa.table({"vec_id": pa.array(range(12), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 12, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), name, catalog.QUERIES[name], catalog.ORACLES[name]).startswith("ok")


def test_hull_floor_is_that_of_the_reference(spark):
    df = spark.createDataFrame([(0, [5e-7, 0.2, 0.4]), (1, [0.0, 0.0, 0.0])], "id int, s array<double>")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", S.hull_removed("s", [1.0, 2.0, 3.0]).alias("a"), S.hull_removed("s", [1.0, 2.0, 3.0], floor=None).alias("b")).collect()}
    assert got[0][0][0] == 5e-7 and got[0][1][0] == 1.0 and got[1] == ([1.0] * 3, [1.0] * 3)


def test_angle_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 1.0], [-1.0, -1.0]), (3, [0.0, 0.0], [1.0, 1.0]),
                                (4, [1.0, nan, 0.0], [1.0, 5.0, 0.0]), (5, [1.0, nan], [1.0, 1.0])], "id int, a array<double>, b array<double>")
    got = {r["id"]: r["x"] for r in df.select("id", S.angle("a", "b").alias("x")).collect()}
    assert got[0] == 0.0 and math.isclose(got[1], math.pi / 2) and math.isclose(got[2], math.pi, abs_tol=1e-6)
    assert got[3] is None and got[4] == 0.0 and got[5] is None


def test_zero_spectrum_is_ninety_degrees(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "s array<double>")
    assert df.select(S.angles_to("s", [[1.0, 0.0]])[0]).first()[0] == 90.0


def test_resample_needs_two_samples(spark):
    df = spark.createDataFrame([([1.0, 2.0], [65535.0, 3.0])], "v array<double>, w array<double>")
    with pytest.raises(Exception, match="fewer than two"):
        df.select(S.resampled("v", "w", [1.0])).collect()


def test_noise_is_repeatable(spark):
    df = spark.range(4).select("id", F.array(*[F.lit(0.2)] * 59).alias("s"))
    draw = lambda parts: sorted((r["id"], tuple(r["x"])) for r in df.repartition(parts).select("id", augment.augmented("s", augment.row_seed(1, "id")).alias("x")).collect())
    assert draw(1) == draw(3)
    assert list(augment.seam_profile(59)[13:18] > 0) == [True] * 5 and augment.seam_profile(118)[74] == 1.0


# ----------------------------------------------------------------------- rules

def test_rules_open_cut_points_never_fire(spark):
    df = spark.createDataFrame([(0.5, 0.1)], "OLINDEX3 double, LCPINDEX2 double")
    got = df.select(*[c.alias(n) for n, c in R.rule_scores(df, R.empty_rules(["olivine", "lcp", "bland", "junk"])).items()]).first()
    assert (got["olivine"], got["lcp"], got["bland"], got["junk"]) == (0.0, 0.0, 1.0, 0.0)


def test_rules_missing_block():
    with pytest.raises(KeyError):
        R.rule_scores(type("T", (), {"columns": []})(), {"vocab": ["olivine"], "junk": {}, "classes": {}})


def test_float32_step():
    for x in (0.1, -0.25, 0.0, 1e-3, -1e-40):
        assert fitting.next_float32(x) == float(np.nextafter(np.float32(x), np.float32(np.inf)))


def test_joint_vetoes_keep_the_floor(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random(), rng.random(), rng.random()) for _ in range(400)]
    df = spark.createDataFrame([tuple(float(np.float32(v)) for v in r) for r in rows], "ICER1_2 double, BD1435 double, VAR double, R770 double")
    cuts = fitting.fit_vetoes(df, set(df.columns), 0.9)
    kept = df.where(~R.junk_flag(set(df.columns), cuts)).count()
    assert 360 <= kept <= 364


def test_calibration_floor_and_inert_class(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0.3 if i % 2 else 0.0, 0.1), rng.random(), i % 2, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "OLINDEX3 double, LCPINDEX2 double, y_olivine int, y_lcp int")
    config = fitting.calibrate(df, ["olivine", "lcp"], ["olivine", "lcp", "bland", "junk"])
    assert config["classes"]["lcp"]["primary"]["threshold"] is None
    assert config["calibration"]["classes"]["olivine"]["retained_after_vetoes"] >= 0.9
    assert config["classes"]["olivine"]["ladder"][0][0] == config["classes"]["olivine"]["primary"]["threshold"]


# ------------------------------------------------------------ budgets and splits

def naive_fill(capacity, budget, tiers):
    alloc = {k: min(budget // len(capacity), c) for k, c in capacity.items()}
    left = budget - sum(alloc.values())
    named = [k for t in tiers for k in t]
    for tier in [*tiers, [k for k in capacity if k not in named]]:
        moved = True
        while left and moved:
            moved = False
            for k in tier:
                if left and alloc[k] < capacity[k]:
                    alloc[k], left, moved = alloc[k] + 1, left - 1, True
    return alloc


@pytest.mark.parametrize("seed", range(6))
def test_equal_fill_matches_one_by_one(seed):
    rng = random.Random(seed)
    capacity = {f"k{i}": rng.randint(0, 30) for i in range(8)}
    tiers = [["k3", "k1"], ["k0", "k5", "k7"]]
    for budget in (0, 5, 60, 500):
        got = sampling.equal_fill(capacity, budget, tiers)
        assert sum(got.values()) == min(budget, sum(capacity.values())) and (not budget or got == naive_fill(capacity, budget, tiers))


def shares_of(units, chosen, name, c):
    total = sum(u[c] for u in units)
    return {s: sum(u[c] for u in units if chosen[u[name]] == s) / total for s in split.SPLITS}


def test_unit_balance_and_holdout(spark):
    rng = random.Random(2)
    units = [{"unit": f"u{i:03d}", "a": n, "b": n if i % 4 == 0 else 0} for i, n in enumerate(rng.choices(range(5, 60), k=200))]
    out = split.dealt(spark.createDataFrame(units), "unit", ["a", "b"], 2, split.SHARES, True).collect()
    chosen = {r["unit"]: r["split"] for r in out}
    assert len(out) == len(chosen) == 200
    for c in ("a", "b"):
        part = shares_of(units, chosen, "unit", c)
        assert abs(part["train"] - 0.7) < 0.05 and part["val"] >= 0.05 and part["test"] >= 0.05 and part["val"] <= 0.171


def test_giant_units_and_two_unit_classes(spark):
    rng = random.Random(5)
    rows = [(rng.randint(10_000, 30_000), 0, 0) for _ in range(20)] + [(0, 9455, 0), (0, 7800, 7800), (0, 2976, 0), (0, 1403, 0)]
    rows += [(0, 300, 0)] * 15 + [(0, 0, n) for n in (4846, 3282, 1659, 1261, 816, 713, 613, 596, 585, 571, 562, 487, 404, 334)]
    units = [{"unit": f"u{i:02d}", "m": m, "alt": a, "plag": p} for i, (m, a, p) in enumerate(rows)]
    chosen = {r["unit"]: r["split"] for r in split.dealt(spark.createDataFrame(units), "unit", ["m", "alt", "plag"], 42, split.SHARES, True).collect()}
    for c in ("m", "alt", "plag"):
        part = shares_of(units, chosen, "unit", c)
        assert all(abs(part[s] - split.SHARES[s]) <= 0.05 for s in split.SPLITS), (c, part)
    pair = [{"unit": "x0", "x": 100_000, "y": 0}, {"unit": "x1", "x": 90_000, "y": 0}] + [{"unit": f"y{i}", "x": 0, "y": 3000} for i in range(16)]
    chosen = {r["unit"]: r["split"] for r in split.dealt(spark.createDataFrame(pair), "unit", ["x", "y"], 42, split.SHARES, True).collect()}
    part = shares_of(pair, chosen, "unit", "x")
    assert part["val"] >= split.MIN_HOLDOUT and part["test"] >= split.MIN_HOLDOUT


def test_tile_split_uses_all_splits(spark):
    tiles = [{"tile_id": f"t{i}", "hcp": i % 5, "plagioclase": i % 3, "lcp": 1 + i % 2} for i in range(60)]
    chosen = {r["tile_id"]: r["split"] for r in split.tile_balanced_split(spark.createDataFrame(tiles), 42).collect()}
    assert set(chosen.values()) == set(split.SPLITS) and len(chosen) == 60
    for c in split.RARE_CLASSES:
        assert abs(shares_of(tiles, chosen, "tile_id", c)["train"] - 0.7) < 0.08
    empty = spark.createDataFrame([], "tile_id string, hcp long, plagioclase long, lcp long")
    assert split.tile_balanced_split(empty, 42).count() == 0


# ----------------------------------------------------------------------- graphs

def test_components_of_a_chain_and_a_star(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(301, 400).select(F.lit(300).cast("bigint").alias("src"), F.col("id").alias("dst"))
    out = graph.connected_components(spark.range(410), chain.unionByName(star))
    assert {(r["component"], r["count"]) for r in out.groupBy("component").count().collect() if r["count"] > 1} == {(0, 201), (300, 100)}
    assert out.count() == 410


def test_links_wrap_and_stretch_at_high_latitude(spark):
    pts = [("a", 70.0, 359.95), ("b", 70.0, 0.4), ("c", 70.0, 1.6), ("d", 0.0, 359.9), ("e", 0.0, 0.1), ("f", 0.0, 0.4), ("g", 0.0, 0.4), ("h", -80.0, 10.0), ("i", -80.0, 11.3)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    got = {r["id"]: r["component"] for r in graph.connected_components(df, graph.distance_links(df, "id", 0.25)).collect()}

    def near(p, q):
        dlon = (p[2] - q[2] + 180) % 360 - 180
        return (p[1] - q[1]) ** 2 + (dlon * math.cos(math.radians((p[1] + q[1]) / 2))) ** 2 <= 0.0625

    want = {p[0]: p[0] for p in pts}
    for _ in pts:
        for p in pts:
            for q in pts:
                if near(p, q):
                    want[p[0]] = want[q[0]] = min(want[p[0]], want[q[0]])
    assert got == want


def test_equal_polygon_means_do_not_depend_on_row_order(spark):
    polygons = spark.createDataFrame([(k, ["a"]) for k in range(6)] + [(6, ["a"]), (7, ["b"])], "polygon_id long, minerals array<string>")
    orders = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1]]
    rows = [(3 * swap + k, [[0.2, p], [p, 0.2]][swap]) for swap in (0, 1) for k, order in enumerate(orders) for p in order] + [(6, [float("nan"), 1.0])]
    scores = spark.createDataFrame(rows, "polygon_id long, probs array<double>")
    got = {r["polygon_id"]: (r["n_pixels"], r["predicted_class"], r["correct"]) for r in evaluate.polygon_report(polygons, scores.coalesce(1), "polygon_id", ["a", "b"], "probs", "minerals").collect()}
    assert [got[k] for k in range(6)] == [(3, "a", True)] * 6
    assert got[6] == (1, "a", True) and got[7] == (0, "NONE", None)


def test_spectra_for_angles_are_not_clipped(spark):
    waves, keep = [1.0, 2.0, 3.0, 4.0, 5.0], list(range(5))
    rows = [(k, [scale * x for x in (0.4, 0.9, 0.6, 0.8, 0.5)]) for k, scale in ((0, 0.1), (1, 1.0), (2, 3.0))] + [(3, [0.1, 65535.0, 0.1, 0.1, 0.1])]
    out = prepare.ready_for_angles(spark.createDataFrame(rows, "id long, spectrum array<double>"), "spectrum", waves, keep)
    got = {r["id"]: r["spectrum"] for r in out.collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[1] == pytest.approx(got[0], abs=1e-6) and got[2] == pytest.approx(got[0], abs=1e-6) and min(got[0]) < 0.8


def test_equal_boxes_and_points_are_compared_once(spark):
    box = lambda p, n, wide: spark.range(n).select(F.col("id").alias(f"{p}id"), (F.col("id") % 2 * 1.5).alias(f"{p}x0"), F.lit(0.0).alias(f"{p}y0"),
                                                   (F.col("id") % 2 * 1.5 + wide).alias(f"{p}x1"), F.lit(5.0).alias(f"{p}y1"))
    a, b = box("a_", 1500, 1.0), box("b_", 40, 2.0)
    met = J.box_overlap(a, b, 4.0)
    assert met.columns == [*a.columns, *b.columns]
    got = {(r["a_id"], r["b_id"]) for r in met.collect()}
    assert len(got) == met.count() and got == {(i, j) for i in range(1500) for j in range(40) if i % 2 or not j % 2}
    points = spark.range(900).select((F.col("id") % 300).alias("id"), (F.col("id") % 5 + 0.5).alias("x"), F.lit(1.0).alias("y"))
    found = {(r["id"], r["x"]): r["box"] for r in J.first_containing(points, b.selectExpr("b_id + 7 AS box", "b_x0 AS x0", "b_y0 AS y0", "b_x1 AS x1", "b_y1 AS y1"), "id", "box", 4.0).collect()}
    assert found == {(k, k % 5 + 0.5): {0: 7, 1: 7, 2: 8, 3: 8}.get(k % 5) for k in range(300)}
    hot = J.met_in_cells(box("a_", 10_000, 1.0).withColumn("c", F.col("a_id") < 0), b.withColumn("c", F.col("b_id") < 0), ["c"], ["a_id"])
    shares = hot.select("a_id", F.spark_partition_id().alias("part")).distinct().groupBy("part").count().collect()
    assert hot.count() == 10_000 * 40 and max(r["count"] for r in shares) < 6_000


def test_synthetic_patches_leave_in_small_batches(spark):
    pack = augment._patch_list
    rows = spark.range(700).select(F.concat(F.lit("c"), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.array(F.lit(0.1), F.lit(0.2))).alias("s")).coalesce(1)
    out = augment.synthetic_rows(rows, "name", "s", 2, 9, "High")
    again = augment.synthetic_rows(rows.repartition(3), "name", "s", 2, 9, "High")
    assert "patch" in out.columns and "copy" not in out.columns
    got = {r["tile_id"]: r["patch"] for r in out.select("tile_id", "patch").collect()}
    assert got == {r["tile_id"]: r["patch"] for r in again.select("tile_id", "patch").collect()} and len(got) == 1400
    assert sum(p is None for p in got.values()) == 2 * 234 and all(len(p) == 49 and len(p[0]) == 2 for p in got.values() if p)
    assert pack(np.zeros((3, 4, 2)), np.array([True, False, True, True])).to_pylist() == [[[0.0] * 2] * 4, None, [[0.0] * 2] * 4, [[0.0] * 2] * 4]


def test_written_pixels_are_not_shuffled(spark, sf_dir):
    from bandweave.plans import source_plans
    from bandweave.plans.tables import PIXELS, derive
    path = source_plans.written(spark, sf_dir, "pixels")
    rows, table = derive(spark, sf_dir, PIXELS), spark.read.parquet(path)
    assert set(table.columns) == set(rows.columns) and table.select(*rows.columns).exceptAll(rows).isEmpty() and table.count() == rows.count()
    assert len([f for f in table.inputFiles() if "split=train" in f]) == rows.rdd.getNumPartitions()


def test_polygon_pixels_are_never_broadcast(spark):
    ring = F.expr("array(struct(0d AS x, 0d AS y), struct(3d AS x, 0d AS y), struct(3d AS x, 3d AS y), struct(0d AS x, 3d AS y))")
    polygons = spark.range(3).select(F.col("id").alias("polygon_id"), F.lit("t").alias("tile_id"), ring.alias("ring"))
    cells = spark.range(25).select(F.lit("t").alias("tile_id"), F.expr("id div 5").alias("pixel_row"), (F.col("id") % 5).alias("pixel_col"), F.col("id").alias("value"))
    met = J.polygon_pixel_join(polygons, cells)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["polygon_id"], r["value"]) for r in met.collect()) == [(p, 5 * r + c) for p in range(3) for r in range(3) for c in range(3)]


def test_close_points_across_the_pole(spark):
    pts = spark.createDataFrame([("a", 89.95, 0.0), ("b", 89.95, 180.0), ("c", 89.95, 91.0), ("d", 89.0, 0.0)], "id string, lat double, lon double").withColumn("g", F.lit("x"))
    comp = {r["id"]: r["component"] for r in graph.connected_components(pts, graph.distance_links(pts, "id", 0.25)).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert graph.close_pair_counts(pts.where("id = 'a'"), pts.where("id <> 'a'"), "g", 0.25).first()["pairs"] == 2


def test_dense_points_write_no_cell_pairs(spark, monkeypatch):
    written = []

    def counted(df):
        out = cut_lineage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    pts = spark.range(2500).select("id", ((F.col("id") % 50) * 0.05).alias("lat"), ((F.col("id") - F.col("id") % 50) / 50 * 0.05).alias("lon"))
    links = graph.distance_links(pts, "id", 0.25)
    assert sum(written) < 20 * 2500
    assert graph.connected_components(pts, links).select("component").distinct().count() == 1


def test_shared_pixels_stay_in_one_split(spark):
    rows = [("t1", 1, r, 0) for r in range(5)] + [("t1", 2, r, 0) for r in range(4, 1400, 200)] + [("t1", 3, 700 + r, 900) for r in range(3)]
    px = spark.createDataFrame(rows, "tile_id string, polygon_id long, pixel_row long, pixel_col long").withColumn("lcp", F.lit(1.0))
    centers = spark.createDataFrame([("t1", 32.5, 330.5)], "tile_id string, lat double, lon double")
    cents = A.centroids(px, centers, ["tile_id", "polygon_id"])
    units = {r["polygon_id"]: r["unit"] for r in split.polygon_units(px, cents).collect()}
    assert units[1] == units[2] != units[3]
    out = split.unit_balanced_split(px, cents, ["lcp"], 1)
    A.assert_no_leaks(out, ["tile_id", "pixel_row", "pixel_col"])
    with pytest.raises(AssertionError):
        A.assert_no_leaks(px.withColumn("split", F.when(F.col("polygon_id") == 1, "val").otherwise("train")), ["tile_id", "pixel_row", "pixel_col"])


def test_unknown_tile_fails(spark):
    px = spark.createDataFrame([("t9", 1, 0, 0)], "tile_id string, polygon_id long, pixel_row long, pixel_col long")
    centers = spark.createDataFrame([("t1", 0.0, 0.0)], "tile_id string, lat double, lon double")
    with pytest.raises(Exception, match="unknown tile t9"):
        A.centroids(px, centers, ["tile_id", "polygon_id"]).collect()


# ------------------------------------------------------------------------- grid

def mask_frame(spark, rows):
    cells = [("t", r, c, ch == "#") for r, line in enumerate(rows) for c, ch in enumerate(line)]
    return spark.createDataFrame(cells, "tile_id string, pixel_row long, pixel_col long, on boolean")


def test_regions_are_four_connected(spark):
    g = mask_frame(spark, ["##..#", ".##.#", "...#.", "#####"])
    table, pixels = H.regions(g.where("on"))
    assert sorted(r["count_px"] for r in table.collect()) == [2, 4, 6]
    assert pixels.count() == g.where("on").count()
    small, kept = H.regions(g.where("on"), min_px=4)
    assert sorted(r["count_px"] for r in small.collect()) == [4, 6] and kept.count() == 10


def test_shared_edges_are_not_counted_twice(spark):
    box = lambda i, x0: (i, "t", [(x0, 0.0), (x0 + 2.5, 0.0), (x0 + 2.5, 3.0), (x0, 3.0)])
    polys = spark.createDataFrame([box(1, 0.0), box(2, 2.5)], "polygon_id int, tile_id string, ring array<struct<x:double,y:double>>")
    px = geo.polygon_pixels(polys)
    assert px.count() == 15 and px.select("pixel_row", "pixel_col").distinct().count() == 15


def test_patch_is_zero_outside(spark):
    g = spark.createDataFrame([("t", r, c, [float(r * 2 + c + 1)]) for r in range(2) for c in range(2)], "tile_id string, pixel_row long, pixel_col long, s array<double>")
    got = H.patches(g.where("pixel_row = 0 AND pixel_col = 0"), g, "s", 1, 3).first()["patch"]
    assert [v[0] for v in got] == [0, 0, 0, 0, 1, 2, 0, 3, 4]


# ---------------------------------------------------------- tables and review

def test_review_weights_and_cases(spark):
    px = spark.createDataFrame([("u1", "t", 1, 1), ("u2", "t", 1, 2), ("u3", "t", 1, 3)], "polygon_uid string, tile_id string, pixel_row long, pixel_col long")
    d = spark.createDataFrame([("u1", "olivine", None, "Low", None), ("u2", "olivine", "lcp", "Low", ["hcp"]), ("u3", "olivine", "ambiguous", "Moderate", None)],
                              "polygon_uid string, predicted_class string, corrected_class string, confidence string, extra_classes array<string>")
    got = {r["polygon_uid"]: r for r in review.rejected_rows(px, d).collect()}
    assert (got["u1"]["negative_of"], got["u1"]["confidence_weight"], got["u1"]["confidence_tier"]) == ("olivine", 1.0, "High")
    assert (got["u2"]["negative_of"], got["u2"]["lcp"], got["u2"]["hcp"], got["u2"]["confidence_weight"]) == ("", 1.0, 1.0, 0.5)
    assert (got["u3"]["negative_of"], got["u3"]["lcp"], got["u3"]["confidence_tier"]) == ("ambiguous", 0.0, "Reviewed-Moderate")


def test_publish_keeps_the_old_version_until_done(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.publish(spark.range(3), path)
    sinks.publish(spark.range(5), path)
    assert sinks.current(spark, path).count() == 5 and sinks.latest_version(spark, path) == 1
    (tmp_path / "t" / "v00000001" / "_SUCCESS").unlink()
    assert sinks.current(spark, path).count() == 3


def log_rows(spark, *rows):
    return spark.createDataFrame(rows, "uid string, ts int, v string")


def files_under(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_log_keeps_the_newest_rows_whatever_the_order_of_batches(spark, tmp_path):
    path = f"{tmp_path}/u"
    read = lambda: sorted((r["uid"] or "", r["ts"], r["v"]) for r in log.read(spark, path, ["uid"], ["ts"]).collect())
    log.append(log_rows(spark, ("a", 5, "new"), ("a", 5, "new2"), ("b", 1, "b"), ("c", 2, "c"), (None, 1, "none")), path, 0)
    before = files_under(tmp_path / "u")
    for _ in range(2):  # a replayed batch changes nothing
        log.append(log_rows(spark, ("a", 3, "late"), ("b", 4, "b4")), path, 1)
        assert read() == [("", 1, "none"), ("a", 5, "new"), ("a", 5, "new2"), ("b", 4, "b4"), ("c", 2, "c")]
    log.append(log_rows(spark, ("c", 9, None)).withColumn("removed", F.lit(True)), path, 2)
    assert before.items() <= files_under(tmp_path / "u").items()  # earlier batches are not touched
    want = [("", 1, "none"), ("a", 5, "new"), ("a", 5, "new2"), ("b", 4, "b4")]
    assert read() == want
    log.compact(spark, path, ["uid"], ["ts"])
    assert read() == want
    log.append(log_rows(spark, ("c", 8, "older than its removal"), ("b", 4, "same order, later batch")), path, 3)
    assert read() == [*want[:3], ("b", 4, "same order, later batch")]
    (tmp_path / "u" / "batch-000000000003" / "_SUCCESS").unlink()  # a batch that was not finished is not read
    assert read() == want


def test_confirmed_pixels_follow_the_last_decision(spark, tmp_path):
    from bandweave.streaming.ledger import upsert_confirmed
    pixels = spark.createDataFrame([("a", "t", 1, 1), ("a", "t", 1, 2), ("b", "t", 5, 5), ("c", "t", 6, 6)], "polygon_uid string, tile_id string, pixel_row long, pixel_col long")
    path = f"{tmp_path}/c"
    write = upsert_confirmed(pixels, path, ["ts"])
    decided = lambda *rows: spark.createDataFrame([(*r, "High") for r in rows], "polygon_uid string, ts int, decision string, label_class string, confidence string").withColumn("extra_classes", F.lit(None).cast("array<string>"))
    read = lambda: sorted((r["polygon_uid"], r["pixel_col"], r["lcp"], r["hcp"]) for r in log.read(spark, path, ["polygon_uid"], ["ts"]).collect())
    write(decided(("a", 5, "confirm", "lcp"), ("b", 5, "confirm", "lcp")), 0)
    write(decided(("a", 2, "confirm", "hcp"), ("c", 1, "confirm", "hcp")), 1)  # an older confirm that arrives late
    assert read() == [("a", 1, 1.0, 0.0), ("a", 2, 1.0, 0.0), ("b", 5, 1.0, 0.0), ("c", 6, 0.0, 1.0)]
    write(decided(("b", 7, "reject", "lcp")), 2)  # a later reject takes the pixels away
    write(decided(("b", 6, "confirm", "hcp")), 3)
    assert read() == [("a", 1, 1.0, 0.0), ("a", 2, 1.0, 0.0), ("c", 6, 0.0, 1.0)]


def test_totals_go_on_after_a_restart(spark, tmp_path):
    from bandweave.streaming.ledger import run_totals
    put = lambda name, *rows: spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put("one", ("a", 1), ("b", 2))
    def run():
        stream = spark.readStream.schema("k string, v int").parquet(f"{tmp_path}/in").groupBy("k").agg(F.sum("v").alias("v"))
        run_totals(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r["k"], r["v"]) for r in log.read(spark, f"{tmp_path}/out", ["k"]).collect())
    assert run() == [("a", 1), ("b", 2)]
    put("two", ("a", 10))
    assert run() == run() == [("a", 11), ("b", 2)]


def test_order_statistics_on_awkward_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1e308, -1e308, float("inf"), float("-inf"), *(2.0 ** k for k in range(-60, 60)), *(np.nextafter(2.0 ** k, 0) for k in range(-60, 60))]
    groups = {"wide": base + [-x for x in base[9:]], "near": (1 + np.arange(400) * 2.0 ** -52).tolist(), "ties": [0.1] * 300 + [0.2, 0.3], "normal": rng.normal(size=500).tolist(), "one": [7.0]}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("wide", None), ("wide", float("nan")), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups[None] = [3.0]
    for sorted_rows in (1 << 20, 5):
        monkeypatch.setattr(ranking, "SORTED_ROWS", sorted_rows)
        picks = {"lo": F.lit(0), "q": F.floor((F.col("n") - 1) * 0.25), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}
        got = {r["g"]: r for r in ranking.order_statistics(df, ["g"], "v", picks).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            v = sorted(v)
            n = len(v)
            assert (got[g]["n"], got[g]["lo"], got[g]["q"], got[g]["mid"], got[g]["hi"]) == (n, v[0], v[(n - 1) // 4], v[n // 2], v[-1]), g
    whole = ranking.order_statistics(df, [], "v", {"mid": F.floor(F.col("n") / 2)}).first()
    known = sorted(x for v in groups.values() for x in v)
    assert (whole["n"], whole["mid"]) == (len(known), known[len(known) // 2])
    assert ranking.order_statistics(df.limit(0), ["g"], "v", {"mid": F.lit(0)}).count() == 0


def test_order_statistics_write_no_values(spark):
    df = spark.range(20_000).select(F.rand(3).alias("v"))
    plan = ranking.exact_percentiles(df, [], "v", {"p": 0.5})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_patches_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 4)
    cells = {(r, c): [float(r), float(c), None if r == 6 else 1.0] for r in range(11) for c in range(9) if (r, c) != (3, 3)}
    cells[5, 5] = None
    table = spark.createDataFrame([("t", r, c, s, 0) for (r, c), s in cells.items()], "tile_id string, pixel_row long, pixel_col int, spectrum array<double>, extra int")
    centres = table.select("tile_id", "pixel_row", "pixel_col")
    got = H.patches(centres, table, "spectrum", 3, 5, -1.0)
    assert got.dtypes[:3] == [("tile_id", "string"), ("pixel_row", "bigint"), ("pixel_col", "int")]
    rows = got.collect()
    assert {(r["pixel_row"], r["pixel_col"]) for r in rows} == set(cells) and len(rows) == len(cells)
    for r in rows:
        want = [cells.get((r["pixel_row"] + dr, r["pixel_col"] + dc)) or [-1.0] * 3 for dr in range(-2, 3) for dc in range(-2, 3)]
        assert r["patch"] == want
    assert H.patches(centres.limit(0), table, "spectrum", 3).count() == 0


def test_anchored_split_keeps_old_rows_and_leaks_nothing(spark):
    at = lambda tile, pid, lat, lon, split, n=4: [(tile, pid, lat, lon, pid * 100 + k, 0, split) for k in range(n)]
    rows = [*at("t", 1, 0.0, 0.0, "train"), *at("t", 2, 0.0, 0.1, None), *at("t", 3, 0.0, 0.3, None), *at("t", 4, 9.0, 0.0, "val"), *at("t", 5, 9.0, 0.2, None), *at("t", 6, 9.0, 0.4, "test")]
    rows += [x for k in range(40) for x in at("u", 100 + k, 20.0 + k, 0.0, None)]
    df = spark.createDataFrame(rows, "tile_id string, polygon_id long, lat double, lon double, pixel_row long, pixel_col long, split string").withColumn("lcp", F.lit(1.0))
    cents = df.groupBy("tile_id", "polygon_id").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    out = split.anchored_split(df.drop("lat", "lon"), cents, ["lcp"], 3).collect()
    got = {}
    for r in out:
        got.setdefault(r["polygon_id"], set()).add(r["split"])
    assert len(out) == len(rows) and all(len(s) == 1 and None not in s for s in got.values())
    assert [got[k] for k in range(1, 7)] == [{"train"}, {"train"}, {"train"}, {"val"}, {"unused"}, {"test"}]
    share = {s: sum(r["split"] == s for r in out) / (len(out) - 4) for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["val"] - 0.15) < 0.03 and abs(share["test"] - 0.15) < 0.03


def test_score_table_checks(spark, tmp_path):
    df = spark.createDataFrame([([0.1, 0.9],)], "probs array<double>")
    sinks.write_scores(df, f"{tmp_path}/s", ["a", "b"])
    assert scans.score_scan(spark, f"{tmp_path}/s", ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        scans.score_scan(spark, f"{tmp_path}/s", ["b", "a"])
    with pytest.raises(Exception, match="expected 3 channels"):
        sinks.write_scores(df, f"{tmp_path}/s3", ["a", "b", "c"])


def test_policies_need_provenance(spark):
    df = spark.createDataFrame([("High",)], "confidence_tier string")
    with pytest.raises(ValueError):
        C.review_grades(df, ["High"])
    with pytest.raises(ValueError):
        C.hand_policy(df, "some")
    with pytest.raises(ValueError):
        L.scheme_weight("confidence_tier", None, "other")


def test_drifted_attributes_fail(spark):
    a = spark.createDataFrame([(1, "t1")], "k int, tile string")
    b = spark.createDataFrame([(1, "t2", 5)], "k int, tile string, x int")
    with pytest.raises(Exception, match="drifted"):
        J.reattach(a, b, ["k"], ["tile"]).collect()


def test_category_check_fails_on_unknown(spark):
    df = spark.createDataFrame([("olivine (High)",), ("mystery (Low)",)], "Category string")
    assert df.where(L.unknown_token("Category")).count() == 1
    with pytest.raises(Exception, match="unparseable"):
        L.assert_categories(df).collect()


def test_threshold_names(spark):
    df = spark.createDataFrame([(0.5,), (0.999,), (0.9999,), (0.99995,)], "t double")
    assert [r[0] for r in df.select(keys.threshold_text("t")).collect()] == ["0.50", "0.999", "0.9999", "0.999950"]


def test_audit_flags_on_planted_defects(spark):
    base = [0.1 + 0.001 * i for i in range(59)]
    rows = {"tail": base[:-3] + [0.0] * 3, "run": base[:20] + [0.0] * 5 + base[25:], "zero": [0.0] * 59, "nodata": [65535.0] + base[1:], "nan": [float("nan")] + base[1:],
            "over": base[:5] + [1.5] + base[6:], "blue": [1.5] + base[1:], "flat": [0.2] * 59, "good": base}
    df = spark.createDataFrame(list(rows.items()), "id string, s array<double>")
    got = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in M.audit_flags("s").items()]).collect()}
    hit = lambda i: {n for n in M.AUDIT_FAIL + M.AUDIT_INFO if got[i][n]}
    assert hit("good") == set() and hit("tail") == {"zero_tail"} and hit("run") == {"zero_run"} and hit("nan") == {"nonfinite"}
    assert hit("over") == {"over_phys"} and hit("blue") == {"blue_edge"} and hit("flat") == {"flat"}
    assert hit("nodata") == {"nodata", "blue_edge"} and hit("zero") == {"zero_tail", "zero_run", "all_zero", "flat"}


def test_large_sample_equals_a_plain_top_n(spark):
    df = spark.range(9000).select("id", (F.col("id") % 5).alias("x"))
    want = {r["id"] for r in df.orderBy(keys.hash_text(3, "id"), "id").limit(2500).collect()}
    assert {r["id"] for r in sampling.subsample(df, ["id"], 2500, 3).collect()} == want
    assert sampling.subsample(df, ["id"], 20_000, 3).count() == 9000


def test_latest_merge_is_idempotent(spark, tmp_path):
    from bandweave.streaming.ledger import merge_latest
    write = merge_latest(f"{tmp_path}/t", ["ts"])
    rows = lambda *r: spark.createDataFrame(r, "polygon_uid string, ts int, decision string")
    write(rows(("a", 1, "confirm"), ("b", 5, "reject")), 0)
    for batch in (1, 1):
        write(rows(("a", 3, "skip"), ("b", 2, "confirm")), batch)
    got = {(r["polygon_uid"], r["ts"], r["decision"]) for r in log.read(spark, f"{tmp_path}/t", ["polygon_uid"], ["ts"]).collect()}
    assert got == {("a", 3, "skip"), ("b", 5, "reject")}


def test_nearest_bands_take_the_first_on_a_tie():
    assert J.nearest_bands([1.0, 2.5], [0.5, 1.5, 3.0]) == [(0, 0, 0.5), (1, 2, 0.5)]


def test_thinning_keeps_the_greedy_set(spark):
    from bandweave.functions.keys import hash_text
    grid = spark.range(1600).select(F.lit("t").alias("tile_id"), F.floor(F.col("id") / 40).alias("pixel_row"), (F.col("id") % 40).alias("pixel_col"))
    walk = grid.orderBy(hash_text(3, "tile_id", "pixel_row", "pixel_col"), "pixel_row", "pixel_col").collect()
    kept = []
    for p in walk:
        if all((p[1] - r) ** 2 + (p[2] - c) ** 2 >= 25 for r, c in kept):
            kept.append((p[1], p[2]))
    got = sampling.thin(grid, "tile_id", "pixel_row", "pixel_col", 5, 1000, 3).collect()
    assert sorted((r["pixel_row"], r["pixel_col"]) for r in got) == sorted(kept)
    assert sampling.thin(grid.limit(0), "tile_id", "pixel_row", "pixel_col", 5, 10, 3).count() == 0


def test_rings_beyond_a_hundred_thousand_vertices(spark):
    ring = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(120_000 - 1)), lambda k: F.struct(
        F.cos(k * (2 * math.pi / 120_000)).alias("x"), F.sin(k * (2 * math.pi / 120_000)).alias("y"))).alias("ring"))
    assert abs(ring.select(geo.ring_area("ring")).first()[0] - math.pi) < 1e-6


def test_angles_skip_missing_bands_pairwise(spark):
    nan = float("nan")
    rows = [([1.0, nan, 3.0],), ([nan, nan, 3.0],), ([0.0, 0.0, 0.0],), ([2.0, 4.0, 6.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<double>").select(S.angles_to("s", [[1.0, 2.0, 3.0], [1.0, nan, 0.0]])).collect()]
    assert abs(got[0][0]) < 1e-5 and abs(got[0][1] - math.degrees(math.acos(1 / math.sqrt(10)))) < 1e-6
    assert got[1] == [None, None] and got[2][0] == 90.0 and abs(got[3][0]) < 1e-5


@pytest.mark.parametrize("edges_a_step", [1 << 21, 1])
def test_components_of_awkward_graphs(spark, monkeypatch, edges_a_step):
    monkeypatch.setattr(graph, "EDGES_A_STEP", edges_a_step)
    n = 300
    chain = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(n)]
    star = [("s0000", f"s{k:04d}") for k in range(1, n)]
    rng = random.Random(4)
    pairs = [(f"r{rng.randrange(200):04d}", f"r{rng.randrange(200):04d}") for _ in range(150)]
    edges = chain + star + pairs + [("x", "x"), ("a", "b"), ("b", "a"), ("a", "b")]
    names = sorted({v for e in edges for v in e} | {"alone"})
    root = {v: v for v in names}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    vertices = spark.createDataFrame([(v,) for v in names], "id string")
    got = graph.connected_components(vertices, spark.createDataFrame(edges, "src string, dst string").repartition(7))
    assert {r["id"]: r["component"] for r in got.collect()} == {v: find(v) for v in names}


def test_dense_cells_are_not_compared_point_by_point(spark, monkeypatch):
    seen = []
    original = graph._spot_pairs
    monkeypatch.setattr(graph, "_spot_pairs", lambda small, *rest: seen.append([(level, p.agg(F.sum(F.col("as") * F.col("bs"))).first()[0] or 0) for level, p in small]) or original(small, *rest))
    side, _ = graph._grid(0.25)
    spread = lambda seed: F.rand(seed) * side * 0.9
    a = spark.range(50_000).select("id", (spread(1)).alias("lat"), (spread(2)).alias("lon"))
    for gap, linked in ((0.2, True), (0.31, False)):
        b = spark.range(50_000, 100_000).select("id", (spread(3)).alias("lat"), (F.lit(gap) + spread(4)).alias("lon"))
        points = a.unionByName(b)
        comp = graph.connected_components(points, graph.distance_links(points, "id", 0.25))
        assert comp.select("component").distinct().count() == (1 if linked else 2)
    assert sum(n for some in seen for _, n in some) < 50_000 ** 2 / 50
    small_a, small_b = a.limit(3000).withColumn("g", F.lit("g")), b.limit(3000).withColumn("g", F.lit("g")).withColumn("lon", F.col("lon") - 0.08)
    monkeypatch.setattr(graph, "FEW", 64)
    x, y = small_a.select("lat", "lon").toPandas().to_numpy(), small_b.select("lat", "lon").toPandas().to_numpy()
    d = (x[:, None, 0] - y[None, :, 0]) ** 2 + ((x[:, None, 1] - y[None, :, 1]) * np.cos(np.radians((x[:, None, 0] + y[None, :, 0]) / 2))) ** 2
    want = int((d <= 0.0625).sum())
    assert 0 < want < d.size and graph.close_pair_counts(small_a, small_b, "g", 0.25).first()["pairs"] == want


# ------------------------------------------------------------------------ scenes

def test_polygon_pixels_of_repeated_and_hollow_rings(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    rows = [(1, ring(square(0, 3))), (1, ring(square(0, 3))), (2, ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (1, 3), (3, 3), (3, 1), (1, 1)])), (3, ring([(0, 0), (5, 5)])), (4, None)]
    got = {}
    for r in geo.polygon_pixels(spark.createDataFrame(rows, "pid int, ring array<struct<x: double, y: double>>")).collect():
        got.setdefault(r["pid"], []).append((r["pixel_row"], r["pixel_col"]))
    assert sorted(got[1]) == sorted([(r, c) for r in range(3) for c in range(3)] * 2)
    assert sorted(got[2]) == sorted((r, c) for r in range(4) for c in range(4) if not (1 <= r < 3 and 1 <= c < 3)) and set(got) == {1, 2}
    assert tuple(spark.createDataFrame([(ring([(0, 0), (4, 0), (4, 2), (0, 2)]),)], "ring array<struct<x: double, y: double>>").select(geo.ring_centroid("ring").alias("c")).first()["c"]) == (2.0, 1.0)


def test_harvested_points_use_up_places(spark):
    from bandweave.operators import harvest
    cells = [("T1", r, c, [0.2, 0.9]) for r in range(4) for c in range(4)]
    cells[5] = ("T1", 1, 1, [0.1, 65535.0])
    cells[6] = ("T1", 1, 2, None)
    table = spark.createDataFrame(cells, "tile_id string, pixel_row long, pixel_col long, spectrum array<double>")
    listed = spark.createDataFrame([(1, "t1", 0, 0), (2, "T1", 1, 1), (3, "t1", 1, 2), (4, "t1", 9, 9), (5, "t9", 0, 0), (6, "t1", 0, 0)], "k int, tile_id string, pixel_row long, pixel_col long")
    got = {r["k"]: r["patch"] for r in harvest.harvest_points(listed, table, "spectrum", 2, ["k"], None, 1, 3).collect()}
    assert set(got) == {1, 6} and got[1] == got[6] == [[0.0, 0.0]] * 4 + [[0.2, 0.5]] * 2 + [[0.0, 0.0], [0.2, 0.5], [0.1, 0.0]]
    few = harvest.harvest_points(listed, table, "spectrum", 2, ["k"], 2, 1, 3).collect()
    order = [r["k"] for r in listed.where("lower(tile_id) = 't1'").orderBy(keys.hash_text(1, "k"), "k").collect()][:2]
    assert {r["k"] for r in few} == set(order) & {1, 6}


def test_colours_and_stretch(spark):
    df = spark.createDataFrame([("b", 0, 0, 0.1, 0.1, 0.9, 0.9, True), ("a", 0, 1, 0.1, 0.1, 0.1, None, True), ("a", 0, 2, 0.2, 0.2, 0.9, 0.9, False), ("b", 0, 3, 5.0, 5.0, 0.9, 0.9, False)],
                               "tile_id string, pixel_row int, pixel_col int, x double, y double, u double, v double, ok boolean")
    rgb = H.class_colours(df, {"u": "u", "v": "v"}, {"u": 0.5, "v": 0.5}, {"u": (0.8, 0.0, 0.1), "v": (0.7, 0.2, 0.0)}, "ok")
    got = [(r["rgb"], r["passed"]) for r in rgb.orderBy("pixel_col").collect()]
    assert got == [([1.0, 0.2, 0.1], ["u", "v"]), ([1.0, 1.0, 1.0], []), (None, []), (None, [])]
    cells = {(r["cell_row"], r["cell_col"]): (r["rgb"], r["covered"]) for r in H.class_mosaic(rgb, "x", "y", "tile_id", (0.0, 1.0), 1.0).collect()}
    assert cells == {(0, 0): ([1.0, 1.0, 1.0], True), (-4, 5): ([0.85] * 3, False)}
    stats = {r["tile_id"]: (r["n_valid"], r["u"], r["unclassified"]) for r in H.colour_statistics(rgb, ["u", "v"], "ok").collect()}
    assert stats == {"a": (1, 0, 1), "b": (1, 1, 0)}
    m = {(r["cell_row"], r["cell_col"]): (r["u"], r["v"], r["covered"]) for r in H.stretched_mosaic(df, "x", "y", "tile_id", ["u", "v"], (0.0, 1.0), 1.0).collect()}
    assert m[0, 0][2] and m[0, 0][0] == 0.0 and m[0, 0][1] == 0.0 and m[-4, 5][0] == 1.0


def test_grid_prediction_leaves_nodata_out(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 2.0), (3, float("nan"), -3.0), (4, 65535.0, 1.0), (5, 2.0, 5.0)], "k int, a double, b double")
    train = spark.createDataFrame([(x / 10, x / 10 - 2, float((x > 20) != (x % 7 == 0)), 0.0) for x in range(40)], "a double, b double, hot double, none double")
    models = fitting.fit_classes(train, ["a", "b"], ["none", "hot"], "logistic", 1)
    got = {r["k"]: (r["p_none"], r["p_hot"], r["best_class"]) for r in fitting.predict_grid(df, models, ["a", "b"]).collect()}
    assert got[4] == (0.0, 0.0, -1) and all(got[k][0] == 0.0 and got[k][1] > 0 and got[k][2] == 1 for k in (1, 2, 3, 5)) and got[5][1] > 0.5 > got[3][1]


def test_band_map_takes_the_first_band_on_a_tie(spark):
    df = spark.createDataFrame([("o", 0, 0.5), ("o", 1, 1.5), ("o", 2, 3.0), ("o", 3, None)], "o string, band int, wl double")
    assert [(r["target"], r["band"], r["residual"]) for r in J.band_map(df, ["o"], "band", "wl", [1.0, 2.5]).orderBy("target").collect()] == [(0, 0, 0.5), (1, 2, 0.5)]


def test_odd_numbers_read_as_by_a_cast(spark):
    odd = ["1", "-2.5", "+.5", "1e3", "1d", "2F", "0x1p3", "nan", "NaN", "NAN", "-NaN", "\x01nan", "inf", "-Infinity", "Infinity", "none", "nano", "i", "junk", "", "-", ".", "\x011", "1,", "١", None]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", L.read_number(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [] and got.where("a is not null").count() == 16


def test_slots_are_parsed_once(spark, sf_dir):
    from bandweave.plans import catalog
    assert catalog.QUERIES["parse_slots_text"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    row = spark.createDataFrame([("[1, nan, x, NaN, 2 5]", "1 2 x 3"), (None, None)], "a string, b string").select(L.parse_slots("a").alias("a"), L.parse_numbers("b", 3).alias("b"), L.parse_numbers("b").alias("c"))
    assert [tuple(r) for r in row.collect()] == [([1.0, None, None, 25.0], [1.0, 2.0, 3.0], None), (None, None, None)]


def test_kinds_share_their_preparation(spark):
    train = spark.createDataFrame([(x / 10 if x % 9 else None, x / 10 - 2, float((x > 20) != (x % 7 == 0)), 0.0) for x in range(40)], "a double, b double, hot double, none double")
    models = fitting.fit_kinds(train, ["a", "b"], ["hot", "none"], {"forest": {"trees": 3, "depth": 2}, "boosted": {"rounds": 2, "depth": 2}}, 1)
    assert models["forest"]["hot"].stages[0] is models["boosted"]["hot"].stages[0] and models["forest"]["none"] is None
    both = fitting.predict_classes(train, {"f": models["forest"]["hot"], "n": None, "b": models["boosted"]["hot"]})
    assert both.columns == [*train.columns, "p_f", "p_n", "p_b"]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("a__f") == fitting.predict_classes(train, {"f": models["forest"]["hot"]})._jdf.queryExecution().optimizedPlan().toString().count("a__f")
    for kind, name in (("forest", "p_f"), ("boosted", "p_b")):
        alone = fitting.fit_classes(train, ["a", "b"], ["hot"], kind, 1, **({"trees": 3, "depth": 2} if kind == "forest" else {"rounds": 2, "depth": 2}))
        key = lambda r: (r["b"],)
        assert [r["p_hot"] for r in sorted(fitting.predict_classes(train, alone).collect(), key=key)] == [r[name] for r in sorted(both.collect(), key=key)]


def test_average_precision_reads_its_rows_once(spark):
    rows = spark.range(40).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' WHEN id < 39 THEN 'b' END AS class", "CAST(id % 5 = 0 AND id % 2 = 0 AS DOUBLE) AS y", "(id % 8) / 8e0 AS score")
    got = evaluate.average_precision(rows, ["class"])
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["class"]: (round(r["ap"], 9), r["n_pos"], r["n"]) for r in got.collect()} == {"a": (0.2, 4, 20), "b": (0.0, 0, 19), None: (0.0, 0, 1)}


def test_fits_leave_no_rows_behind(spark):
    train = spark.createDataFrame([(x / 10, float(x > 20), 1.0 + x % 2) for x in range(40)], "a double, hot double, w double")
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    for weight in (None, "w", "hot"):
        models = fitting.fit_kinds(train, ["a"], ["hot"], {"logistic": {"max_iter": 3}, "boosted": {"rounds": 2}}, 1, weight)
        assert models["boosted"]["hot"] is not None and models["logistic"]["hot"] is not None
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_cells_of_one_component_visit_no_block(spark, monkeypatch):
    met = []
    original = graph._with_bounds
    monkeypatch.setattr(graph, "_with_bounds", lambda pairs, *rest: met.append(cut_lineage(pairs)) or original(met[-1], *rest))
    points = spark.range(6000).selectExpr("id", "(id % 60) * 0.05 AS lat", "CAST(id / 60 AS INT) * 0.05 AS lon")
    links = graph.distance_links(points, "id", 0.25)
    assert [r["component"] for r in graph.connected_components(points, links).select("component").distinct().collect()] == [0]
    occupied = graph._cells(points, *graph._grid(0.25)).selectExpr("i >> 16 AS i", "j >> 16 AS j").distinct().count()
    assert met[0].count() <= 4 * occupied and met[1].count() == 0


def test_only_labels_of_mined_tiles_are_compared(spark, monkeypatch):
    from bandweave.operators import mining
    seen = []
    original = mining.suppress
    monkeypatch.setattr(mining, "suppress", lambda df, touched: seen.append({r["tile_id"] for r in touched.collect()}) or original(df, touched))
    base = spark.createDataFrame([(f"t{k % 5}", k % 3, k, 0, 0.5, float(k % 2), "High", 0.5, "train") for k in range(20)],
                                 "tile_id string, polygon_id long, pixel_row long, pixel_col long, band_00 double, other double, confidence_tier string, confidence_weight double, split string")
    mined = spark.createDataFrame([("t1", 1, 0, 0.1), ("t1", 99, 0, 0.2), ("t9", 2, 0, 0.3)], "tile_id string, pixel_row long, pixel_col long, band_00 double")
    out = mining.merge_negatives(base, mined, "other")
    new = out.where("split IS NULL").select("tile_id", "pixel_row", "polygon_id").collect()
    assert seen == [{"t1"}] and out.count() == 22 and sorted(map(tuple, new)) == [("t1", 99, 3), ("t9", 2, 4)]


def test_equal_polygon_means_follow_the_given_order_of_rows(spark):
    polygons = spark.createDataFrame([(k, ["a"]) for k in range(7)], "polygon_id long, minerals array<string>")
    orders, rows, want = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1]], [], {6: "b"}
    for k in range(6):
        values = [[[0.2, p], [p, 0.2]][k // 3] for p in orders[k % 3]]
        rows += [(k, p, 10 * k + at) for at, p in enumerate(values)]
        a, b = ((p[0][i] + p[1][i] + p[2][i]) / 3 for p in [values] for i in (0, 1))
        want[k] = "a" if a >= b else "b"
    rows.append((6, [0.1, 0.3], 0))
    assert {want[k] for k in range(6)} == {"a", "b"}
    random.Random(2).shuffle(rows)
    scores = spark.createDataFrame(rows, "polygon_id long, probs array<double>, row long").repartition(5)
    out = evaluate.polygon_report(polygons, scores, "polygon_id", ["a", "b"], "probs", "minerals", ["row"])
    assert {r["polygon_id"]: r["predicted_class"] for r in out.collect()} == want
