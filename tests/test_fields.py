"""Stencils, filling, regions and quantiles against small numpy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.model import MAP
from gridframe.operators import aggregates as agg, missing as mis, regions as reg, selection as sel, stencil as st, temporal as tem
from gridframe.operators.quantile import _bracketed, group_quantiles

RNG = np.random.default_rng(7)


def gappy(shape, share=0.3, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape) * 10
    a[rng.random(shape) < share] = np.nan
    return a


def map_of(grid):
    return grid.cells.where("t = 0").select(*MAP, "y", "x", "v")


def nearest(a):
    out = a.copy()
    ys, xs = np.where(~np.isnan(a))
    for y, x in zip(*np.where(np.isnan(a))):
        best = min(zip((ys - y) ** 2 + (xs - x) ** 2, ys, xs))
        out[y, x] = a[best[1], best[2]]
    return out


def test_row_sources_against_all_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for _ in range(200):
            sy, y = rng.integers(0, 9, n).astype(float), int(rng.integers(0, 9))
            sy[rng.random(n) < rng.random()] = np.nan
            if np.isnan(sy).all() or (sy == y).all():
                continue
            gaps, nearest = mis._row_sources((sy - y) ** 2, sy)
            there = np.flatnonzero(~np.isnan(sy))
            assert nearest == [min(there, key=lambda i: ((sy[i] - y) ** 2 + (i - x) ** 2, sy[i], i)) for x in gaps]


@pytest.mark.parametrize("width", [None, 9])
def test_nearest_fill_equals_brute_force(grid_from, as_map, width):
    a = gappy((70, 9), 0.9)
    g = grid_from(a)
    done = mis.fill_nearest(map_of(g), tuple(MAP), width=width)
    assert np.allclose(as_map(done, a.shape), nearest(a))
    assert done.where("filled").count() == int(np.isnan(a).sum())


def test_nearest_fill_of_empty_map(grid_from):
    g = grid_from(np.full((3, 4), np.nan))
    assert mis.fill_nearest(map_of(g), tuple(MAP)).where("v is not null").count() == 0
    assert [r["v"] for r in mis.fill_nearest(map_of(g), tuple(MAP), all_missing=0.0, width=4).collect()] == [0.0] * 12


def test_linear_fill(grid_from, as_map):
    a = np.array([[1.0, np.nan, 3.0, np.nan], [np.nan, np.nan, np.nan, np.nan], [5.0, 6.0, 7.0, 8.0]])
    done = mis.fill_linear(map_of(grid_from(a)), tuple(MAP), fallback=None)
    out = as_map(done, a.shape)
    assert out[0, 1] == 2.0 and out[1, 0] == 3.0 and np.isnan(out[0, 3])
    assert not np.isnan(as_map(mis.fill_linear(map_of(grid_from(a)), tuple(MAP)), a.shape)).any()


def test_gradient_equals_numpy(grid_from, as_map):
    a = RNG.normal(size=(6, 5))
    sloped = st.gradient(map_of(grid_from(a)))
    gy, gx = np.gradient(a)
    assert np.allclose(as_map(sloped, a.shape, "gx"), gx) and np.allclose(as_map(sloped, a.shape, "gy"), gy)


def box(a, n):
    h = n // 2
    index = lambda k, m: np.array([i if (i := j % (2 * m)) < m else 2 * m - 1 - i for j in k])
    out = np.zeros_like(a)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = a[np.ix_(index(range(y - h, y + n - h), a.shape[0]), index(range(x - h, x + n - h), a.shape[1]))].mean()
    return out


@pytest.mark.parametrize("shape", [(6, 7), (2, 3), (1, 5)])
def test_box_mean_with_mirrored_edges_even_on_short_axes(grid_from, as_map, shape):
    a = RNG.normal(size=shape)
    g = grid_from(a)
    done = st.box_mean(g.with_dims(map_of(g)), ["v"], 7, MAP)
    assert np.allclose(as_map(done, shape), box(a, 7))


def test_local_entropy(grid_from, as_map):
    a = RNG.normal(size=(6, 6))
    g = grid_from(a)
    level = np.clip(((a - a.min()) / (a.max() - a.min()) * 15).astype(int), 0, 15)
    want = np.zeros_like(a)
    for k in range(16):
        p = box((level == k).astype(float), 7)
        want -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
    assert np.allclose(as_map(st.local_entropy(g.with_dims(map_of(g)), "v", MAP), a.shape, "entropy"), want / 4)
    flat = grid_from(np.ones((3, 3)))
    assert (as_map(st.local_entropy(flat.with_dims(map_of(flat)), "v", MAP), (3, 3), "entropy") == 0).all()


def test_gaussian_series_with_gap_is_null(spark):
    rows = [("g", "v", t, float(t * t % 7)) for t in range(12)] + [("h", "v", t, None if t == 3 else 1.0) for t in range(12)]
    s = spark.createDataFrame(rows, "grid_id string, var string, t int, v double")
    done = {(r["grid_id"], r["t"]): r["smoothed"] for r in st.smooth_series(s).collect()}
    w = np.array(st.gaussian_weights(2.0))
    padded = np.pad([t * t % 7 for t in range(12)], 8, mode="symmetric")
    assert np.isclose(done["g", 0], (padded[0:17] * w).sum()) and np.isclose(done["g", 11], (padded[11:28] * w).sum())
    assert done["h", 0] is None


def moran(a):
    ok = ~np.isnan(a)
    z = a - np.nanmean(a)
    num = n = 0
    for p, q in ((z[:, :-1], z[:, 1:]), (z[:-1], z[1:])):
        both = ~np.isnan(p) & ~np.isnan(q)
        num += 2 * (p[both] * q[both]).sum()
        n += 2 * both.sum()
    return ok.sum() / n * num / np.nansum(z * z)


def test_moran(grid_from):
    a = gappy((8, 6)) + 1e6
    assert np.isclose(st.moran(map_of(grid_from(a))).first()["moran_i"], moran(a))
    assert st.moran(map_of(grid_from(np.ones((3, 3))))).first()["moran_i"] is None
    assert st.moran(map_of(grid_from([[1.0, np.nan], [2.0, 3.0]]))).first()["moran_i"] is None


def labels(mask):
    out = np.zeros(mask.shape, int) - 1
    for start in zip(*np.where(mask)):
        if out[start] >= 0:
            continue
        stack, name = [start], start[0] * mask.shape[1] + start[1]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and out[y, x] < 0:
                out[y, x] = name
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def snake(n):
    m = np.zeros((n, n), bool)
    m[::2] = True
    for k, y in enumerate(range(1, n, 2)):
        m[y, -1 if k % 2 == 0 else 0] = True
    return m


@pytest.mark.parametrize("tile", [256, 5])
@pytest.mark.parametrize("mask", [snake(17), np.random.default_rng(3).random((20, 23)) < 0.55, np.ones((11, 11), bool)])
def test_components_equal_flood_fill(grid_from, as_map, mask, tile):
    g = grid_from(np.where(mask, 1.0, np.nan))
    cells = map_of(g).where("v is not null")
    done = as_map(reg.components(cells, MAP, g.shape, tile=tile), mask.shape, "component")
    assert (np.where(np.isnan(done), -1, done).astype(int) == labels(mask)).all()


@pytest.mark.parametrize("tile", [64, 4])
def test_components_keep_barriers_and_layers_apart(grid_from, tile):
    g = grid_from(np.ones((6, 8)))
    cells = map_of(g).withColumn("part", F.floor(F.col("x") / 3)).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    done = reg.components(cells, MAP, g.shape, tile=tile, layer="kind", barrier="part")
    sizes = {tuple(r) for r in done.groupBy("kind", "part", "component").count().collect()}
    assert sizes == {(k, p, p * 3, 18 if p < 2 else 12) for k in (0, 1) for p in (0, 1, 2)}


def test_mask_boundary(grid_from, as_map):
    mask = np.random.default_rng(5).random((7, 8)) < 0.5
    g = grid_from(mask.astype(float))
    done = st.mask_boundary(map_of(g).withColumn("m", F.col("v") > 0), "m")
    p = np.pad(mask, 1)
    around = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    want = np.any(around, axis=0) ^ np.all(around, axis=0)
    assert (as_map(done.withColumn("b", F.col("boundary").cast("double")), mask.shape, "b") == want).all()


@pytest.mark.parametrize("accuracy", [20, 200])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {"many": rng.normal(size=3000), "ties": rng.integers(0, 4, 2500).astype(float), "few": np.array([3.0, 1.0]), "one": np.array([5.0]), "hot": np.r_[np.zeros(2000), 9.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    done = {r["k"]: r for r in _bracketed(df, ["k"], "v", probs, accuracy).collect()}
    plain = {r["k"]: r for r in group_quantiles(df, ["k"], "v", probs, 10).collect()}
    for k, vs in groups.items():
        for name, p in probs.items():
            assert np.isclose(done[k][name], np.quantile(vs, p)) and np.isclose(plain[k][name], np.quantile(vs, p))
    assert done["none"]["c"] is None and plain["none"]["c"] is None


def test_trend_map_and_cell_maps(grid_from, as_map):
    a = gappy((5, 4, 3))
    g = grid_from(a)
    x = np.arange(5) - 2.0
    want = (x[:, None, None] * np.nan_to_num(a - np.nanmean(a, axis=0))).sum(axis=0) / (x * x).sum()
    assert np.allclose(as_map(tem.trend_map(g), a.shape[1:]), want)
    assert (as_map(tem.trend_map(grid_from(a[0])), a.shape[1:]) == 0).all()
    maps = tem.cell_maps(g)
    sd = np.nanstd(a, axis=0)
    z = np.where(sd > 1e-9, (a[-1] - np.nanmean(a, axis=0)) / np.where(sd > 1e-9, sd, 1), 0)
    assert np.allclose(as_map(maps, z.shape, "z"), z, equal_nan=True)


def test_periodicity_and_trend_edge_cases(spark, grid_from):
    wave = np.sin(np.arange(60) * 2 * np.pi / 7)[:, None, None] + np.zeros((60, 2, 2))
    g = grid_from(wave)
    r = tem.periodicity(g, agg.series_mean(g)).first()
    assert r["lag"] == 7 and r["periodicity"] == "lag_7_steps"
    flat = grid_from(np.ones((8, 2, 2)))
    series = agg.series_mean(flat)
    assert tem.periodicity(flat, series).first()["periodicity"] == "insufficient_data"
    assert tem.classify_trend(series).first()["trend"] == "stable" and tem.linear_trend(series).first()["r2"] == 0.0
    assert tem.change_points(series).count() == 0
    single = agg.series_mean(grid_from(np.ones((2, 2))))
    assert tem.classify_trend(single).first()["trend"] == "single_time_step" and tem.linear_trend(single).first()["slope"] == 0.0
    empty = grid_from(np.full((3, 2, 2), np.nan))
    assert tem.classify_trend(agg.series_mean(empty)).first()["trend"] == "no_data"
    assert tem.periodicity(empty, agg.series_mean(empty)).first()["periodicity"] == "unknown"


def test_spatial_features_of_empty_and_thin_maps(grid_from):
    empty = reg.spatial_features(grid_from(np.full((3, 4), np.nan))).first()
    assert empty["hotspot_count"] == 0 and empty["gradient_strength"] is None and empty["connected_domains"] == 0
    assert reg.spatial_features(grid_from(np.arange(5.0)[None])).first()["hotspot_count"] == 1


def test_constant_correlation_is_null(spark):
    from gridframe.model import CELLS, Grid

    rows = [("g", 0, v, 0, x, 1.0 if v == "a" else float(x)) for v in "ab" for x in range(5)]
    g = Grid(spark.createDataFrame(rows, CELLS), ("a", "b"), (1, 1, 5))
    r = {(x["left"], x["right"]): x["r"] for x in agg.correlation(g).collect()}
    assert r["a", "b"] is None and np.isclose(r["b", "b"], 1.0)


def test_selection_rules(spark, grid_from):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "Longitude double, lat_deg double, v int")
    assert set(sel.resolve_axes(df).columns) == {"lon", "lat", "v"}
    with pytest.raises(ValueError):
        sel.resolve_axes(spark.createDataFrame([(1,)], "value int"))
    g = grid_from(np.ones((2, 2)))
    with pytest.raises(ValueError):
        sel.select_vars(g, ["nope"])
    assert sel.region_mask(g, "unknown").count() == 4
    assert sel.prepare(g, "v", "box", None, (("box", 5.0, 6.0, 5.0, 6.0),)).cells.where("v is not null").count() == 0


def test_grids_of_different_size(spark):
    """Operators read sizes per grid from the dims table."""
    from gridframe.model import CELLS, Grid
    from gridframe.operators import blocks as blk, embed as emb

    rows = [(f"g{k}", 0, "v", y, x, float(y * x % 5)) for k, (h, w) in enumerate([(4, 6), (10, 3)]) for y in range(h) for x in range(w)]
    dims = spark.createDataFrame([("g0", 1, 4, 6), ("g1", 1, 10, 3)], "grid_id string, n_t int, n_y int, n_x int")
    g = Grid(spark.createDataFrame(rows, CELLS), ("v",), (1, 10, 6), dims=dims)
    placed = blk.assign_blocks(g, g.cells, 2, 3)
    counts = {(r["grid_id"], r["row"], r["col"]): r["count"] for r in placed.groupBy("grid_id", "row", "col").count().collect()}
    assert counts["g0", 0, 0] == 4 and counts["g1", 1, 2] == 5 and len(counts) == 12
    assert emb.saliency_map(g, emb.encode(g, (2, 3)), (2, 3)).count() == 54


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 7, 9, 14])
def test_block_cuts_equal_linspace(spark, parts):
    from gridframe.operators.blocks import block_index

    sizes = [n for n in (14, 40, 50, 72, 97, 112, 353, 399, 613) if n >= parts]
    df = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    for r in df.select("n", "i", block_index(F.col("i"), F.col("n"), parts).alias("b")).collect():
        edges = np.linspace(0, r["n"], parts + 1, dtype=int)
        assert edges[r["b"]] <= r["i"] < edges[r["b"] + 1]


def test_grids_of_different_lengths_keep_their_own_axis(spark):
    from gridframe.model import CELLS, Grid

    rows = [(g, t, "v", 0, x, float(t * slope + x)) for g, n, slope in (("a", 3, 1), ("b", 6, 2)) for t in range(n) for x in range(2)]
    dims = spark.createDataFrame([("a", 3, 1, 2), ("b", 6, 1, 2)], "grid_id string, n_t int, n_y int, n_x int")
    g = Grid(spark.createDataFrame(rows, CELLS), ("v",), (6, 1, 2), dims=dims)
    assert {(r.grid_id, round(r.v, 9)) for r in tem.trend_map(g).collect()} == {("a", 1.0), ("b", 2.0)}
    assert {(r.grid_id, r.v) for r in tem.difference_map(g).collect()} == {("a", 2.0), ("b", 10.0)}
    assert {(r.grid_id, r.x, r.v) for r in tem.cell_maps(g).collect()} == {("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, 10.0), ("b", 1, 11.0)}


def test_all_change_points_are_counted(spark):
    values = [0.0] * 10
    for k in range(300):
        values.append(values[-1] + (50.0 if k % 20 == 19 else 0.1 if k % 2 else -0.1))
    series = spark.createDataFrame([("g", "v", t, v) for t, v in enumerate(values)], "grid_id string, var string, t int, v double")
    assert tem.change_points(series, n=None).count() == 15 and tem.change_points(series).count() == 10


def brute_box(a, n):
    h = n // 2
    padded = np.pad(a, ((h, n - 1 - h), (h, n - 1 - h)), "symmetric")
    return np.lib.stride_tricks.sliding_window_view(padded, (n, n))


@pytest.mark.parametrize("tile", [3, 4, 100])
@pytest.mark.parametrize("n", [4, 5])
def test_boxes_do_not_depend_on_tiles(grid_from, as_map, tile, n):
    a = RNG.normal(size=(10, 13)) + 1e4
    g = grid_from(a)
    sized = g.with_dims(map_of(g))
    assert np.allclose(as_map(st.box_mean(sized, ["v"], n, MAP, tile=tile), a.shape), brute_box(a, n).mean(axis=(2, 3)))
    assert np.allclose(as_map(st.local_std(sized, "v", n, MAP, tile=tile), a.shape, "local_std"), brute_box(a, n).std(axis=(2, 3)), atol=1e-7)


@pytest.mark.parametrize("tile,shape", [(3, None), (100, None), (100, (9, 8))])
def test_texture_by_tiles(grid_from, as_map, tile, shape):
    a = np.round(RNG.normal(size=(9, 8)), 2)
    g = grid_from(a)
    done = st.texture(g.with_dims(map_of(g)), "v", MAP, tile=tile, shape=shape)
    level = np.clip(np.floor((a - a.min()) / (a.max() - a.min()) * 15), 0, 15)
    boxes = brute_box(level, 7).reshape(9, 8, -1)
    want = np.zeros(a.shape)
    for k in range(16):
        p = (boxes == k).mean(axis=2)
        want -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0) / 4
    assert np.allclose(as_map(done, a.shape, "entropy"), want)
    assert np.allclose(as_map(done, a.shape, "local_std"), brute_box(a, 5).std(axis=(2, 3)))
    assert np.allclose(as_map(done, a.shape), a)


def test_boxes_take_one_exchange(grid_from):
    g = grid_from(RNG.normal(size=(9, 8)))
    plan = st.local_std(g.with_dims(g.cells.drop("t")), "v", 5, MAP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_moments_of_pairs_with_gaps(spark):
    from gridframe.model import CELLS, Grid
    from gridframe.operators import moments

    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 5)) * [1, 10, 1e-3, 1, 0] + [1e6, 0, 0, -5, 0.1]
    x[:, 3] += x[:, 1]
    x[draw.random(x.shape) < 0.3] = np.nan
    x[:, 4][~np.isnan(x[:, 4])] = 0.1
    names = tuple("abcde")
    rows = [(gid, i // 20, names[j], i // 5 % 4, i % 5, None if np.isnan(v) else float(v)) for gid in ("g", "h") for (i, j), v in np.ndenumerate(x)]
    rows += [("none", 0, n, 0, 0, None) for n in names]
    g = Grid(spark.createDataFrame(rows, CELLS).repartition(5), names, (3, 4, 5))
    got = {(r["grid_id"], r["left"], r["right"]): r for r in agg.relation_features(g).collect()}
    r = {(k["grid_id"], k["left"], k["right"]): k["r"] for k in agg.correlation(g).collect()}
    assert len(got) == 30 and len(r) == 75 and all(v is None for k, v in r.items() if k[0] == "none")
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            row = got["g", names[i], names[j]]
            assert row["f4"] == both.sum() and np.isclose(row["f1"], a.mean() / b.mean()) and np.isclose(row["f2"], np.abs(a - b).mean())
            assert np.isclose(row["f3"], (a - b).std(), rtol=1e-6)
            if j == 4:
                assert row["f0"] is None and r["g", "e", names[i]] is None
            else:
                assert np.isclose(row["f0"], np.corrcoef(a, b)[0, 1]) and r["h", names[j], names[i]] == r["h", names[i], names[j]]
    parts = [moments._block_moments(x[k::7], x[k::7], True) for k in range(7)]
    whole = parts[0]
    for p in parts[1:]:
        whole = moments._merged(whole, p)
    assert np.allclose(whole, moments._block_moments(x, x, True), rtol=1e-9, atol=1e-9)


def test_many_variables_keep_the_plan_small(spark):
    from gridframe.model import CELLS, Grid

    names = tuple(f"v{i:03d}" for i in range(300))
    rows = [("g", 0, n, 0, x, float((i * 7 + x * x * (i % 5 + 1)) % 11)) for i, n in enumerate(names) for x in range(12)]
    g = Grid(spark.createDataFrame(rows, CELLS), names, (1, 1, 12))
    r = {(k["left"], k["right"]): k["r"] for k in agg.correlation(g).collect()}
    v = np.array([[row[5] for row in rows[i * 12 : i * 12 + 12]] for i in range(300)])
    assert len(r) == 90_000 and np.isclose(r["v007", "v250"], np.corrcoef(v[7], v[250])[0, 1])


def test_a_long_series(spark):
    from gridframe.operators.temporal import _best_lag

    n = 1_000_000
    v = np.sin(np.arange(n) * 2 * np.pi / 365) + 1e-6 * np.arange(n) + 0.1 * np.random.default_rng(1).normal(size=n)
    spread, power, lag, strength = _best_lag(v, None)
    assert lag == 365 and 0.9 < strength < 1


def test_autocorrelation_by_transform():
    from gridframe.operators.temporal import _autocorrelation

    e = np.random.default_rng(2).normal(size=77)
    want = [(e[: 77 - k] * e[k:]).sum() / (e @ e) for k in range(77)]
    assert np.allclose(_autocorrelation(e), want)
