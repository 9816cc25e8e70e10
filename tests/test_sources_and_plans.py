"""Files in and out, request rules, composed analyses."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fields import bumpy_field
from gridframe.functions import rules
from gridframe.operators import missing as mis, requests as req, selection as sel
from gridframe.plans import analyze as plans
from gridframe.sources import arrays, catalog, images, sinks, tabular as tab


def values(grid, shape, var="value", grid_id=None):
    out = np.full(shape, np.nan)
    cells = grid.cells.where(F.col("var") == var)
    if grid_id:
        cells = cells.where(F.col("grid_id") == grid_id)
    for r in cells.collect():
        out[(r["t"], r["y"], r["x"])[-len(shape):]] = np.nan if r["v"] is None else r["v"]
    return out


def test_points_with_time(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Lon,Latitude,date,pm,name\n1,10,2020-01-01,5,a\n1,10,2020-01-01,7,a\n2,10,2020-01-02,1,b\n2,20,2020-01-01,,b\n")
    df = spark.read.option("header", True).option("inferSchema", True).csv(str(path))
    g = tab.rasterize(df)
    assert g.shape == (2, 2, 2) and g.variables == ("pm",)
    cells = {(r["t"], r["y"], r["x"]): r["v"] for r in g.cells.collect()}
    assert len(cells) == 8 and cells[0, 0, 0] == 6.0 and cells[1, 0, 1] == 1.0 and cells[0, 1, 1] is None


def test_points_without_time(spark):
    g = tab.rasterize(spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 2.0, float("nan"))], "x double, y double, v double"))
    assert g.shape == (1, 1, 2) and [r["v"] for r in g.cells.orderBy("x").collect()] == [3.0, None]
    assert g.time_axis().first()["label"] is None


def test_matrix_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,\n4,nan,6\n")
    (tmp_path / "b.csv").write_text("h1,h2,h3\n1,x,2\n3,y,4\n")
    g = tab.read_matrix_csv(spark, str(tmp_path))
    assert np.allclose(values(g, (2, 3), grid_id="a"), [[1, 2, np.nan], [4, np.nan, 6]], equal_nan=True)
    assert np.allclose(values(g, (2, 2), grid_id="b"), [[1, 2], [3, 4]])
    for name, body in {"c": [[1, None]], "d": {"data": [[1, 2], [3, 4]]}, "e": {"values": [[[1, 2]], [[3, 4]]]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    j = tab.read_matrix_json(spark, str(tmp_path))
    assert np.allclose(values(j, (2, 2), grid_id="d"), [[1, 2], [3, 4]]) and values(j, (2, 1, 2), grid_id="e")[1, 0, 1] == 4
    assert j.shape == (2, 2, 2)


def test_array_files(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    a[0, 0, 0], a[1, 1, 1] = np.nan, 1e35
    np.save(tmp_path / "s.npy", a)
    np.save(tmp_path / "q.npy", np.arange(16.0).reshape(1, 2, 2, 4))
    np.savez(tmp_path / "z.npz", lat=np.array([5.0, 6.0, 7.0]), longitude=np.arange(4.0), **{"my var": np.moveaxis(np.nan_to_num(a), 0, 2)})
    g = arrays.read_arrays(spark, str(tmp_path))
    want = np.where(np.isnan(a) | (a > 1e30), np.nan, a)
    assert np.allclose(values(g, a.shape, grid_id="s"), want, equal_nan=True)
    assert set(g.variables) == {"value", "var_0", "var_1", "my_var"}
    assert values(g, (2, 3, 4), "my_var", "z")[1, 2, 3] == 23.0
    axes = arrays.array_axes(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {(r["axis"], r["value"]) for r in axes if r["axis"] == "lat"} == {("lat", 5.0), ("lat", 6.0), ("lat", 7.0)}
    at = {(r["grid_id"], r["y"], r["x"]): (r["lat"], r["lon"]) for r in g.with_coords(g.cells.where("t = 0").select("grid_id", "y", "x").distinct()).collect()}
    assert at["z", 2, 3] == (7.0, 3.0) and at["s", 2, 3] == (2.0, 3.0) and len(at) == 12 + 8 + 12
    assert g.shape == (2, 3, 4) and {tuple(r) for r in g.dims_table().collect()} == {("s", 2, 3, 4), ("q", 1, 2, 4), ("z", 2, 3, 4)}


def test_array_times_and_meshes(spark, tmp_path):
    lat, lon = np.meshgrid([40.0, 41.0], [7.0, 8.0, 9.0], indexing="ij")
    days = np.array(["2024-03-01", "2024-03-02"], "datetime64[D]")
    np.savez(tmp_path / "m.npz", lat=lat, lon=lon, time=days, v=np.arange(12.0).reshape(2, 2, 3))
    np.savez(tmp_path / "n.npz", time=np.array([6, 12, 18]), v=np.ones((3, 2, 2)))
    g = arrays.read_arrays(spark, str(tmp_path))
    steps = {(r["grid_id"], r["t"]): (r["ts"] is not None, r["label"]) for r in g.time_axis().collect()}
    assert steps == {("m", 0): (True, "2024-03-01"), ("m", 1): (True, "2024-03-02"), ("n", 0): (False, "6"), ("n", 1): (False, "12"), ("n", 2): (False, "18")}
    placed = {(r["lat"], r["lon"], r["v"]) for r in g.with_coords(g.cells.where("grid_id = 'm' AND t = 1")).collect()}
    assert placed == {(40.0 + i // 3, 7.0 + i % 3, 6.0 + i) for i in range(6)}


def test_small_arrays_are_handed_on_together():
    import io

    import pyarrow as pa

    from gridframe.sources import arrays

    def file(values, **axes):
        out = io.BytesIO()
        np.savez(out, **axes, level=values)
        return out.getvalue()

    big = np.arange(300 * 300.0).reshape(1, 300, 300)
    files = [file(np.full((2, 2, 3), float(i)), lat=[i, i + 1], time=["a", "b"]) for i in range(40)] + [file(big), file(np.array([[[np.nan, 1e300, 2.0]]]))]
    made = list(arrays._cells(iter([pa.RecordBatch.from_pydict({"path": [f"/x/{i}.npz" for i in range(42)], "content": files})])))
    assert len(made) == 2 and sum(b.num_rows for b in made) == 40 * 12 + 300 * 300 + 3
    rows = pa.Table.from_batches(made).to_pylist()
    assert rows[12 * 7 + 11] == {"grid_id": "7", "t": 1, "var": "level", "y": 1, "x": 2, "v": 7.0}
    assert [r["v"] for r in rows[480:-3]] == big.ravel().tolist() and [r["v"] for r in rows[-3:]] == [None, None, 2.0]


def test_array_axes_are_told_apart():
    assert arrays.axis_letters((5, 6), 0, 0, 0) == "yx" and arrays.axis_letters((9, 5, 6), 5, 6, 0) == "tyx"
    assert arrays.axis_letters((5, 6, 9), 5, 6, 0) == "yxt" and arrays.axis_letters((9, 2, 3), 5, 6, 9) == "tyx"
    with pytest.raises(ValueError):
        arrays.axis_letters((7, 8, 9), 5, 6, 0)


def png(pixels, kind):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgb, gray = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8), rng.integers(0, 256, (2, 4), dtype=np.uint8)
    (tmp_path / "c.png").write_bytes(png(rgb, 2))
    (tmp_path / "g.png").write_bytes(png(gray, 0))
    g = images.read_images(spark, str(tmp_path))
    assert np.allclose(values(g, (3, 5), "green", "c"), rgb[..., 1]) and np.allclose(values(g, (2, 4), "intensity", "g"), gray)
    assert np.allclose(values(g, (3, 5), "intensity", "c"), rgb @ np.array(rules.LUMA))
    assert g.shape == (1, 3, 5)


def test_series_of_files(spark, tmp_path):
    for day, v in (("20200102", 2.0), ("20200101", 1.0), ("20200104", 4.0)):
        (tmp_path / f"pm_{day}.csv").write_text(f"5.0,6.0,{v}\n5.0,7.0,\n")
    (tmp_path / "pm_20200103.csv").write_text("")
    g = tab.read_series(spark, str(tmp_path), "lat double, lon double, pm double", "csv", "*.csv")
    assert g.shape == (4, 1, 2) and g.variables == ("pm",)
    assert {r["t"]: r["label"] for r in g.time_axis().collect()} == {0: "2020-01-01", 1: "2020-01-02", 2: "2020-01-03", 3: "2020-01-04"}
    assert np.allclose(values(g, (4, 1, 2), "pm")[:, 0], [[1, np.nan], [2, np.nan], [np.nan, np.nan], [4, np.nan]], equal_nan=True)


def test_series_of_files_with_times_of_their_own(spark, tmp_path):
    (tmp_path / "b.csv").write_text("lat,lon,time,pm\n1,1,2021-03-01 06:00:00,1\n1,1,2021-03-01 18:00:00,2\n")
    (tmp_path / "a.csv").write_text("lat,lon,time,pm\n1,2,2021-03-02,3\n")
    (tmp_path / "c_2021-03-09.csv").write_text("lat,lon,time,pm\n")
    g = tab.read_series(spark, str(tmp_path), None, "csv", "*.csv", header=True, inferSchema=True)
    assert {r["t"]: r["label"] for r in g.time_axis().collect()} == {0: "2021-03-02", 1: "2021-03-01T06:00:00", 2: "2021-03-01T18:00:00", 3: "2021-03-09"}
    assert np.allclose(values(g, (4, 1, 2), "pm")[:, 0], [[np.nan, 3], [1, np.nan], [2, np.nan], [np.nan, np.nan]], equal_nan=True)


def test_series_of_array_files(spark, tmp_path):
    draw = np.random.default_rng(3)
    a, b, c = draw.normal(size=(2, 3, 4)), draw.normal(size=(3, 4)), draw.normal(size=(3, 4, 2))
    lat, lon = np.array([10.0, 11, 12]), np.array([1.0, 2, 3, 4])
    np.savez(tmp_path / "d_20200101.npz", lat=lat, lon=lon, time=np.array(["2020-01-01T06", "2020-01-01T12"], "datetime64[h]"), pm=a, wind=-a)
    np.savez_compressed(tmp_path / "d_20200102.npz", pm=b)
    (tmp_path / "d_20200103.npz").write_bytes(b"")
    np.savez(tmp_path / "d_20200104.npz", lat=lat, lon=lon, time=np.array(["x", "y"]), pm=np.asfortranarray(c))
    g = tab.read_series(spark, str(tmp_path), format="arrays")
    assert g.shape == (6, 3, 4) and g.variables == ("pm", "wind")
    assert [r["label"] for r in g.time_axis().orderBy("t").collect()] == ["2020-01-01", "2020-01-01", "2020-01-02", "2020-01-03", "x", "y"]
    gap = np.full((1, 3, 4), np.nan)
    assert np.allclose(values(g, (6, 3, 4), "pm"), np.concatenate([a, b[None], gap, np.moveaxis(c, 2, 0)]), equal_nan=True)
    assert np.allclose(values(g, (6, 3, 4), "wind"), np.concatenate([-a, gap, gap, gap, gap]), equal_nan=True)
    assert [r["lat"] for r in g.lat_axis().orderBy("y").collect()] == lat.tolist() and g.cells.count() == 144
    np.save(tmp_path / "e.npy", np.zeros((5, 5)))
    with pytest.raises(ValueError, match="another size"):
        tab.read_series(spark, str(tmp_path), format="arrays")


def test_strips_of_large_maps(spark, tmp_path, monkeypatch):
    from gridframe.sources import series

    monkeypatch.setattr(series, "STRIP", 8)
    monkeypatch.setattr(series, "CELLS_PER_PARTITION", 24)
    a = np.random.default_rng(4).normal(size=(3, 2, 7, 4)).astype(">f4")
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", var_0=a[0, 0], var_1=np.full((7, 4), 1e35))
    g = tab.read_series(spark, str(tmp_path), format="arrays")
    assert g.shape == (4, 7, 4) and g.variables == ("var_0", "var_1")
    assert np.allclose(values(g, (4, 7, 4), "var_0"), np.concatenate([a[:, 0], a[:1, 0]]))
    assert np.allclose(values(g, (4, 7, 4), "var_1"), np.concatenate([a[:, 1], np.full((1, 7, 4), np.nan)]), equal_nan=True)


def test_filters_open_only_the_members_asked_for(spark, tmp_path):
    for i in range(4):
        np.savez(tmp_path / f"{i}.npz", pm=np.full((2, 2), i), wind=np.zeros((2, 2)))
    cells = tab.read_series(spark, str(tmp_path), format="arrays").cells
    for i in (0, 1, 3):
        (tmp_path / f"{i}.npz").write_bytes(b"no longer there")
    rows = cells.where("t = 2 AND var = 'pm'").collect()
    assert [r["v"] for r in rows] == [2.0] * 4
    assert [r["v"] for r in cells.where("t > 1 AND t <= 2 AND var IN ('wind')").collect()] == [0.0] * 4
    with pytest.raises(Exception, match="zip"):
        cells.where("t = 1").collect()


def test_lines_of_a_file_of_many_splits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("".join(f"{i},{i * 2},{'' if i % 7 else i}\n" for i in range(500)) + "\n \n")
    (tmp_path / "h.csv").write_text("a,b\n1,2\n\n3,4")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = tab.numbered_lines(spark, str(tmp_path), "*.csv")
        assert lines.rdd.getNumPartitions() > 10
        found = {(r["grid_id"], r["line"]): r["txt"] for r in lines.collect()}
        assert len(found) == 504 and all(found["m", i].split(",")[0] == str(i) for i in range(500)) and found["h", 2] == ""
        g = tab.read_matrix_csv(spark, str(tmp_path))
        assert g.shape[1:] == (500, 3)
        assert np.allclose(values(g, (500, 3), grid_id="m")[:, 1], np.arange(500) * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.unset("spark.sql.files.openCostInBytes")


GOOD = {"a": "[[1, null], [3, NaN]]", "b": '{"note": "x]y\\"", "values": [[9]], "data": null, "grid": [[[1]], [[2.5e0]]]}'}
BAD = {
    "cut": "[[1, 2], [3, 4", "key": '{"rows": [[1]]}', "ragged": "[[1, 2], [3]]", "word": '[["a"]]', "flat": "[1, 2]", "empty": "", "none": "null", "deep": "[[[1], [2]], [[1]]]",
    "half": '{"data": [[1], [2]', "number": "[[1], 2]",
}


def test_json_matrices_that_are_none_are_named(spark, tmp_path):
    for name, text in {**GOOD, **BAD}.items():
        (tmp_path / f"{name}.json").write_text(text)
    errors = {r["grid_id"]: r["error"] for r in tab.read_json_errors(spark, str(tmp_path)).collect()}
    assert set(errors) == set(BAD) and "data, grid or values" in errors["key"] and "ends" in errors["cut"]
    g = tab.read_matrix_json(spark, str(tmp_path), skip_unreadable=True)
    assert g.shape == (2, 2, 2) and {r["grid_id"] for r in g.cells.select("grid_id").distinct().collect()} == set(GOOD)
    assert values(g, (2, 1, 1), grid_id="b").ravel().tolist() == [1.0, 2.5]
    with pytest.raises(Exception, match="no matrix in"):
        tab.read_matrix_json(spark, str(tmp_path))


def test_points_snapped_to_a_cell_size(spark):
    draw = np.random.default_rng(8)
    lat, lon, v = draw.uniform(10, 12, 300), draw.uniform(-1, 1, 300), draw.normal(size=300)
    df = spark.createDataFrame(list(zip(lat.tolist(), lon.tolist(), v.tolist())), "lat double, lon double, v double")
    g = tab.rasterize(df, step=(0.5, 0.25))
    assert g.shape == (1, 5, 9)
    want = {}
    for a, o, x in zip(np.floor(lat / 0.5 + 0.5) * 0.5, np.floor(lon / 0.25 + 0.5) * 0.25, v):
        want.setdefault((a, o), []).append(x)
    got = {(r["lat"], r["lon"]): r["v"] for r in g.with_coords(g.cells).collect() if r["v"] is not None}
    assert set(got) == set(want) and all(np.isclose(got[k], np.mean(want[k])) for k in want)
    with pytest.raises(ValueError, match="1 steps x 300 rows x 300 columns"):
        tab.rasterize(df, most_cells=1000)


def test_grids_of_points_keep_their_own_axes(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 1.0), ("a", 3.0, 5.0, 2.0), ("b", 2.0, 6.0, 3.0), ("b", 2.0, 8.0, 4.0), ("b", 2.0, 9.0, None)], "grid_id string, lat double, lon double, v double")
    g = tab.rasterize(df)
    assert {(r["grid_id"], r["n_y"], r["n_x"]) for r in g.dims_table().collect()} == {("a", 2, 1), ("b", 1, 3)}
    assert {(r["grid_id"], r["y"], r["x"], r["v"]) for r in g.cells.collect()} == {("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("b", 0, 0, 3.0), ("b", 0, 1, 4.0), ("b", 0, 2, None)}


def test_cells_round_trip(spark, grid_from, tmp_path):
    a = np.random.default_rng(2).normal(size=(2, 4, 3))
    a[0, 0, 0] = np.nan
    g = mis.fill(grid_from(a))
    out = str(tmp_path / "cells")
    sinks.write_cells(g, out, mis.missing_masks(grid_from(a)))
    back = tab.read_cells(spark, out)
    assert back.where("v is null").count() == 0 and back.count() == 24
    flagged = spark.read.parquet(out).where("orig_missing and filled").count()
    assert flagged == 1
    plan = back.where("var = 'v' and t = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(t), EqualTo(t,1)]" in plan
    sinks.write_results(back.limit(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_catalog_and_fingerprint(spark, grid_from, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.bin").write_bytes(b"x" * (k + 1))
    files = catalog.file_table(spark, str(tmp_path))
    row = catalog.catalog(grid_from(np.ones((2, 3)), units={"v": "K"}), files).first()
    parts = row["fingerprint"].split("-")
    assert row["file_count"] == 3 and parts[0] == "3" and parts[2:] == ["1", "3"] and row["variables"][0]["unit"] == "K"


def test_request_rules(spark):
    cases = [
        ("对比今天和昨天", "comparison"), ("近7天的变化", "trend_analysis"), ("扩散轨迹变化", "source_tracing"), ("污染来源", "source_tracing"), ("聚类", "clustering"),
        ("异常", "anomaly_detection"), ("图像边缘", "distribution"), ("影响因素", "attribution"), ("地图", "distribution"), ("hello", "summary"),
    ]
    df = spark.createDataFrame(cases, "q string, want string")
    assert df.where(req.tag_task(F.col("q")) != F.col("want")).count() == 0
    one = lambda text, c: spark.createDataFrame([(text,)], "q string").select(c.alias("c")).first()["c"]
    q = F.col("q")
    assert one("热点区", req.tag_region(q)) == rules.DEFAULT_REGION and one("看杭州市", req.tag_region(q)) == "看杭州市"
    assert one("Temperature 和 风速", req.tag_variables(q)) == ["temp", "wind"] and one("x", req.tag_variables(q)) == ["PM2.5"]
    assert one("近 3 天", req.tag_time(q)) == "近3天" and one("x", req.tag_time(q)) == rules.DEFAULT_TIME_RANGE
    assert one("in 2024年3月5日", sel.text_date(q)) == "2024-03-05" and one("v20240131x", sel.text_date(q)) == "2024-01-31"


@pytest.mark.parametrize("text, task", [
    ('{"task_graph": {"task_type": "clustering"}}', "clustering"), ('```json\n{"task_graph": {"task_type": "summary"}}\n```', "summary"),
    ('so: {"task_graph": {"task_type": "comparison"}} ok', "comparison"), ("no json", None), ("[1]", None), ("{bad", None),
])
def test_replies(spark, text, task):
    row = req.parse_replies(spark.createDataFrame([(text,)], "r string"), "r").first()
    assert (row["reply"] and row["reply"]["task_graph"]["task_type"]) == task


def test_analysis_of_bumpy_field(spark):
    g = bumpy_field(spark, 36, 56, 5)
    tables = plans.analyze(g, region="box", boxes=(("box", 5.0, 50.0, 2.0, 30.0),))
    for name, df in tables.items():
        assert df.columns, name
    assert tables["quality"].first()["region_cells"] == 46 * 29
    assert tables["hotspots"].count() >= 1 and tables["similar_slices"].count() == 4
    assert tables["trend"].first()["direction"] == "increase" and tables["facts"].count() == 1
    assert tables["blocks"].count() == tables["block_labels"].agg(F.sum("n")).first()[0]
    for task in rules.TASK_TYPES:
        assert all(df.columns for df in plans.analyze(g, task=task).values())


def test_task_analysis_keeps_to_valid_cells_and_single_steps(spark, grid_from):
    a = np.arange(24, dtype=float).reshape(2, 4, 3)
    a[:, 1, 2] = np.nan
    g = grid_from(a)
    masks = mis.missing_masks(g)
    valid = plans.analyze(mis.fill(g), task="clustering", mask=masks)["mean_map"]
    assert [(r["y"], r["x"]) for r in valid.where("v is null").collect()] == [(1, 2)]
    assert "difference_map" in plans.analyze(g, task="comparison")
    one = grid_from(a[:1])
    for task, names in (("comparison", ["mean_map", "hotspot_mask"]), ("source_tracing", ["mean_map", "hotspot_mask", "hotspot_cells"])):
        tables = plans.analyze(one, task=task)
        assert list(tables) == names and tables["mean_map"].count() == 12


def test_reply_fields_are_merged(spark):
    reply = '{"visualization_strategy": {"color_encoding": "", "focus_region": "north"}, "follow_up_questions": ["b", "a", ""]}'
    none = F.lit(None).cast("string")
    plan = spark.createDataFrame([(reply, ["a"]), ("no reply", None)], "r string, follow_up_questions array<string>").withColumns(
        {c: none for c in ("task_type", "region", "time_range", "chart_type", "layout", "color_encoding", "focus_region")}
    ).withColumns({c: F.lit(None).cast("array<string>") for c in ("variables", "uncertainty_risks")})
    rows = req.merge_plans(req.with_defaults(req.parse_replies(plan, "r"))).collect()
    assert rows[0]["focus_region"] == "north" and rows[0]["color_encoding"] == rows[1]["color_encoding"] == "sequential color scale"
    assert rows[0]["follow_up_questions"] == ["a", "b"] and rows[1]["follow_up_questions"] == []


def test_fields_without_a_column_survive(spark):
    reply = '{"analysis_plan": {"a": [], "b": [1, {"c": null}], "d": 0}, "task_graph": {"task_type": "clustering", "depth": {"x": 1.5}}, "visualization_strategy": 7, "semantic_response": "yes"}'
    none = F.lit(None).cast("string")
    plan = spark.createDataFrame([(reply,), ("no reply",), ('{"analysis_plan": "text"}',)], "r string").withColumns(
        {c: none for c in ("task_type", "region", "time_range", "chart_type", "layout", "color_encoding", "focus_region")}
    ).withColumns({c: F.lit(None).cast("array<string>") for c in ("variables", "uncertainty_risks")})
    base = F.from_json(F.lit('{"a": ["kept"], "d": "old"}'), "map<string,variant>")
    done = req.merge_plans(req.with_defaults(req.parse_replies(plan, "r")).withColumn("analysis_plan", base))
    rows = done.select("task_type", "semantic_response", *[F.to_json(c).alias(c) for c in ("analysis_plan", "more_task_graph", "more_visualization_strategy")]).collect()
    first = json.loads(rows[0]["analysis_plan"])
    assert first == {"a": ["kept"], "b": [1, {"c": None}], "d": 0} and json.loads(rows[0]["more_task_graph"]) == {"depth": {"x": 1.5}}
    assert rows[0]["task_type"] == "clustering" and rows[0]["semantic_response"] == "yes" and rows[0]["more_visualization_strategy"] == "{}"
    for r in rows[1:]:
        assert json.loads(r["analysis_plan"]) == {"a": ["kept"], "d": "old"} and r["more_task_graph"] == "{}" and r["semantic_response"] is None


def test_long_edges_make_few_rows(spark):
    edges = spark.createDataFrame([(0.0, 60.0), (10.2, 10.3), (-5.0, -5.0), (-0.001, 0.001), (-90.0, 90.0)], "a double, b double")
    placed, levels = sel.banded(edges, F.col("a"), F.col("b"))
    assert placed.groupBy("a").count().agg(F.max("count")).first()[0] <= 3 and len(levels) == 5
    met = sel.in_bands(spark.createDataFrame([(10.25,), (59.9,), (0.0,)], "p double"), F.col("p"), levels).join(placed, ["level", "band"]).where("p BETWEEN a AND b")
    assert {(r["p"], r["a"]) for r in met.collect()} == {(10.25, 0.0), (10.25, 10.2), (10.25, -90.0), (59.9, 0.0), (59.9, -90.0), (0.0, 0.0), (0.0, -0.001), (0.0, -90.0)}


def test_limits_of_an_analysis_are_arguments(spark):
    g = bumpy_field(spark, 18, 20, 6)
    whole, few = plans.analyze(g), plans.analyze(g, display_points=5, hotspot_rows=1)
    assert whole["mean_display"].count() == 360 and few["mean_display"].count() == 25
    assert few["hotspots"].count() == 1 <= whole["hotspots"].count()


def test_single_steps_beside_longer_grids(spark, grid_from):
    from gridframe.model import Grid

    a = np.arange(24, dtype=float).reshape(2, 4, 3)
    two, one = grid_from(a, grid_id="two"), grid_from(a[:1], grid_id="one")
    dims = spark.createDataFrame([("two", 2, 4, 3), ("one", 1, 4, 3)], "grid_id string, n_t int, n_y int, n_x int")
    tables = plans.analyze(Grid(two.cells.unionByName(one.cells), ("v",), (2, 4, 3), dims=dims, n_grids=2), task="comparison")
    assert {r["grid_id"] for r in tables["difference_map"].collect()} == {"two"} and tables["mean_map"].count() == 24


def test_feature_bundle(spark):
    g = bumpy_field(spark, 18, 20, 6)
    tables = plans.extract_features(g, block=(6, 5), dim=4)
    facts = tables["facts"].first()
    assert facts["n_t"] == 6 and facts["coverage"] and facts["hotspot_count"] == tables["hotspots"].count() and facts["saliency_p95"] > 0
    assert tables["change_points"].columns[-2:] == ["ts", "label"]
    assert tables["statistics"].first()["missing_ratio"] > 0
    assert tables["block_embedding"].count() == 12 and len(tables["block_embedding"].first()["embedding"]) == 4
    assert tables["saliency_summary"].first()["max"] == 1.0 and tables["labels"].count() == 1
    described = plans.describe(g)
    assert described["missing"].first()["filled_count"] > 0 and described["spec"].first()["n_lat"] == 18
    assert plans.flags(tables["spatial"], tables["statistics"], 1, False).first()["risks"][-1] == "single_time_step"
