"""Block labels on the demonstration grid, embeddings, attention, hashing, images."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.functions import rules
from gridframe.model import CELLS, Grid
from gridframe.operators import aggregates as agg, blocks as blk, embed as emb, image as img
from tests.fields import bumpy_field


@pytest.fixture(scope="module")
def demo(spark):
    return bumpy_field(spark)


@pytest.fixture(scope="module")
def demo_blocks(demo):
    from gridframe.session import cut_lineage

    return cut_lineage(blk.generate_blocks(demo))


def stack_of(grid):
    out = np.full(grid.shape, np.nan)
    for r in grid.cells.collect():
        out[r["t"], r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    return out


def test_demo_labels(demo_blocks):
    by_place = {(r["row"], r["col"]): r for r in demo_blocks.collect()}
    assert len(by_place) >= 120
    hot, cold = by_place[int(0.32 * 9), int(0.72 * 14)], by_place[int(0.68 * 9), int(0.28 * 14)]
    assert hot["scores"]["H"] > 0.8 and cold["scores"]["L"] > 0.8
    assert {r["primary_label"] for r in by_place.values()} <= set(rules.PATTERNS)
    for r in by_place.values():
        assert all(0 <= s <= 1 for s in r["scores"].asDict().values()) and 0 <= r["finite_ratio"] <= 1
        assert r["primary_label"] not in r["secondary_labels"] and len(r["secondary_labels"]) <= 2
        assert r["evidence"] and r["saliency"] == max(r["scores"][k] for k in "HLGBD")


def test_demo_features_against_numpy(demo, demo_blocks):
    stack = stack_of(demo)
    last, ok = stack[-1], ~np.isnan(stack[-1])
    filled = np.where(ok, last, np.nanmean(last))
    gy, gx = np.gradient(filled)
    g = np.hypot(gx, gy)
    span, g95 = np.nanmax(last) - np.nanmin(last), np.percentile(g[ok], 95)
    ey, ex = np.linspace(0, 72, 10, dtype=int), np.linspace(0, 112, 15, dtype=int)
    for r in demo_blocks.collect():
        part = np.s_[ey[r["row"]]: ey[r["row"] + 1], ex[r["col"]]: ex[r["col"] + 1]]
        v, s = last[part][ok[part]], g[part][ok[part]]
        assert np.isclose(r["std"], v.std()) and np.isclose(r["q25"], np.percentile(v, 25)) and np.isclose(r["edge_strength"], np.percentile(s, 90))
        assert abs(r["std_norm"] - v.std() / span) < 6e-5 and abs(r["gradient_mean_norm"] - s.mean() / g95) < 6e-5
        series = [np.nanmean(f[part]) for f in stack]
        assert abs(r["volatility"] - np.std(series)) < 2e-6


def test_block_counts_and_matrices(demo, demo_blocks):
    from gridframe.sources.sinks import to_matrix

    counts = {r["label"]: r["n"] for r in blk.block_labels(demo_blocks).collect()}
    assert sum(counts.values()) == demo_blocks.count() and set(counts) == set(rules.PATTERNS)
    matrix = to_matrix(demo_blocks, "confidence", 9, 14).first()["matrix"]
    assert len(matrix) == 9 and all(len(row) == 14 for row in matrix)
    assert blk.top_blocks(demo_blocks).count() == 12


def test_label_rules_directly(spark):
    base = {c: 0.0 for c in (
        "std_norm", "gradient_mean_norm", "edge_strength_norm", "hotspot_ratio", "lowspot_ratio", "largest_component_ratio", "missing_ratio", "outlier_ratio",
        "peak_prominence_norm", "low_prominence_norm")}
    cases = {
        "U": {}, "N": {"missing_ratio": 0.4, "std_norm": 0.5}, "H": {"std_norm": 0.5, "hotspot_ratio": 0.6, "largest_component_ratio": 0.5, "peak_prominence_norm": 0.4, "components_high": 1, "components_low": 9},
        "B": {"std_norm": 0.5, "edge_strength_norm": 0.9, "components_high": 9, "components_low": 9, "largest_component_ratio": 0.9},
        "M": {"std_norm": 0.5, "components_high": 1, "components_low": 1},
    }
    rows = [{**base, "components_high": 0, "components_low": 0, **c, "k": k} for k, c in cases.items()]
    df = spark.createDataFrame([{k: (float(v) if not isinstance(v, (int, str)) else v) for k, v in r.items()} for r in rows])
    done = {r["k"]: r for r in blk.choose_label(blk.label_scores(df)).collect()}
    assert {k: r["primary_label"] for k, r in done.items()} == {k: k for k in cases}
    assert done["U"]["confidence"] == 1.0


def test_svd_embedding(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[3, 2] = np.nan
    x[:, 5] = 2.0
    rows = [("g", i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "grid_id string, i int, features array<double>").repartition(5)
    got = np.array([r["embedding"] for r in emb.svd_embed(df, 8).orderBy("i").collect()])
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    sd = filled.std(axis=0)
    z = (filled - filled.mean(axis=0)) / np.where(sd > 0, sd, 1)
    want = z @ np.linalg.svd(z, full_matrices=False)[2].T
    assert np.allclose(np.abs(got[:, :5]), np.abs(want[:, :5]), atol=1e-8) and np.allclose(got[:, 5:], 0, atol=1e-6)


def test_attention_properties(spark, demo):
    encoded = emb.encode(demo, (12, 16)).collect()
    assert len(encoded) == 42
    vectors = np.array([r["vector"] for r in encoded])
    assert np.allclose(vectors.mean(axis=1), 0, atol=1e-9) and np.allclose(vectors.std(axis=1), 1, atol=1e-6)
    assert np.isclose(sum(r["incoming"] for r in encoded), 1.0)
    for c in ("visual", "centrality", "energy", "saliency"):
        values = [r[c] for r in encoded]
        assert min(values) == 0.0 and max(values) == 1.0


def test_attention_against_plain_loops(spark):
    """One grid of four patches, recomputed token by token."""
    rng = np.random.default_rng(8)
    f = rng.normal(size=(4, 8))
    centres = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    rows = [("g", i // 2, i % 2, f[i].tolist(), *centres[i]) for i in range(4)]
    df = spark.createDataFrame(rows, "grid_id string, py int, px int, features array<double>, center_y double, center_x double")
    got = np.array([r["vector"] for r in emb.attend(df, 8, 2).orderBy("py", "px").collect()])
    norm = lambda v: (v - v.mean()) / max(v.std(), 1e-6)
    z = (f - f.mean(axis=0)) / f.std(axis=0)
    tokens = []
    for i in range(4):
        pos = []
        for c in centres[i]:
            for k in range(2):
                angle = c * math.exp(-2 * k * math.log(10000.0) / 4) * 2 * math.pi
                pos += [math.sin(angle), math.cos(angle)]
        tokens.append(norm(z[i] @ emb.fixed_weights(8, 8, "feature_projection") / math.sqrt(8) + np.array(pos)))
    mixed = np.zeros((4, 8))
    for h in range(2):
        part = slice(h * 4, h * 4 + 4)
        q, k, v = ([t @ emb.fixed_weights(8, 8, n)[:, part] for t in tokens] for n in ("wq", "wk", "wv"))
        for i in range(4):
            w = np.exp([q[i] @ k[j] / 2 for j in range(4)])
            mixed[i, part] = sum(w[j] / w.sum() * v[j] for j in range(4))
    want = [norm(tokens[i] + mixed[i] @ emb.fixed_weights(8, 8, "wo") / math.sqrt(8)) for i in range(4)]
    assert np.allclose(got, want)


def test_attention_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, i // 5, i % 5, rng.normal(size=6).tolist(), i // 5 / 2, i % 5 / 4) for g, n in (("a", 15), ("b", 10), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "grid_id string, py int, px int, features array<double>, center_y double, center_x double")

    def results():
        done = emb.attend(df, 9, 2)
        vectors = [(r["grid_id"], r["token_id"], [*r["vector"], r["incoming"]]) for r in done.orderBy("grid_id", "token_id").collect()]
        edges = [sorted(map(tuple, emb.attention_edges(done, n).select("grid_id", "source", "target", F.round("attention", 9)).collect())) for n in (None, 7)]
        return vectors, edges

    whole, all_edges = results()
    monkeypatch.setattr(emb, "BLOCK", 4)
    parts, edges = results()
    assert [r[:2] for r in whole] == [r[:2] for r in parts] and np.allclose([r[2] for r in whole], [r[2] for r in parts])
    assert edges == all_edges and len(edges[0]) == 15 * 14 + 10 * 9 and len(edges[1]) == 14


def test_many_small_grids_are_encoded_without_a_table_between(spark, monkeypatch):
    rng = np.random.default_rng(12)
    sizes = {"a": (2, 5, 6), "b": (2, 4, 3), "c": (1, 1, 1), "d": (2, 5, 6), "e": (2, 5, 6)}
    rows = [(k, t, var, y, x, None if rng.random() < 0.3 or k == "d" and y < 2 else float(rng.normal())) for k, (n_t, n_y, n_x) in sizes.items() for t in range(n_t) for var in "pq" for y in range(n_y) for x in range(n_x)]
    rows += rows[:7] + [(None, *r[1:]) for r in rows[:20]]
    dims = spark.createDataFrame([(k, *n) for k, n in sizes.items()], "grid_id string, n_t int, n_y int, n_x int")
    g = Grid(spark.createDataFrame(rows, CELLS).repartition(5), ("p", "q"), (2, 5, 6), dims=dims)
    cuts, cut = [], emb.cut_lineage
    monkeypatch.setattr(emb, "cut_lineage", lambda df: cuts.append(df) or cut(df))

    def results():
        done = emb.encode(g, (2, 3), 9, 2)
        edges = emb.attention_edges(done, 3).orderBy("grid_id", "rank").select("grid_id", "source", "target", "attention")
        return done, sorted(done.columns), done.orderBy(*emb.PATCH).collect(), edges.collect()

    whole, columns, got, edges = results()
    assert len(cuts) == 1  # that of the edges
    plan = emb.saliency_summary(whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(grid_id") <= 4
    monkeypatch.setattr(emb, "WHOLE", 0)
    _, other, want, other_edges = results()
    assert columns == other and len(got) == len(want) == 3 * 6 + 2 + 1 and {r["grid_id"] for r in got} == set(sizes)
    flat = lambda rows: [np.hstack([np.nan if r[c] is None else r[c] for c in columns if c != "grid_id"]).astype(float) for r in rows]
    assert all(np.allclose(a, b, atol=1e-9, equal_nan=True) for a, b in zip(flat(got), flat(want), strict=True))
    assert [r[:3] for r in edges] == [r[:3] for r in other_edges] and np.allclose([r[3] for r in edges], [r[3] for r in other_edges])


def test_patch_shape():
    assert emb.patch_shape(72, 112, (32, 32)) == (32, 32)
    assert emb.patch_shape(3000, 5000, (32, 32)) == (32, 32)
    h, w = emb.patch_shape(3000, 5000, (32, 32), rules.MAX_TOKENS)
    assert math.ceil(3000 / h) * math.ceil(5000 / w) <= 1.1 * 384


def test_text_hash_embedding(spark):
    texts = ["", "  A ", "wind field 风速", "aaaa", None, "wind"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["vector"] for r in emb.hash_embed(df, "text", 16).collect()}
    for i, text in enumerate(texts):
        clean, want = (text or "").lower().strip(), np.zeros(16)
        for gram in [clean[j: j + 2] for j in range(max(1, len(clean) - 1))] if clean else []:
            d = hashlib.sha256(gram.encode()).digest()
            want[int.from_bytes(d[:4], "big") % 16] += 1 if d[4] % 2 == 0 else -1
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))


def test_image_features(spark):
    rng = np.random.default_rng(6)
    rgb = rng.integers(0, 256, (9, 7, 3)).astype(float)
    rows = [("g", 0, n, int(y), int(x), float(rgb[y, x, c])) for c, n in enumerate(("red", "green", "blue")) for y in range(9) for x in range(7)]
    g = Grid(spark.createDataFrame(rows, CELLS), ("red", "green", "blue"), (1, 9, 7), grid_type="image")
    r = img.image_features(g).first()
    light = rgb @ np.array(rules.LUMA)
    assert np.isclose(r["mean"], light.mean()) and r["counts"] == np.histogram(light, 16, (0, 255))[0].tolist()
    gy, gx = np.gradient(light)
    assert np.isclose(r["p95_edge_strength"], np.percentile(np.hypot(gx, gy), 95))
    rg, yb = rgb[..., 0] - rgb[..., 1], 0.5 * (rgb[..., 0] + rgb[..., 1]) - rgb[..., 2]
    assert np.isclose(r["colorfulness"], np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))
    assert r["texture_label"] == rules.TEXTURE_NAMES[2] and r["width"] == 7 and r["dominant_color"] in rules.HUE_NAMES


@pytest.mark.parametrize("mode", ["channel", "minmax", "clip", "spread", "symmetric"])
def test_scaling_bounds(grid_from, mode):
    a = np.random.default_rng(1).normal(size=(5, 6))
    a[0, 0] = np.nan
    g = grid_from(a)
    done = [r["v"] for r in img.scale_map(g, agg.mean_map(g), mode).collect() if r["v"] is not None]
    top = 255 if mode == "channel" else 1
    assert min(done) >= 0 and max(done) <= top and len(done) >= 29
    flat = grid_from(np.full((3, 3), 7.0))
    assert img.scale_map(flat, agg.mean_map(flat), mode).where(F.isnan("v")).count() == 0
