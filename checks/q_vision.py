"""Embeddings, patches, attention, text alignment, image features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.grids import E_VARS, SQL_E, SQL_I, SQL_L3, SQL_RGB, grid_e, grid_i, grid_l3, grid_rgb, rd, rounded, table
from checks.q_basics import BLOCK_ROWS, TIME_ROWS
from checks.q_fields import _mirror, box_sql
from checks.registry import MEAN, corr_sql, fill_sql, grad_sql, query
from gridframe.functions import rules
from gridframe.functions.columns import norm
from gridframe.operators import aggregates as agg, embed as emb, image as img

SHAPE = (3, 5)

# --- feature tables --------------------------------------------------------------------------------------------


@query("standardize_features", f"""
WITH {SQL_L3}, f AS (SELECT t, var, avg(v) AS a, max(v) AS b, CASE WHEN t % 5 <> 0 THEN min(v) END AS c FROM cells GROUP BY t, var),
l AS (SELECT t, 0 AS i, a AS f FROM f WHERE var = 'price' UNION ALL SELECT t, 1, b FROM f WHERE var = 'price' UNION ALL SELECT t, 2, c FROM f WHERE var = 'price'),
m AS (SELECT i, avg(f) AS m FROM l GROUP BY i), z AS (SELECT t, i, coalesce(f, m) - m AS d FROM l JOIN m USING (i)),
s AS (SELECT i, sqrt(avg(d * d)) AS s FROM z GROUP BY i)
SELECT 'L' AS grid_id, t, i, {rd('d / CASE WHEN s > 0 THEN s ELSE 1 END', 6, 'z')} FROM z JOIN s USING (i)""")
def standardize_features(spark, sf):
    g = grid_l3(spark, sf).one("price")
    rows = g.cells.groupBy("grid_id", "t").agg(F.array(F.avg("v"), F.max("v"), F.when(F.col("t") % 5 != 0, F.min("v"))).alias("features"))
    done = emb.standardize(rows)
    return rounded(done.select("grid_id", "t", F.posexplode("features").alias("i", "z")), 6)


@query("block_embedding")
def block_embedding(spark, sf):
    return emb.block_embedding(grid_e(spark, sf), SHAPE, 8)


@query("time_slice_embedding")
def time_slice_embedding(spark, sf):
    return emb.time_slice_embedding(grid_e(spark, sf), 8)


@query("relation_embedding")
def relation_embedding(spark, sf):
    return emb.relation_embedding(grid_l3(spark, sf), 8)


def _norms(keys: str) -> str:
    """Lengths of standardised vectors from lf(keys, i, f); an embedding of full dimension keeps them."""
    return f"""zf AS (SELECT {keys}, (coalesce(f, m) - m) AS d, i FROM lf JOIN (SELECT i, coalesce(avg(f), 0) AS m FROM lf GROUP BY i) USING (i)),
zs AS (SELECT i, sqrt(avg(d * d)) AS s FROM zf GROUP BY i) SELECT {keys}, {rd('sqrt(sum((d / CASE WHEN s > 0 THEN s ELSE 1 END) ** 2))', 5, 'length')} FROM zf JOIN zs USING (i) GROUP BY {keys}"""


_POS = "CASE var WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@query("block_embedding_lengths", f"""
{BLOCK_ROWS}, r AS (SELECT * FROM st JOIN gs USING (grid_id, block_y, block_x, var)),
lf AS (SELECT grid_id, block_y, block_x, {_POS} * 6 + unnest(range(6)) AS i, unnest([mean, std, min, max, missing_ratio, gradient]) AS f FROM r
  UNION ALL SELECT grid_id, block_y, block_x, 30 + unnest(range(4)), unnest([(y0 + y1 - 1) / 14.0::DOUBLE, (x0 + x1 - 1) / 30.0::DOUBLE, (y1 - y0) / 8.0::DOUBLE, (x1 - x0) / 16.0::DOUBLE]) FROM r WHERE var = 'click'), {_norms('grid_id, block_y, block_x')}""")
def block_embedding_lengths(spark, sf):
    done = emb.block_embedding(grid_e(spark, sf), SHAPE, 34)
    return rounded(done.select("grid_id", "block_y", "block_x", norm(F.col("embedding")).alias("length")), 5)


@query("time_slice_embedding_lengths", f"""
{TIME_ROWS}, r AS (SELECT grid_id, t, var, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max, avg(g) AS gradient FROM gr GROUP BY grid_id, t, var),
lf AS (SELECT grid_id, t, {_POS} * 5 + unnest(range(5)) AS i, unnest([mean, std, min, max, gradient]) AS f FROM r), {_norms('grid_id, t')}""")
def time_slice_embedding_lengths(spark, sf):
    done = emb.time_slice_embedding(grid_e(spark, sf), 25)
    return rounded(done.select("grid_id", "t", norm(F.col("embedding")).alias("length")), 5)


_PAIR_FEATURES = " UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", [{corr_sql(a, b)}, avg({a}) FILTER ({b} IS NOT NULL) / avg({b}) FILTER ({a} IS NOT NULL), avg(abs({a} - {b})), stddev_pop({a} - {b}), count({a} - {b})::DOUBLE] AS f FROM wide"""
    for a, b in (("price", "discount"), ("price", "tax"), ("discount", "tax"))
)


@query("relation_embedding_lengths", f"""
WITH {SQL_L3}, pf AS ({_PAIR_FEATURES}), lf AS (SELECT "left", "right", unnest(range(5)) AS i, unnest(f) AS f FROM pf), {_norms('"left", "right"')}""")
def relation_embedding_lengths(spark, sf):
    done = emb.relation_embedding(grid_l3(spark, sf), 8)
    return rounded(done.select("left", "right", norm(F.col("embedding")).alias("length")), 5)


_PATCHES = "pc AS (SELECT grid_id, y // 3 AS py, x // 5 AS px, t, var, y, x, v FROM cells), pm AS (SELECT grid_id, py, px, var, y, x, avg(v) AS v FROM pc GROUP BY ALL)"
_PKEYS = ("grid_id", "py", "px", "var")
_PGRAD = f"{fill_sql('pm', 'pf', _PKEYS, '0')}, {grad_sql('pf', 'pg', 'grid_id, py, px, var', 'f')}"


@query("patch_features", f"""
WITH {SQL_E}, {_PATCHES}, {_PGRAD},
g AS (SELECT grid_id, py, px, var, coalesce(avg(g) FILTER (v IS NOT NULL), 0) AS gradient FROM pg GROUP BY ALL),
s AS (SELECT grid_id, py, px, var, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max, coalesce(quantile_cont(v, 0.05), 0) AS p05,
  coalesce(quantile_cont(v, 0.95), 0) AS p95, CASE WHEN count(v) > 0 THEN avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) ELSE 0 END AS missing_ratio FROM pc GROUP BY ALL)
SELECT grid_id, py, px, var, {rd('mean')}, {rd('std')}, {rd('min')}, {rd('max')}, {rd('p05')}, {rd('p95')}, {rd('missing_ratio', 6)}, {rd('gradient')} FROM s JOIN g USING (grid_id, py, px, var)""")
def patch_features(spark, sf):
    return rounded(emb.patch_features(grid_e(spark, sf), SHAPE), missing_ratio=6)


_SUMMARY = f"""{_PATCHES}, {_PGRAD},
ps AS (SELECT grid_id, py, px, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS dynamic_range, coalesce(avg(g) FILTER (v IS NOT NULL), 0) AS gradient_strength, min(v) AS lo, max(v) AS hi
  FROM pg WHERE var = 'click' GROUP BY ALL),
ph AS (SELECT p.grid_id, p.py, p.px, least(floor((v - lo) / (hi - lo) * 32), 31) AS level, count(*) AS k FROM pm p JOIN ps s USING (grid_id, py, px) WHERE var = 'click' AND v IS NOT NULL AND hi > lo GROUP BY ALL),
pe AS (SELECT grid_id, py, px, sum(-(k / n) * log2(k / n)) / 5 AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY grid_id, py, px) AS n FROM ph) GROUP BY ALL),
pw AS (SELECT grid_id, py, px, y, x, max(v) FILTER (var = 'error') AS r, max(v) FILTER (var = 'purchase') AS g, max(v) FILTER (var = 'signup') AS b FROM pm GROUP BY ALL),
pk AS (SELECT grid_id, py, px, sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(avg(r - g) * avg(r - g) + avg(0.5 * (r + g) - b) * avg(0.5 * (r + g) - b)) AS colorfulness
  FROM pw WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
su AS (SELECT grid_id, py, px, mean, std, dynamic_range, gradient_strength, coalesce(entropy, 0) AS entropy, coalesce(colorfulness, 0) AS colorfulness FROM ps LEFT JOIN pe USING (grid_id, py, px) LEFT JOIN pk USING (grid_id, py, px))"""


@query("patch_summary", f"""
WITH {SQL_E}, {_SUMMARY} SELECT grid_id, py, px, {rd('mean')}, {rd('std')}, {rd('dynamic_range')}, {rd('gradient_strength')}, {rd('entropy', 6)}, {rd('colorfulness')} FROM su""")
def patch_summary(spark, sf):
    return rounded(emb.patch_summary(grid_e(spark, sf), SHAPE), entropy=6)


def _scale(c: str) -> str:
    return f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0)"


@query("saliency_parts", f"""
WITH {SQL_E}, {_SUMMARY},
n AS (SELECT *, {" + ".join(f"{w} * {_scale(f'coalesce({c}, 0)')}" for c, w in rules.VISUAL_WEIGHTS.items())} AS vis, abs(coalesce(mean, 0)) + coalesce(std, 0) + coalesce(dynamic_range, 0) + coalesce(gradient_strength, 0) AS en FROM su WINDOW w AS (PARTITION BY grid_id))
SELECT grid_id, py, px, {rd(_scale('vis'), 6, 'visual')}, {rd(_scale('en'), 6, 'energy')} FROM n WINDOW w AS (PARTITION BY grid_id)""")
def saliency_parts(spark, sf):
    done = emb.saliency_parts(emb.patch_tokens(grid_e(spark, sf), SHAPE))
    return rounded(done.select(*emb.PATCH, "visual", "energy"), 6)


@query("patch_sizes", f"""
WITH s AS (SELECT o_orderkey AS k, CAST(o_orderkey % 700 + 1 AS DOUBLE) AS ny, CAST(o_custkey % 900 + 1 AS DOUBLE) AS nx FROM orders),
c AS (SELECT *, ceil(ny / 8) * ceil(nx / 8) AS n FROM s), f AS (SELECT *, CASE WHEN n > 384 THEN sqrt(n / 384) ELSE 1 END AS grow FROM c)
SELECT CAST(k AS VARCHAR) AS grid_id, CAST(ceil(8 * grow) AS INT) AS ph, CAST(ceil(8 * grow) AS INT) AS pw FROM f""")
def patch_sizes(spark, sf):
    dims = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("grid_id"), F.lit(1).alias("n_t"), (F.col("o_orderkey") % 700 + 1).cast("int").alias("n_y"), (F.col("o_custkey") % 900 + 1).cast("int").alias("n_x")
    )
    g = grid_i(spark, sf).with_cells(dims, dims=dims)
    return emb.with_patches(g, dims.select("grid_id", F.lit(0).alias("y"), F.lit(0).alias("x")), (8, 8), rules.MAX_TOKENS).select("grid_id", "ph", "pw")


def _matrix(name: str, rows: int, cols: int) -> str:
    """A fixed weight matrix as a table (i, j, w)."""
    lists = ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in r) + "]" for r in emb.fixed_weights(rows, cols, name))
    return f"(SELECT i, unnest(range({cols})) AS j, unnest(r) AS w FROM (SELECT unnest(range({rows})) AS i, unnest([{lists}]) AS r))"


def attention_sql(variables: list[str], ny: int, nx: int, shape: tuple[int, int], dim: int = 32, heads: int = 4) -> str:
    """Encoded patches of many grids in SQL: needs ``cells``; gives en(grid_id, py, px, j, x), at(grid_id, h, a, b, w) and sa."""
    width, n = dim // heads, 8 * len(variables)
    pos = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(variables))
    feats = ["mean", "std", "min", "max", "p05", "p95", "missing_ratio", "gradient"]
    ln = lambda c: f"({c} - avg({c}) OVER t) / greatest(stddev_pop({c}) OVER t, 1e-6)"
    half = dim // 2
    project = lambda name: f"SELECT grid_id, py, px, m.j, sum(x * w) AS x FROM tk JOIN {_matrix(name, dim, dim)} m ON m.i = tk.j GROUP BY ALL"
    energy = "abs(coalesce(mean, 0)) + coalesce(std, 0) + coalesce(dynamic_range, 0) + coalesce(gradient_strength, 0)"
    visual = " + ".join(f"{w} * {_scale(f'coalesce({c}, 0)')}" for c, w in rules.VISUAL_WEIGHTS.items())
    return f"""
fg AS (SELECT grid_id, py, px, var, coalesce(avg(g) FILTER (v IS NOT NULL), 0) AS gradient FROM pg GROUP BY ALL),
fs AS (SELECT grid_id, py, px, var, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max, coalesce(quantile_cont(v, 0.05), 0) AS p05,
  coalesce(quantile_cont(v, 0.95), 0) AS p95, CASE WHEN count(v) > 0 THEN avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) ELSE 0 END AS missing_ratio FROM pc GROUP BY ALL),
lf AS (SELECT grid_id, py, px, CASE var {pos} END * 8 + unnest(range(8)) AS i, unnest([{", ".join(feats)}]) AS f FROM fs JOIN fg USING (grid_id, py, px, var)),
zf AS (SELECT grid_id, py, px, i, (f - avg(f) OVER w) / CASE WHEN stddev_pop(f) OVER w > 1e-12 THEN stddev_pop(f) OVER w ELSE 1 END AS z FROM lf WINDOW w AS (PARTITION BY grid_id, i)),
ct AS (SELECT grid_id, py, px, (min(y) + max(y)) / 2.0::DOUBLE / {ny - 1} AS cy, (min(x) + max(x)) / 2.0::DOUBLE / {nx - 1} AS cx FROM pm GROUP BY ALL),
pj AS (SELECT grid_id, py, px, m.j, sum(z * w) / sqrt({n}) AS x FROM zf JOIN {_matrix("feature_projection", n, dim)} m ON m.i = zf.i GROUP BY ALL),
pp AS (SELECT grid_id, py, px, j, x + CASE WHEN j % 2 = 0 THEN sin(ang) ELSE cos(ang) END AS x FROM (
  SELECT *, CASE WHEN j < {half} THEN cy ELSE cx END * exp(-((j % {half}) // 2) * 2 * ln(10000.0::DOUBLE) / {half}) * 2 * pi() AS ang FROM pj JOIN ct USING (grid_id, py, px))),
tk AS (SELECT grid_id, py, px, j, {ln('x')} AS x FROM pp WINDOW t AS (PARTITION BY grid_id, py, px)),
qq AS ({project('wq')}), kk AS ({project('wk')}), vv AS ({project('wv')}),
sc AS (SELECT q.grid_id, q.py AS ay, q.px AS ax, k.py AS by_, k.px AS bx, q.j // {width} AS h, sum(q.x * k.x) / sqrt({width}) AS s FROM qq q JOIN kk k ON q.grid_id = k.grid_id AND q.j = k.j GROUP BY ALL),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY grid_id, ay, ax, h)) AS e FROM sc),
aw AS (SELECT *, e / sum(e) OVER (PARTITION BY grid_id, ay, ax, h) AS w FROM ex),
mx AS (SELECT a.grid_id, a.ay AS py, a.ax AS px, v.j, sum(a.w * v.x) AS x FROM aw a JOIN vv v ON a.grid_id = v.grid_id AND a.by_ = v.py AND a.bx = v.px AND v.j // {width} = a.h GROUP BY ALL),
oo AS (SELECT grid_id, py, px, m.j, sum(x * w) / sqrt({dim}) AS o FROM mx JOIN {_matrix('wo', dim, dim)} m ON m.i = mx.j GROUP BY ALL),
en AS (SELECT grid_id, py, px, j, {ln('(x + o)')} AS x FROM tk JOIN oo USING (grid_id, py, px, j) WINDOW t AS (PARTITION BY grid_id, py, px)),
am AS (SELECT grid_id, ay, ax, by_, bx, avg(w) AS w FROM aw GROUP BY ALL),
ic AS (SELECT grid_id, by_ AS py, bx AS px, avg(w) AS incoming FROM am GROUP BY ALL),
nr AS (SELECT grid_id, py, px, sqrt(sum(x * x)) AS len FROM en GROUP BY ALL),
t0 AS (SELECT *, {visual} AS vis, {energy} AS eng, incoming * len AS cen FROM su JOIN ic USING (grid_id, py, px) JOIN nr USING (grid_id, py, px) WINDOW w AS (PARTITION BY grid_id)),
t1 AS (SELECT *, {_scale('vis')} AS visual, {_scale('eng')} AS energy, {_scale('cen')} AS centrality FROM t0 WINDOW w AS (PARTITION BY grid_id)),
t2 AS (SELECT *, 0.50 * visual + 0.30 * centrality + 0.20 * energy AS fused FROM t1),
sa AS (SELECT *, {_scale('fused')} AS saliency, row_number() OVER (PARTITION BY grid_id ORDER BY py, px) - 1 AS token_id FROM t2 WINDOW w AS (PARTITION BY grid_id))"""


_ENCODED = f"WITH {SQL_E}, {_SUMMARY}, {attention_sql(list(E_VARS), 8, 16, SHAPE)}"


@query("encoded_patches", f"""{_ENCODED} SELECT grid_id, py, px, CAST(token_id AS INT) AS token_id, {rd('visual', 5)}, {rd('centrality', 5)}, {rd('energy', 5)}, {rd('saliency', 5)}, 32 AS dim FROM sa""")
def encoded_patches(spark, sf):
    done = emb.encode(grid_e(spark, sf), SHAPE)
    return rounded(done.select(*emb.PATCH, "token_id", "visual", "centrality", "energy", "saliency", F.size("vector").alias("dim")), 5)


@query("patch_vectors", f"{_ENCODED} SELECT grid_id, py, px, CAST(j AS INT) AS j, {rd('x', 5)} FROM en")
def patch_vectors(spark, sf):
    done = emb.encode(grid_e(spark, sf), SHAPE)
    return rounded(done.select(*emb.PATCH, F.posexplode("vector").alias("j", "x")), 5)


_SUMMARY_I = _SUMMARY.replace("y // 3 AS py, x // 5 AS px", "y // 2 AS py, x // 2 AS px").replace("WHERE var = 'click'", "WHERE var = 'intensity'")


@query("attention_over_many_grids", f"""
WITH {SQL_I}, {_SUMMARY_I}, {attention_sql(["intensity"], 8, 8, (2, 2))}
SELECT grid_id, {rd('min(saliency)', 5, 'min')}, {rd('max(saliency)', 5, 'max')}, {rd('avg(saliency)', 5, 'mean')}, {rd('quantile_cont(saliency, 0.95)', 5, 'p95')}, count(*) AS tokens FROM sa GROUP BY grid_id""")
def attention_over_many_grids(spark, sf):
    g = grid_i(spark, sf)
    return rounded(emb.saliency_summary(emb.encode(g, (2, 2))), 5)


@query("grid_token", f"""{_ENCODED}, gm AS (SELECT grid_id, j, avg(x) AS x FROM en GROUP BY grid_id, j)
SELECT grid_id, CAST(j AS INT) AS j, {rd('(x - avg(x) OVER t) / greatest(stddev_pop(x) OVER t, 1e-6)', 5, 'x')} FROM gm WINDOW t AS (PARTITION BY grid_id)""")
def grid_token(spark, sf):
    done = emb.grid_token(emb.encode(grid_e(spark, sf), SHAPE))
    return rounded(done.select("grid_id", F.posexplode("grid_token").alias("j", "x")), 5)


@query("attention_edges", f"""{_ENCODED}, e AS (SELECT am.grid_id, a.token_id AS source, b.token_id AS target, w FROM am JOIN sa a ON a.py = ay AND a.px = ax JOIN sa b ON b.py = by_ AND b.px = bx WHERE a.token_id <> b.token_id)
SELECT grid_id, CAST(source AS INT) AS source, CAST(target AS INT) AS target, {rd('w', 5, 'attention')}, CAST(row_number() OVER w AS INT) AS rank FROM e WINDOW w AS (PARTITION BY grid_id ORDER BY w DESC) QUALIFY row_number() OVER w <= 20""")
def attention_edges(spark, sf):
    return rounded(emb.attention_edges(emb.encode(grid_e(spark, sf), SHAPE)), 5)


@query("top_salient_patches", f"""{_ENCODED} SELECT grid_id, py, px, {rd('saliency', 5)}, CAST(row_number() OVER w AS INT) AS rank FROM sa WINDOW w AS (PARTITION BY grid_id ORDER BY saliency DESC) QUALIFY row_number() OVER w <= 10""")
def top_salient_patches(spark, sf):
    return rounded(emb.top_patches(emb.encode(grid_e(spark, sf), SHAPE)).select(*emb.PATCH, "saliency", "rank"), 5)


@query("saliency_map", f"""{_ENCODED}, fm AS (SELECT a.y, a.x, saliency AS v FROM (SELECT DISTINCT y, x FROM cells) a JOIN sa ON a.y // 3 = py AND a.x // 5 = px),
kw AS (SELECT CAST(range AS INT) AS k, exp(-0.5::DOUBLE * range * range) AS w FROM range(-4, 5)),
sm AS (SELECT a.y, a.x, sum(b.v * wy.w * wx.w) / sum(wy.w * wx.w) AS s FROM fm a CROSS JOIN kw wy CROSS JOIN kw wx JOIN fm b ON b.y = {_mirror('(a.y + wy.k)', 8)} AND b.x = {_mirror('(a.x + wx.k)', 16)} GROUP BY a.y, a.x)
SELECT 'E' AS grid_id, y, x, {rd('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())', 5, 'v')} FROM sm""")
def saliency_map(spark, sf):
    g = grid_e(spark, sf)
    return rounded(emb.saliency_map(g, emb.encode(g, SHAPE), SHAPE), 5)


@query("text_hash_embedding", f"""
WITH s AS (SELECT conv_id * 1000 + turn AS id, trim(lower(text), ' \t\n\r') AS s FROM conversations),
g AS (SELECT id, unnest([substr(s, CAST(i AS INT), 2) for i in range(1, greatest(2, length(s)))]) AS gram FROM s WHERE length(s) > 0),
h AS (SELECT id, sha256(gram) AS d FROM g),
v AS (SELECT id, CAST(('0x' || substr(d, 1, 8))::BIGINT % 16 AS INT) AS i, sum(CASE WHEN ('0x' || substr(d, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM h GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id)
SELECT s.id, i.i, {rd('coalesce(v.w / n.n, 0)', 6, 'w')} FROM s CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(16)) i LEFT JOIN v ON v.id = s.id AND v.i = i.i LEFT JOIN n ON n.id = s.id""")
def text_hash_embedding(spark, sf):
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(emb.hash_embed(texts, "text", 16).select("id", F.posexplode("vector").alias("i", "w")), 6)


@query("text_patch_alignment", f"""{_ENCODED},
ts AS (SELECT conv_id * 1000 + turn AS id, trim(lower(text), ' \t\n\r') AS s FROM conversations),
tg AS (SELECT id, unnest([substr(s, CAST(i AS INT), 2) for i in range(1, greatest(2, length(s)))]) AS gram FROM ts WHERE length(s) > 0),
tv AS (SELECT id, CAST(('0x' || substr(d, 1, 8))::BIGINT % 32 AS INT) AS j, sum(CASE WHEN ('0x' || substr(d, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM (SELECT id, sha256(gram) AS d FROM tg) GROUP BY 1, 2),
tn AS (SELECT id, sqrt(sum(w * w)) AS n FROM tv GROUP BY id),
sim AS (SELECT tv.id, en.grid_id, en.py, en.px, sum(w * x) AS d FROM tv JOIN en USING (j) GROUP BY ALL),
r AS (SELECT sim.id, grid_id, token_id, d / n / len AS score FROM sim JOIN tn USING (id) JOIN sa USING (grid_id, py, px))
SELECT id, grid_id, CAST(token_id AS INT) AS token_id, {rd('score', 5)}, CAST(row_number() OVER w AS INT) AS rank FROM r WINDOW w AS (PARTITION BY id ORDER BY score DESC, token_id) QUALIFY row_number() OVER w <= 10""")
def text_patch_alignment(spark, sf):
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    vectors = emb.hash_embed(texts, "text", 32).withColumn("grid_id", F.lit("E"))
    return rounded(emb.align(vectors, emb.encode(grid_e(spark, sf), SHAPE)), 5)


# --- images ------------------------------------------------------------------------------------------------------


@query("image_grid_test", "SELECT event_type AS grid_id, event_type = 'click' AS is_image FROM events GROUP BY event_type")
def image_grid_test(spark, sf):
    variables = table(spark, sf, "events").select(F.col("event_type").alias("grid_id"), F.when(F.col("event_type") == "click", "Red").otherwise(F.col("event_type")).alias("var"))
    return img.image_grids(variables)


_WIDE = "w AS (SELECT grid_id, y, x, max(v) FILTER (var = 'red') AS r, max(v) FILTER (var = 'green') AS g, max(v) FILTER (var = 'blue') AS b FROM cells GROUP BY ALL)"
_LUMA = "mm AS (SELECT grid_id, 0 AS var, y, x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS v FROM w)"


@query("intensity_map", f"WITH {SQL_RGB}, {_WIDE}, {_LUMA} SELECT grid_id, y, x, {rd('v')} FROM mm")
def intensity_map(spark, sf):
    return rounded(img.intensity(grid_rgb(spark, sf)))


@query("edge_statistics", f"""
WITH {SQL_I}, {MEAN}, {grad_sql('mm', 'gr')}, s AS (SELECT grid_id, quantile_cont(g, 0.9) AS p90, quantile_cont(g, 0.95) AS p95, avg(g) AS m FROM gr GROUP BY grid_id)
SELECT grid_id, {rd('m', 4, 'mean_edge_strength')}, {rd('p90', 4, 'edge_threshold_p90')}, {rd('p95', 4, 'p95_edge_strength')}, {rd('avg(CASE WHEN g >= p90 THEN 1.0 ELSE 0.0 END)', 6, 'edge_density')}
FROM gr JOIN s USING (grid_id) GROUP BY grid_id, m, p90, p95""")
def edge_statistics(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.edge_stats(g, img.filled_intensity(g)), 4, edge_density=6)


_TEXTURE = f"""{box_sql('mm', 'bx', 5, 8, 8)},
ls AS (SELECT grid_id, avg(s) AS m, quantile_cont(s, 0.95) AS p FROM (SELECT grid_id, sqrt(greatest(q - m * m, 0)) AS s FROM bx) GROUP BY grid_id)"""


@query("texture_statistics", f"""
WITH {SQL_I}, {MEAN}, {_TEXTURE},
lv AS (SELECT *, least(greatest(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 15), 0), 15) AS level FROM mm WINDOW w AS (PARTITION BY grid_id)),
pr AS (SELECT a.grid_id, a.y, a.x, b.level, count(*) / 49.0::DOUBLE AS p FROM lv a CROSS JOIN range(-3, 4) dy CROSS JOIN range(-3, 4) dx JOIN lv b ON a.grid_id = b.grid_id
  AND b.y = CASE WHEN a.y + dy.range < 0 THEN -1 - (a.y + dy.range) WHEN a.y + dy.range >= 8 THEN 15 - (a.y + dy.range) ELSE a.y + dy.range END
  AND b.x = CASE WHEN a.x + dx.range < 0 THEN -1 - (a.x + dx.range) WHEN a.x + dx.range >= 8 THEN 15 - (a.x + dx.range) ELSE a.x + dx.range END GROUP BY a.grid_id, a.y, a.x, b.level),
e AS (SELECT grid_id, y, x, sum(-p * log2(p)) / 4 AS e FROM pr GROUP BY ALL), es AS (SELECT grid_id, avg(e) AS m, quantile_cont(e, 0.95) AS p FROM e GROUP BY grid_id)
SELECT grid_id, {rd('ls.m', 4, 'local_std_mean')}, {rd('ls.p', 4, 'local_std_p95')}, {rd('es.m', 6, 'local_entropy_mean')}, {rd('es.p', 6, 'local_entropy_p95')},
  CASE WHEN ls.m < 5 THEN 'smooth image regions' WHEN ls.m < 20 THEN 'moderate local texture' ELSE 'high local texture or sharp detail' END AS texture_label FROM ls JOIN es USING (grid_id)""")
def texture_statistics(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.texture_stats(g, img.filled_intensity(g)), 4, local_entropy_mean=6, local_entropy_p95=6)


_HIST = " || ',' || ".join(f"count(*) FILTER (v >= 0 AND v <= 255 AND least(floor(v / 15.9375), 15) = {i})" for i in range(16))


@query("intensity_histogram", f"WITH {SQL_RGB}, {_WIDE}, {_LUMA} SELECT grid_id, {_HIST} AS counts FROM mm GROUP BY grid_id")
def intensity_histogram(spark, sf):
    maps = img.intensity(grid_rgb(spark, sf))
    return img.histogram(maps, "v", 16, 0.0, 255.0).withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ","))


@query("image_summary", f"""
WITH {SQL_I}, {MEAN} SELECT grid_id, 8 AS width, 8 AS height, 1.0::DOUBLE AS aspect_ratio, 1 AS channel_count, {rd('avg(v)', 4, 'mean')}, {rd('stddev_pop(v)', 4, 'std')}, {rd('min(v)', 4, 'min')}, {rd('max(v)', 4, 'max')},
  {rd('max(v) - min(v)', 4, 'dynamic_range')} FROM mm GROUP BY grid_id""")
def image_summary(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.image_summary(g, img.pixels(g)), 4)


@query("channel_summary", f"WITH {SQL_RGB} SELECT grid_id, var, {rd('avg(v)', 4, 'mean')}, {rd('stddev_pop(v)', 4, 'std')}, {rd('min(v)', 4, 'min')}, {rd('max(v)', 4, 'max')} FROM cells GROUP BY grid_id, var")
def channel_summary(spark, sf):
    return rounded(img.channel_summary(grid_rgb(spark, sf)), 4)


_HSV = """hs AS (SELECT grid_id, y, x, r, g, b, mx AS value, CASE WHEN mx > 1e-12 THEN d / mx ELSE 0 END AS saturation, CASE WHEN d <= 1e-12 THEN 0 WHEN mx = b / 255 THEN (r / 255 - g / 255) / d + 4
    WHEN mx = g / 255 THEN (b / 255 - r / 255) / d + 2 WHEN g < b THEN (g / 255 - b / 255) / d + 6 ELSE (g / 255 - b / 255) / d END / 6 AS hue
  FROM (SELECT *, greatest(r, g, b) / 255 AS mx, greatest(r, g, b) / 255 - least(r, g, b) / 255 AS d FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL))"""


@query("hsv_map", f"WITH {SQL_RGB}, {_WIDE}, {_HSV} SELECT grid_id, y, x, {rd('hue', 6)}, {rd('saturation', 6)}, {rd('value', 6)} FROM hs")
def hsv_map(spark, sf):
    turned = img.to_hsv(img.pixels(grid_rgb(spark, sf))).where(F.col("value").isNotNull())
    return rounded(turned.select("grid_id", "y", "x", "hue", "saturation", "value"), 6)


_HUES = [f"count(*) FILTER (hue >= {i} * (1 / 12.0::DOUBLE) AND hue <{'=' if i == 11 else ''} {i + 1} * (1 / 12.0::DOUBLE))" for i in range(12)]


@query("hsv_statistics", f"""
WITH {SQL_RGB}, {_WIDE}, {_HSV}, a AS (SELECT grid_id, avg(sin(hue * 2 * pi())) AS s, avg(cos(hue * 2 * pi())) AS c, avg(saturation) AS ms, quantile_cont(saturation, 0.95) AS ps, avg(value) AS mv, [{", ".join(_HUES)}] AS h,
  sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(avg(r - g) * avg(r - g) + avg(0.5 * (r + g) - b) * avg(0.5 * (r + g) - b)) AS cf FROM hs GROUP BY grid_id)
SELECT grid_id, {rd('((atan2(s, c) + 2 * pi()) % (2 * pi())) / (2 * pi())', 6, 'mean_hue')}, {rd('ms', 6, 'mean_saturation')}, {rd('ps', 6, 'p95_saturation')}, {rd('mv', 6, 'mean_value')}, {rd('cf', 4, 'colorfulness')},
  array_to_string(h, ',') AS hue_counts, {list(rules.HUE_NAMES)}[list_position(h, list_max(h))] AS dominant_color FROM a""")
def hsv_statistics(spark, sf):
    g = grid_rgb(spark, sf)
    whole = img.pixels(g).where("red is not null and green is not null and blue is not null")
    done = img.hsv_stats(g, whole)
    return rounded(done.withColumn("hue_counts", F.array_join(F.col("hue_counts").cast("array<string>"), ",")), 6, colorfulness=4)


def _scaled(mode_sql: str) -> str:
    return f"WITH {SQL_I}, {MEAN}, m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, max(abs(v)) OVER w AS top FROM mm WINDOW w AS (PARTITION BY grid_id, var)) SELECT grid_id, var, y, x, {rd(mode_sql, 5, 'v')} FROM m"


@query("scale_channel", _scaled("round_even(CASE WHEN lo >= 0 AND hi <= 255 THEN v WHEN lo = hi THEN 127 ELSE (v - lo) / (hi - lo) * 255 END, 0)"))
def scale_channel(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.scale_map(g, agg.mean_map(g), "channel"), 5)


@query("scale_minmax", _scaled("(v - lo) / (hi - lo)"))
def scale_minmax(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.scale_map(g, agg.mean_map(g), "minmax"), 5)


@query("scale_symmetric", _scaled("(v + top) / (2 * top)"))
def scale_symmetric(spark, sf):
    g = grid_i(spark, sf)
    return rounded(img.scale_map(g, agg.mean_map(g), "symmetric"), 5)


def _clipped(low: float, high: float) -> str:
    return f"""WITH {SQL_E}, {MEAN}, q AS (SELECT grid_id, var, quantile_cont(v, {low}) AS a, quantile_cont(v, {high}) AS b FROM mm GROUP BY grid_id, var)
SELECT grid_id, var, y, x, {rd('CASE WHEN v IS NOT NULL THEN least(greatest((v - a) / (b - a), 0), 1) END', 5, 'v')} FROM mm JOIN q USING (grid_id, var)"""


@query("scale_clip", _clipped(0.05, 0.95))
def scale_clip(spark, sf):
    g = grid_e(spark, sf)
    return rounded(img.scale_map(g, agg.mean_map(g), "clip"), 5)


@query("scale_spread", _clipped(0.02, 0.98))
def scale_spread(spark, sf):
    g = grid_e(spark, sf)
    return rounded(img.scale_map(g, agg.mean_map(g), "spread"), 5)


def image_sql(color: bool) -> str:
    """Image features of 8 by 8 grids from mm(grid_id, var, y, x, v), and from hs where there are colours."""
    level = "least(greatest(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 15), 0), 15)"
    near = lambda c: _mirror(f"(a.{c} + d{c}.range)", 8)
    parts = f"""{grad_sql('mm', 'gr', 'grid_id')},
eq AS (SELECT grid_id, quantile_cont(g, 0.9) AS p90, quantile_cont(g, 0.95) AS p95, avg(g) AS m FROM gr GROUP BY grid_id),
ed AS (SELECT grid_id, avg(CASE WHEN g >= p90 THEN 1.0 ELSE 0.0 END) AS density FROM gr JOIN eq USING (grid_id) GROUP BY grid_id),
{box_sql('mm', 'bx', 5, 8, 8, keys='grid_id')}, ls AS (SELECT grid_id, avg(s) AS m, quantile_cont(s, 0.95) AS p FROM (SELECT grid_id, sqrt(greatest(q - m * m, 0)) AS s FROM bx) GROUP BY grid_id),
lv AS (SELECT *, {level} AS level FROM mm WINDOW w AS (PARTITION BY grid_id)),
pr AS (SELECT a.grid_id, a.y, a.x, b.level, count(*) / 49.0::DOUBLE AS p FROM lv a CROSS JOIN range(-3, 4) dy CROSS JOIN range(-3, 4) dx JOIN lv b ON a.grid_id = b.grid_id AND b.y = {near('y')} AND b.x = {near('x')} GROUP BY a.grid_id, a.y, a.x, b.level),
ep AS (SELECT grid_id, avg(e) AS m, quantile_cont(e, 0.95) AS p FROM (SELECT grid_id, y, x, sum(-p * log2(p)) / 4 AS e FROM pr GROUP BY ALL) GROUP BY grid_id),
im AS (SELECT grid_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx, {_HIST} AS counts FROM mm GROUP BY grid_id)"""
    out = f"""grid_id, 8 AS width, 8 AS height, 1.0::DOUBLE AS aspect_ratio, {3 if color else 1} AS channel_count, {rd('im.mean', 4, 'mean')}, {rd('im.std', 4, 'std')}, {rd('mn', 4, 'min')}, {rd('mx', 4, 'max')}, {rd('mx - mn', 4, 'dynamic_range')},
  {rd('eq.m', 4, 'mean_edge_strength')}, {rd('p90', 4, 'edge_threshold_p90')}, {rd('p95', 4, 'p95_edge_strength')}, {rd('density', 4, 'edge_density')}, {rd('ls.m', 4, 'local_std_mean')}, {rd('ls.p', 4, 'local_std_p95')},
  {rd('ep.m', 4, 'local_entropy_mean')}, {rd('ep.p', 4, 'local_entropy_p95')}, CASE WHEN ls.m < 5 THEN 'smooth image regions' WHEN ls.m < 20 THEN 'moderate local texture' ELSE 'high local texture or sharp detail' END AS texture_label, counts"""
    tail = " FROM im JOIN eq USING (grid_id) JOIN ed USING (grid_id) JOIN ls USING (grid_id) JOIN ep USING (grid_id)"
    if not color:
        return f"{parts} SELECT {out}{tail}"
    hv = f"""hv AS (SELECT grid_id, avg(sin(hue * 2 * pi())) AS s, avg(cos(hue * 2 * pi())) AS c, avg(saturation) AS ms, quantile_cont(saturation, 0.95) AS ps, avg(value) AS mv, [{", ".join(_HUES)}] AS h,
  sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(avg(r - g) * avg(r - g) + avg(0.5 * (r + g) - b) * avg(0.5 * (r + g) - b)) AS cf FROM hs GROUP BY grid_id)"""
    tint = f"""{rd('((atan2(s, c) + 2 * pi()) % (2 * pi())) / (2 * pi())', 4, 'mean_hue')}, {rd('ms', 4, 'mean_saturation')}, {rd('ps', 4, 'p95_saturation')}, {rd('mv', 4, 'mean_value')}, {rd('cf', 4, 'colorfulness')},
  array_to_string(h, ',') AS hue_counts, {list(rules.HUE_NAMES)}[list_position(h, list_max(h))] AS dominant_color"""
    return f"{parts}, {hv} SELECT {out}, {tint}{tail} JOIN hv USING (grid_id)"


def flat_image(df):
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("counts", "hue_counts") if c in df.columns}
    return rounded(df.withColumns(text), 4)


_COLOURED = f"WITH {SQL_RGB}, {_WIDE}, {_LUMA.replace('FROM w', 'FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL')}, {_HSV}, {image_sql(True)}"


# The last image may lack colours and thus any intensity: it has a row as well.
@query("image_features", f"""
SELECT * FROM ({_COLOURED}) UNION ALL BY NAME
SELECT CAST(vec_id // 3 AS VARCHAR) AS grid_id, 8 AS width, 8 AS height, 1.0::DOUBLE AS aspect_ratio, 3 AS channel_count, 'unknown texture' AS texture_label, '{",".join("0" * 16)}' AS counts,
  0.0::DOUBLE AS colorfulness, '{",".join("0" * 12)}' AS hue_counts, 'unknown' AS dominant_color FROM embeddings GROUP BY 1 HAVING count(*) < 3""")
def image_features(spark, sf):
    return flat_image(img.image_features(grid_rgb(spark, sf)))
