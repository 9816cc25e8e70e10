"""Registry of queries with their SQL counterparts, and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MEAN = "mm AS (SELECT grid_id, var, y, x, avg(v) AS v FROM cells GROUP BY grid_id, var, y, x)"
SERIES = "sm AS (SELECT grid_id, var, t, avg(v) AS v FROM cells GROUP BY grid_id, var, t)"


def grad_sql(src: str, out: str, keys: str = "grid_id, var", value: str = "v") -> str:
    def one(lo: str, hi: str) -> str:
        return (
            f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN ({hi} - {lo}) / 2 "
            f"WHEN {hi} IS NOT NULL THEN {hi} - {value} ELSE {value} - {lo} END"
        )

    return f"""{out} AS (
  SELECT *, sqrt(gx * gx + gy * gy) AS g FROM (
    SELECT *, {one('_l', '_r')} AS gx, {one('_u', '_d')} AS gy FROM (
      SELECT *, lag({value}) OVER (PARTITION BY {keys}, y ORDER BY x) AS _l, lead({value}) OVER (PARTITION BY {keys}, y ORDER BY x) AS _r,
             lag({value}) OVER (PARTITION BY {keys}, x ORDER BY y) AS _u, lead({value}) OVER (PARTITION BY {keys}, x ORDER BY y) AS _d
      FROM {src})))"""


def fill_sql(src: str, out: str, keys: tuple[str, ...] = ("grid_id", "var"), empty: str = "NULL") -> str:
    """Nearest fill; adds column f. Each column has its nearest present cell above or below; a gap is compared with those of
    its row, which hold the nearest cell of all."""
    same = " AND ".join(f"m.{k} = p.{k}" for k in keys)
    cols, plain = ", ".join(f"m.{k}" for k in keys), ", ".join(keys)
    there = "CASE WHEN v IS NOT NULL THEN y END"
    up = f"(PARTITION BY {plain}, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"(PARTITION BY {plain}, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""{out}_src AS MATERIALIZED (SELECT * FROM {src}),
{out}_seen AS MATERIALIZED (
  SELECT {plain}, y, x, last_value({there} IGNORE NULLS) OVER {up} AS y1, last_value(v IGNORE NULLS) OVER {up} AS v1,
    first_value({there} IGNORE NULLS) OVER {down} AS y2, first_value(v IGNORE NULLS) OVER {down} AS v2 FROM {out}_src),
{out}_best AS MATERIALIZED (
  SELECT {plain}, y, x, CASE WHEN y2 IS NULL OR y - y1 <= y2 - y THEN y1 ELSE y2 END AS _from, CASE WHEN y2 IS NULL OR y - y1 <= y2 - y THEN v1 ELSE v2 END AS _value
  FROM {out}_seen WHERE y1 IS NOT NULL OR y2 IS NOT NULL),
{out}_gaps AS MATERIALIZED (SELECT {plain}, y, x FROM {out}_src WHERE v IS NULL),
{out}_near AS MATERIALIZED (
  SELECT {cols}, m.y, m.x, arg_min(p._value, CAST((m.y - p._from) * (m.y - p._from) + (m.x - p.x) * (m.x - p.x) AS BIGINT) * 1000000 + p._from * 1000 + p.x) AS n
  FROM {out}_gaps m JOIN {out}_best p ON {same} AND m.y = p.y GROUP BY {cols}, m.y, m.x),
{out} AS (
  SELECT m.*, coalesce(m.v, s.n, {empty}) AS f FROM {out}_src m
  LEFT JOIN {out}_near s ON {" AND ".join(f"m.{k} = s.{k}" for k in keys)} AND m.y = s.y AND m.x = s.x)"""


def comp_sql(src: str, out: str, keys: tuple[str, ...] = ("grid_id", "var"), width: int = 40) -> str:
    """Components of the cells of src by reachability; needs WITH RECURSIVE."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""{out}_n AS (SELECT {ks}, y, x, CAST(y AS BIGINT) * {width} + x AS id FROM {src}),
{out}_e AS (
  SELECT {", ".join("a." + k for k in keys)}, a.id AS p, b.id AS q FROM {out}_n a JOIN {out}_n b
  ON {same} AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
{out}_r AS (
  SELECT {ks}, id, id AS root FROM {out}_n
  UNION
  SELECT {", ".join("r." + k for k in keys)}, e.q, r.root FROM {out}_r r JOIN {out}_e e ON {" AND ".join(f"r.{k} = e.{k}" for k in keys)} AND r.id = e.p),
{out} AS (
  SELECT s.*, c.component FROM {src} s JOIN (SELECT {ks}, id, min(root) AS component FROM {out}_r GROUP BY {ks}, id) c
  ON {" AND ".join(f"s.{k} = c.{k}" for k in keys)} AND CAST(s.y AS BIGINT) * {width} + s.x = c.id)"""


def corr_sql(x: str, y: str) -> str:
    return (
        f"CASE WHEN stddev_pop({x}) FILTER ({y} IS NOT NULL) = 0 OR stddev_pop({y}) FILTER ({x} IS NOT NULL) = 0 THEN NULL "
        f"ELSE corr({x}, {y}) END"
    )


COMPASS = """CASE WHEN {gx} IS NULL THEN NULL WHEN sqrt({gx} * {gx} + {gy} * {gy}) < 1e-12 THEN 'flat' ELSE
  ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'][1 + CAST(floor(((degrees(atan2({gy}, {gx})) + 382.5) % 360) / 45) AS INT)] END"""
