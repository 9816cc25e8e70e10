"""Registered queries against their SQL on the smallest tables.

By default a spread of quick ones; all of them with GRIDFRAME_ALL=1.
"""

import os

import duckdb
import pytest

from checks import all_queries
from checks.run import TABLES, rows_of

QUERIES, ORACLES = all_queries()
SOME = (
    "rasterize_points", "points_snapped", "cells_by_index", "cells_written_and_read", "matrix_text", "matrix_csv_files", "matrix_json_files", "matrix_json_errors", "series_of_files", "series_of_arrays", "array_axis_order",
    "image_pixels", "thin_pairs", "polygon_mask", "polygon_mask_bands", "fill_nearest", "global_statistics", "large_group_quantiles", "correlation_matrix", "correlation_of_many", "relations_of_many", "log_summary",
    "gradient_statistics", "box_filter", "local_entropy", "texture_statistics", "hotspot_table", "trend_map", "maps_of_lengths", "cards_of_lengths", "change_points", "periodicity", "similar_slices", "block_features",
    "block_embedding_products", "time_slice_embedding_products", "relation_embedding_products", "patch_summary", "text_hash_embedding", "hsv_statistics", "request_variables", "request_products", "merged_plans",
    "merged_analysis_plans", "bundle_hotspots", "bundle_change_points", "bundle_coverage",
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("GRIDFRAME_ALL") else SOME)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_every_query_is_registered_once_and_oracles_match():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 140
