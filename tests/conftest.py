import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from gridframe.session import local_session

    session = local_session(4, "6g", "gridframe-tests")
    yield session
    session.stop()


@pytest.fixture
def grid_from(spark):
    """Grid of one variable from an array [t, y, x] or [y, x]; NaN is a gap."""
    from gridframe.model import CELLS, Grid

    def make(array, var="v", grid_id="g", **fields):
        array = np.asarray(array, dtype=float)
        stack = array if array.ndim == 3 else array[None]
        rows = [
            (grid_id, int(t), var, int(y), int(x), None if np.isnan(v) else float(v)) for (t, y, x), v in np.ndenumerate(stack)
        ]
        return Grid(spark.createDataFrame(rows, CELLS), (var,), stack.shape, **fields)

    return make


@pytest.fixture
def as_map():
    """Array [y, x] of one column of collected rows."""

    def make(df, shape, value="v"):
        out = np.full(shape, np.nan)
        for r in df.select("y", "x", value).collect():
            out[r["y"], r["x"]] = np.nan if r[value] is None else r[value]
        return out

    return make
