"""Image files as grids of pixels: Spark's image source decodes them, tasks unpack strips of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridframe.functions import rules
from gridframe.model import CELLS, Grid


#: Pixels that are unpacked at a time.
STRIP = 1 << 16


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of images, a strip of whole pixel rows at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            grid_id, height, width, channels = (batch.column(c)[i].as_py() for c in range(4))
            if height <= 0 or width <= 0:
                continue
            pixels = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8, height * width * channels).reshape(height, width, channels)
            step = max(1, STRIP // width)
            for top in range(0, height, step):
                strip = pixels[top : top + step].astype(np.float64)
                if channels >= 3:
                    blue, green, red = (strip[..., c] for c in range(3))
                    wr, wg, wb = rules.LUMA
                    fields = {"intensity": wr * red + wg * green + wb * blue, "red": red, "green": green, "blue": blue}
                else:
                    fields = {"intensity": strip[..., 0]}
                if channels in (2, 4):
                    fields["alpha"] = strip[..., channels - 1]
                y, x = np.indices(strip.shape[:2], dtype=np.int32)
                n = y.size
                for var, values in fields.items():
                    columns = [pa.array([grid_id] * n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array([var] * n), pa.array(y.ravel() + np.int32(top)), pa.array(x.ravel()), pa.array(values.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["grid_id", "t", "var", "y", "x", "v"])


def image_cells(images: DataFrame) -> DataFrame:
    """Cells of rows (grid_id, height, width, nChannels, data) with bytes in blue-green-red order, row by row.

    Variables are intensity, red, green, blue and alpha; one-channel images give intensity, and alpha with two channels.
    """
    return images.select("grid_id", "height", "width", "nChannels", "data").mapInArrow(_strips, CELLS)


def read_images(spark: SparkSession, path: str, glob: str = "*", skip_unreadable: bool = False) -> Grid:
    """One grid per image file, named by the file without its suffix; pixel coordinates.

    Files that can't be decoded raise an error that counts them and names the first; with ``skip_unreadable`` they are left out.
    """
    rows = spark.read.format("image").option("dropInvalid", skip_unreadable).option("pathGlobFilter", glob).load(path).select(
        F.regexp_extract("image.origin", r"([^/]+?)(\.[^./]*)?$", 1).alias("grid_id"), "image.height", "image.width", "image.nChannels", "image.data"
    )
    dims = rows.select("grid_id", F.lit(1).alias("n_t"), F.col("height").alias("n_y"), F.col("width").alias("n_x"))
    largest = rows.agg(F.max("height"), F.max("width"), F.max("nChannels"), F.sum((F.col("height") <= 0).cast("int")), F.min(F.when(F.col("height") <= 0, F.col("grid_id")))).first()
    if largest[3]:
        raise ValueError(f"{largest[3]} image files can't be decoded, the first is {largest[4]}")
    names = ("intensity", "red", "green", "blue", "alpha") if largest[2] == 4 else ("intensity", "red", "green", "blue") if largest[2] == 3 else ("intensity",)
    return Grid(
        image_cells(rows), names, (1, largest[0], largest[1]), dims=dims, grid_type="image", coordinate_system="pixel", crs="pixel_coordinates"
    )
