"""A field for tests: a plane with two bumps, some waves and one missing rectangle."""

from pyspark.sql import functions as F

from gridframe.model import Grid


def bumpy_field(spark, height=72, width=112, steps=5):
    cells = spark.range(steps * height * width).selectExpr(
        "'demo' AS grid_id", f"CAST(id DIV {height * width} AS INT) AS t", "'value' AS var", f"CAST(id DIV {width} % {height} AS INT) AS y", f"CAST(id % {width} AS INT) AS x"
    )
    y, x = F.col("y") / height, F.col("x") / width
    warm = 30 * F.exp(-60 * ((x - 0.7) * (x - 0.7) + (y - 0.3) * (y - 0.3)))
    cold = 25 * F.exp(-60 * ((x - 0.3) * (x - 0.3) + (y - 0.7) * (y - 0.7)))
    value = 10 + 20 * x + warm - cold + 3 * F.cos(9 * (x + y)) + F.col("t") * (1 + y)
    hole = F.col("y").between(5, 12) & F.col("x").between(5, 23)
    return Grid(cells.withColumn("v", F.when(~hole, value)), ("value",), (steps, height, width))
