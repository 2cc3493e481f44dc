"""Rasters as DataFrames of cells (row, col, value), cleaned and tallied."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.plans.grid import Grid

#: The sentinel of the registered population raster (fixed value), compared as a 32-bit float.
NODATA = -3.40282306073709653e38
#: Classes of cells, in the order of the rules.
CLASSES = ("nodata", "unexpected_negative", "zero", "populated")


class RasterError(ValueError):
    """A raster that isn't what was declared; ``kind`` names the rule."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def as_float32(value: float) -> float:
    return struct.unpack("<f", struct.pack("<f", value))[0]


def same_bits(a: float, b: float) -> bool:
    return struct.pack("<f", a) == struct.pack("<f", b)


def synthetic(spark: SparkSession, grid: Grid, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Cells of literal rows; a ragged or misshapen literal is refused."""
    if len(rows) != grid.height or any(len(r) != grid.width for r in rows):
        raise RasterError("shape", f"{len(rows)} rows for a grid of {grid.width} x {grid.height}")
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, value float")


def from_rows(packed: DataFrame) -> DataFrame:
    """Cells of (row, values array<float>)."""
    return packed.select("row", F.posexplode("values").alias("col", "value"))


def is_nodata(value: Column, nodata: float) -> Column:
    return F.isnan(value) if math.isnan(nodata) else value == F.lit(nodata).cast("float")


def cell_class(value: Column, nodata: float = NODATA) -> Column:
    """nodata, unexpected_negative, zero (values that are no numbers too) or populated."""
    return F.when(value.isNull() | is_nodata(value, nodata), "nodata").when(F.isnan(value), "zero").when(value < 0, "unexpected_negative").when(value == 0, "zero").otherwise("populated")


def sanitised(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Cells with what isn't a count of people set to 0, widened to double."""
    value = F.col("value")
    good = ~(value.isNull() | F.isnan(value) | is_nodata(value, nodata)) & (value > 0)
    return cells.select("row", "col", F.when(good, value.cast("double")).otherwise(0.0).alias("value"))


def tallies(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """One row: cells of each class, and all."""
    kind = cell_class(F.col("value"), nodata)
    return cells.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in CLASSES], F.count("*").alias("total"))


def checked(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose indices the grid has; another index stops the query."""
    ok = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)
    return cells.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("a cell lies off the grid")).isNull())


def statistics(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """One row: tallies, the total and the largest cell."""
    clean = sanitised(cells, nodata)
    return tallies(cells, nodata).crossJoin(clean.agg(F.sum("value").alias("total_population"), F.max("value").alias("largest")))
