"""Rasters built from streams: raster rows that arrive in batches, and events that add people to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessarion.operators import table
from tessarion.plans.grid import Grid
from tessarion.sources import raster


def row_prefixes(rows: DataFrame, grid: Grid, nodata: float = raster.NODATA) -> DataFrame:
    """(row, prefix) of packed raster rows (row, values), batch or stream: each row stands alone, so it is a projection and memory is
    one row's width whatever the raster's height."""
    return table.prefix_rows(rows, grid, 1, nodata).select("row", "prefix")


def write_prefixes(rows: DataFrame, grid: Grid, output: str, checkpoint: str) -> StreamingQuery:
    """Publish row prefixes as raster rows arrive; a restart goes on where the checkpoint is."""
    return row_prefixes(rows, grid).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_cells(events: DataFrame, grid: Grid, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, row, col, value): people counted by cell and event-time window from ``events(ts, row, col)``, late rows up to ``late``.
    An extension: state is one number for each cell and open window."""
    kept = events.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    counted = kept.withWatermark("ts", late).groupBy(F.window("ts", window), "row", "col").agg(F.count("*").cast("double").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "row", "col", "value")
