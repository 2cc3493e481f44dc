"""Discs: kernels, placed discs, and their populations.

A kernel says, for a centre row and a radius, how many columns either side of the centre the disc covers in each row it reaches. It
doesn't depend on the centre's column, so it is computed once for each (centre row, radius) and joined to centres.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.functions import geodesy
from tessarion.plans.grid import Grid

#: Row prefixes up to this many bytes are broadcast; larger ones are joined by row.
BROADCAST_BYTES = 96 << 20


def prefix_side(prefix: DataFrame, grid: Grid) -> DataFrame:
    """The prefixes as a join side: a broadcast while their size, known from the grid, is within the bound."""
    return F.broadcast(prefix) if grid.height * (grid.width + 1) * 8 <= BROADCAST_BYTES else prefix


def kernels(grid: Grid, centres: DataFrame) -> DataFrame:
    """(centre_row, radius_km, row, half_width, full_turn) for ``centres(centre_row, radius_km)``, rows clipped at the grid's edges.

    The half width is the law-of-cosines estimate, corrected by the membership test itself within two columns.
    """
    grid.require_closed()
    closing = grid.width // 2
    step = abs(grid.lat_step)
    angle = geodesy.angle_of_km(F.col("radius_km"))
    reach = F.least(F.lit(float(grid.height)), F.degrees(angle) / step + 2).cast("int")
    rows = F.sequence(F.greatest(F.lit(0), F.col("centre_row") - reach), F.least(F.lit(grid.height - 1), F.col("centre_row") + reach))
    base = centres.select("centre_row", "radius_km", angle.alias("angle"), F.explode(rows).alias("row"))
    lat0, lat = grid.centre_lat(F.col("centre_row")), grid.centre_lat(F.col("row"))

    def inside(cells: Column) -> Column:
        return geodesy.central_angle(lat0, F.lit(0.0), lat, cells * grid.lon_step) <= F.col("angle")

    ratio = (F.cos("angle") - F.sin(F.radians(lat0)) * F.sin(F.radians(lat))) / (F.cos(F.radians(lat0)) * F.cos(F.radians(lat)))
    cells = F.degrees(F.acos(ratio)) / abs(grid.lon_step)
    estimate = F.when(ratio >= 1, 0).when(ratio <= -1, closing).when(F.isnan(cells) | (cells >= closing), closing).otherwise(cells.cast("int"))
    reached = base.where(inside(F.lit(0))).withColumn("estimate", estimate)
    near = F.sequence(F.greatest(F.lit(0), F.col("estimate") - 2), F.least(F.lit(closing), F.col("estimate") + 2))
    half = F.coalesce(F.array_max(F.filter(near, inside)), F.lit(0))
    return reached.select("centre_row", "radius_km", "row", half.alias("half_width")).withColumn("full_turn", F.col("half_width") == closing)


def covering(kernel: DataFrame, grid: Grid) -> DataFrame:
    """(centre_row, radius_km, covers) of a kernel: whether the disc is the whole grid, every row by a full turn."""
    full = kernel.groupBy("centre_row", "radius_km").agg(F.bool_and("full_turn").alias("full"), F.count("*").alias("n"))
    return full.select("centre_row", "radius_km", (F.col("full") & (F.col("n") == grid.height)).alias("covers"))


def placed(kernel: DataFrame, centres: DataFrame, grid: Grid) -> DataFrame:
    """(id, row, west, east) of discs ``centres(id, centre_row, centre_col, radius_km)``: one span a row, two where it crosses the
    seam, the whole row once for a full turn."""
    spans = centres.join(kernel, ["centre_row", "radius_km"])
    w = grid.width
    west = F.pmod(F.col("centre_col") - F.col("half_width"), F.lit(w))
    east = F.pmod(F.col("centre_col") + F.col("half_width"), F.lit(w))
    span = lambda a, b: F.struct(a.cast("int").alias("west"), b.cast("int").alias("east"))
    parts = (
        F.when(F.col("full_turn"), F.array(span(F.lit(0), F.lit(w - 1))))
        .when(west <= east, F.array(span(west, east)))
        .otherwise(F.array(span(west, F.lit(w - 1)), span(F.lit(0), east)))
    )
    return spans.select("id", "row", F.explode(parts).alias("x")).select("id", "row", "x.west", "x.east")


def populations(prefix: DataFrame, grid: Grid, centres: DataFrame) -> DataFrame:
    """(id, population) of discs ``centres(id, centre_row, centre_col, radius_km)``; id is unique."""
    shapes = kernels(grid, centres.select("centre_row", "radius_km").distinct())
    spans = placed(shapes, centres, grid)
    piece = F.element_at("prefix", F.col("east") + 2) - F.element_at("prefix", F.col("west") + 1)
    return spans.join(prefix_side(prefix, grid), "row").select("id", piece.alias("piece")).groupBy("id").agg(F.sum("piece").alias("population"))


def population_at(prefix: DataFrame, grid: Grid, lat: float, lon: float, radius_km: float) -> DataFrame:
    """One row: the cell that holds a point, its centre, and the population of the disc round that centre."""
    from tessarion.plans.errors import BadInput

    radius = geodesy.RadiusKm(float(radius_km))
    at = grid.cell_containing(lat, lon)
    if at is None:
        raise BadInput(f"({lat}, {lon}) lies off the grid")
    spark = prefix.sparkSession
    one = spark.createDataFrame([(0, at[0], at[1], radius.km)], "id int, centre_row int, centre_col int, radius_km double")
    found = one.join(populations(prefix, grid, one), "id", "left")
    row, col = F.col("centre_row"), F.col("centre_col")
    return found.select(row.alias("row"), col.alias("col"), grid.centre_lat(row).alias("lat"), grid.centre_lon(col).alias("lon"), "radius_km", F.coalesce("population", F.lit(0.0)).alias("population"))


def population_by_distance(cells: DataFrame, grid: Grid, centres: DataFrame) -> DataFrame:
    """The same by definition, every cell against every centre: for tests and small grids only."""
    here = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "value")
    angle = geodesy.central_angle(grid.centre_lat(F.col("centre_row")), F.lit(0.0), grid.centre_lat(F.col("r")), (F.col("c") - F.col("centre_col")) * grid.lon_step)
    return centres.join(here, angle <= geodesy.angle_of_km(F.col("radius_km"))).groupBy("id").agg(F.sum("value").alias("population"))


def all_centres(spark: SparkSession, grid: Grid, radii: list[float]) -> DataFrame:
    """Every cell as a centre, for each radius: (id, centre_row, centre_col, radius_km)."""
    n = grid.width * grid.height
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(r)).alias("radius_km")) for k, r in enumerate(radii)])).alias("x")
    rows = grid.cells(spark).select("row", "col", each)
    return rows.select((F.col("x.k").cast("long") * n + F.col("row") * grid.width + F.col("col")).alias("id"), F.col("row").alias("centre_row"), F.col("col").alias("centre_col"), F.col("x.radius_km").alias("radius_km"))


def best(candidates: DataFrame, *by: str) -> DataFrame:
    """(by..., row, col, population) of the largest population, ties going to the smaller (row, col); a population that is no number
    never wins over one that is."""
    number = F.when(F.isnan("population"), F.lit(None).cast("double")).otherwise(F.col("population"))
    top = F.max(F.struct(number.alias("p"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), F.col("population").alias("population"))).alias("x")
    grouped = candidates.groupBy(*by).agg(top) if by else candidates.agg(top)
    return grouped.select(*by, (-F.col("x.r")).alias("row"), (-F.col("x.c")).alias("col"), F.col("x.population").alias("population"))


def most_populous_of_all(prefix: DataFrame, grid: Grid, radii: list[float]) -> DataFrame:
    """(radius_km, row, col, population): every centre is evaluated, all radii in one job; nothing returns to the driver."""
    centres = all_centres(prefix.sparkSession, grid, radii)
    full = centres.join(populations(prefix, grid, centres), "id")
    return best(full.select("radius_km", F.col("centre_row").alias("row"), F.col("centre_col").alias("col"), "population"), "radius_km")


def slack_km(grid: Grid, north: int, south: int, first: int, last: int) -> float:
    """An upper bound on the distance from a block's middle cell to any of its cell centres: along the middle parallel, then a meridian.

    The margin of 32 units in the last place keeps rounding from pruning a block that holds the answer.
    """
    row, col = north + (south - north) // 2, first + (last - first) // 2
    lat = grid.centre_lat_at(row)
    dlat = max(abs(grid.centre_lat_at(north) - lat), abs(grid.centre_lat_at(south) - lat))
    dlon = max(col - first, last - col) * abs(grid.lon_step)
    return geodesy.EARTH_RADIUS_KM * (math.radians(dlat) + math.radians(dlon) * math.cos(math.radians(lat))) * (1 + 32 * 2.0**-52)


def slacks_km(grid: Grid, blocks: np.ndarray) -> np.ndarray:
    """``slack_km`` of many blocks (north, south, first, last)."""
    north, south, first, last = blocks.T
    row, col = north + (south - north) // 2, first + (last - first) // 2
    lat = grid.centre_lat_at(row)
    dlat = np.maximum(np.abs(grid.centre_lat_at(north) - lat), np.abs(grid.centre_lat_at(south) - lat))
    dlon = np.maximum(col - first, last - col) * abs(grid.lon_step)
    return geodesy.EARTH_RADIUS_KM * (np.radians(dlat) + np.radians(dlon) * np.cos(np.radians(lat))) * (1 + 32 * 2.0**-52)
