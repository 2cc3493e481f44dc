"""A north-up grid of cells; its six numbers enter every plan as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.functions import geodesy

#: Degrees within which two steps, origins or spans are the same (fixed value).
TOLERANCE_DEG = 1e-9


class GridError(ValueError):
    """``kind``: empty_dimension, non_finite_origin, origin_lat_out_of_range, non_finite_step, zero_step, lat_step_not_southward,
    runs_past_south_pole, runs_past_a_full_turn."""

    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"no such grid ({kind}): {detail}")
        self.kind = kind


class KernelError(ValueError):
    """Discs need a grid whose columns close round the earth."""


class DecimationError(ValueError):
    """A factor that doesn't divide both dimensions."""


@dataclass(frozen=True)
class Window:
    """Degrees; a span of 360 or more is the full turn, a negative one crosses the seam."""

    north: float
    south: float
    west: float
    east: float


@dataclass(frozen=True)
class ColSpan:
    west: int
    east: int
    full_turn: bool = False

    def ranges(self, width: int) -> list[tuple[int, int]]:
        """One or two spans that don't wrap; a full turn is never cut in two."""
        if self.full_turn:
            return [(0, width - 1)]
        return [(self.west, self.east)] if self.west <= self.east else [(self.west, width - 1), (0, self.east)]


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    origin_lat: float
    origin_lon: float
    lon_step: float
    lat_step: float

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise GridError("empty_dimension", f"{self.width} x {self.height}")
        if not (math.isfinite(self.origin_lat) and math.isfinite(self.origin_lon)):
            raise GridError("non_finite_origin", f"{self.origin_lat}, {self.origin_lon}")
        if not -90 <= self.origin_lat <= 90:
            raise GridError("origin_lat_out_of_range", f"{self.origin_lat}")
        if not (math.isfinite(self.lon_step) and math.isfinite(self.lat_step)):
            raise GridError("non_finite_step", f"{self.lon_step}, {self.lat_step}")
        if self.lon_step == 0 or self.lat_step == 0:
            raise GridError("zero_step", f"{self.lon_step}, {self.lat_step}")
        if self.lat_step > 0:
            raise GridError("lat_step_not_southward", f"{self.lat_step}")
        if self.origin_lat + self.height * self.lat_step < -90 - TOLERANCE_DEG:
            raise GridError("runs_past_south_pole", f"{self.origin_lat + self.height * self.lat_step}")
        if self.width * abs(self.lon_step) > 360 + TOLERANCE_DEG:
            raise GridError("runs_past_a_full_turn", f"{self.width * abs(self.lon_step)}")
        object.__setattr__(self, "origin_lon", geodesy.wrap_lon_at(self.origin_lon))

    @classmethod
    def globe(cls, width: int, height: int) -> Grid:
        return cls(width, height, 90.0, -180.0, 360.0 / width, -180.0 / height)

    # Driver-side scalars.

    @property
    def spans_full_turn(self) -> bool:
        return abs(self.width * abs(self.lon_step) - 360.0) <= TOLERANCE_DEG

    @property
    def middle_row(self) -> int:
        return self.height // 2

    def row(self, index: int) -> int | None:
        return index if 0 <= index < self.height else None

    def col(self, index: int) -> int | None:
        return index if 0 <= index < self.width else None

    def centre_lat_at(self, row: int) -> float:
        return self.origin_lat + (row + 0.5) * self.lat_step

    def centre_lon_at(self, col: int) -> float:
        return self.origin_lon + (col + 0.5) * self.lon_step

    def col_along(self, col: int, cells: int) -> int:
        """``cells`` columns further, round the seam."""
        return (col + cells) % self.width

    def cell_containing(self, lat: float, lon: float) -> tuple[int, int] | None:
        if not (math.isfinite(lat) and math.isfinite(lon)):
            return None
        row = math.floor((lat - self.origin_lat) / self.lat_step)
        turn = float(self.width) if self.spans_full_turn else 360.0 / abs(self.lon_step)
        along = math.fmod((lon - self.origin_lon) / self.lon_step, turn)
        col = math.floor(along + turn if along < 0 else along)
        return (row, col) if 0 <= row < self.height and 0 <= col < self.width else None

    def cell_area_km2_at(self, row: int) -> float:
        north = self.origin_lat + row * self.lat_step
        return geodesy.zone_area_km2_at(north, self.origin_lat + (row + 1) * self.lat_step, abs(self.lon_step))

    def covering(self, window: Window) -> tuple[tuple[int, int], ColSpan] | None:
        """(row band, column span) of a window's cells, or None where a corner lies off the grid."""
        nw, se = self.cell_containing(window.north, window.west), self.cell_containing(window.south, window.east)
        if nw is None or se is None:
            return None
        band = (min(nw[0], se[0]), max(nw[0], se[0]))
        if window.east - window.west >= 360.0 - TOLERANCE_DEG:
            return band, ColSpan(0, self.width - 1, True)
        west, east = (nw[1], se[1]) if self.lon_step > 0 else (se[1], nw[1])
        return band, ColSpan(west, east)

    def whole(self) -> tuple[tuple[int, int], ColSpan]:
        return (0, self.height - 1), ColSpan(0, self.width - 1, True)

    def decimated(self, factor: int) -> Grid:
        if factor < 1 or self.width % factor or self.height % factor:
            raise DecimationError(f"{factor} does not divide {self.width} x {self.height}")
        return replace(self, width=self.width // factor, height=self.height // factor, lon_step=self.lon_step * factor, lat_step=self.lat_step * factor)

    def require_closed(self) -> None:
        if not self.spans_full_turn:
            raise KernelError(f"columns span {self.width * abs(self.lon_step)} degrees and don't close; no disc has a kernel here")

    # Column expressions.

    def col_further(self, col: Column, cells: Column) -> Column:
        """``col_along`` as an expression."""
        return F.pmod(col + cells, F.lit(self.width)).cast("int")

    def centre_lat(self, row: Column) -> Column:
        return self.origin_lat + (row + 0.5) * self.lat_step

    def centre_lon(self, col: Column) -> Column:
        return geodesy.wrap_lon(self.origin_lon + (col + 0.5) * self.lon_step)

    def lat_bounds(self, row: Column) -> tuple[Column, Column]:
        """(north, south)"""
        return self.origin_lat + row * self.lat_step, self.origin_lat + (row + 1) * self.lat_step

    def lon_bounds(self, col: Column) -> tuple[Column, Column]:
        """(west, east), either step direction."""
        a, b = self.origin_lon + col * self.lon_step, self.origin_lon + (col + 1) * self.lon_step
        return F.least(a, b), F.greatest(a, b)

    def cell_row(self, lat: Column) -> Column:
        """The row of a latitude; null off the grid."""
        at = F.floor((lat - self.origin_lat) / self.lat_step)
        return F.when(~F.isnan(lat) & at.between(0, self.height - 1), at.cast("int"))

    def cell_col(self, lon: Column) -> Column:
        turn = float(self.width) if self.spans_full_turn else 360.0 / abs(self.lon_step)
        at = F.floor(F.pmod((lon - self.origin_lon) / self.lon_step, F.lit(turn)))
        return F.when(~F.isnan(lon) & (F.abs(lon) < float("inf")) & at.between(0, self.width - 1), at.cast("int"))

    def cell_of(self, lat: Column, lon: Column) -> Column:
        """struct(row, col) of the cell that holds a coordinate; null off the grid or for a coordinate that is none."""
        row, col = self.cell_row(lat), self.cell_col(lon)
        return F.when(row.isNotNull() & col.isNotNull(), F.struct(row.alias("row"), col.alias("col")))

    def cell_area_km2(self, row: Column) -> Column:
        north, south = self.lat_bounds(row)
        return geodesy.zone_area_km2(north, south, F.lit(abs(self.lon_step)))

    def cells(self, spark: SparkSession) -> DataFrame:
        """(row, col) of every cell."""
        return spark.range(self.width * self.height).select(F.expr(f"cast(id div {self.width} as int)").alias("row"), F.expr(f"cast(id % {self.width} as int)").alias("col"))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.height).select(F.col("id").cast("int").alias("row"))

    def describe(self) -> dict:
        """The grid's summary as results carry it."""
        return {
            "width": self.width,
            "height": self.height,
            "origin": {"lat": self.origin_lat, "lon": self.origin_lon},
            "lon_step": self.lon_step,
            "lat_step": self.lat_step,
            "spans_full_turn": self.spans_full_turn,
            "middle_row_cell_area_km2": self.cell_area_km2_at(self.middle_row),
        }
