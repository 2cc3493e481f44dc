"""Searches over a table that is small enough to be sent to every executor: one task searches one radius.

The row prefixes are a matrix of at most ``disc.BROADCAST_BYTES``, a size known from the grid before anything runs. A disc costs two reads a
row, all rows at once; kernels are those of ``disc.kernels``, in numpy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from tessarion.functions.geodesy import EARTH_RADIUS_KM
from tessarion.plans.grid import Grid


class HeldTable:
    """Row prefixes as a matrix of height x (width + 1)."""

    def __init__(self, prefix: np.ndarray, grid: Grid) -> None:
        self.prefix, self.grid = prefix, grid
        self.lat = grid.origin_lat + (np.arange(grid.height) + 0.5) * grid.lat_step
        self.held: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, prefix: DataFrame, grid: Grid) -> HeldTable:
        """Gathers the prefixes; for grids within the bound only."""
        table = prefix.select("row", "prefix").toArrow()
        out = np.zeros((grid.height, grid.width + 1))
        values = table.column("prefix").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, grid.width + 1)
        out[table.column("row").to_numpy()] = values
        return cls(out, grid)

    def kernel(self, row: int, km: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, half widths) of a disc round a cell of ``row``; the last few are kept."""
        key = (row, km)
        if (found := self.held.get(key)) is not None:
            return found
        g, angle = self.grid, min(km / EARTH_RADIUS_KM, math.pi)
        closing = g.width // 2
        reach = int(min(float(g.height), math.degrees(angle) / abs(g.lat_step) + 2))
        rows = np.arange(max(0, row - reach), min(g.height - 1, row + reach) + 1)
        lat0, lat = self.lat[row], self.lat[rows]
        up = np.sin(np.radians(lat - lat0) / 2) ** 2
        both = math.cos(math.radians(lat0)) * np.cos(np.radians(lat))

        def inside(cells: np.ndarray | int, at: slice | np.ndarray) -> np.ndarray:
            along = np.sin(np.radians(cells * g.lon_step) / 2)
            h = np.clip(up[at] + both[at] * along * along, 0.0, 1.0)
            return 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= angle

        at = np.flatnonzero(inside(0, slice(None)))
        ratio = (math.cos(angle) - math.sin(math.radians(lat0)) * np.sin(np.radians(lat[at]))) / both[at]
        cells = np.degrees(np.arccos(np.clip(ratio, -1, 1))) / abs(g.lon_step)
        estimate = np.where(ratio >= 1, 0, np.where(ratio <= -1, closing, np.minimum(cells, closing))).astype(np.int64)
        half, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for step in (2, 1, 0, -1, -2):
            guess = estimate + step
            hit = open_ & (guess >= 0) & (guess <= closing) & inside(guess, at)
            half[hit] = guess[hit]
            open_ &= ~hit
        if len(self.held) > 64:
            self.held.clear()
        self.held[key] = rows[at], half
        return self.held[key]

    def populations(self, row: int, cols: np.ndarray, km: float) -> np.ndarray:
        """Of the discs of one radius round cells of one row: one kernel for all, rows added in extended precision."""
        rows, half = self.kernel(row, km)
        w, p = self.grid.width, self.prefix
        out = np.empty(len(cols))
        each = max(1, 2_000_000 // max(1, len(rows)))
        for k in range(0, len(cols), each):
            at = cols[k : k + each, None]
            west, east = (at - half) % w, (at + half) % w
            span = p[rows, east + 1] - p[rows, west]
            whole = p[rows, w]
            out[k : k + each] = np.where(half == w // 2, whole, np.where(west <= east, span, whole + span)).sum(axis=1, dtype=np.longdouble)
        return out

    def population(self, row: int, col: int, km: float) -> float:
        return float(self.populations(row, np.array([col]), km)[0])
