"""The most populous disc of a radius, by branch and bound over blocks of candidate centres.

A block's bound is the population of the disc round its middle cell, widened by the block's slack; blocks whose bound is strictly below
the best disc found so far can't hold the answer. Blocks are taken a level at a time, in the order of their middle cells, so answers and
counters don't depend on where discs are evaluated.

A table within ``disc.BROADCAST_BYTES`` goes to every executor once, and a task searches a whole radius: several radii are a job. For a
larger table each level is a job, which evaluates the widened and the exact disc of every block by joins with the row prefixes; the driver
holds the blocks of a level (a few numbers each), never cells.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarion.functions.geodesy import RadiusKm
from tessarion.operators import disc
from tessarion.operators.held import HeldTable
from tessarion.plans.errors import BadInput
from tessarion.plans.grid import Grid
from tessarion.plans.progress import Progress, bracket, described

log = logging.getLogger(__name__)


@dataclass(frozen=True, order=True)
class Block:
    """A rectangle of candidate centres, bounds included."""

    north: int
    south: int
    first: int
    last: int

    @property
    def probe(self) -> tuple[int, int]:
        return self.north + (self.south - self.north) // 2, self.first + (self.last - self.first) // 2

    def split(self) -> list[Block]:
        """Up to four disjoint parts that cover it; none of a single cell."""
        if self.north == self.south and self.first == self.last:
            return []
        row, col = self.probe
        bands = [(self.north, row), (row + 1, self.south)] if self.north < self.south else [(self.north, self.south)]
        spans = [(self.first, col), (col + 1, self.last)] if self.first < self.last else [(self.first, self.last)]
        return [Block(n, s, f, e) for n, s in bands for f, e in spans]


def tile(grid: Grid, spacing: int) -> list[Block]:
    """Disjoint blocks of ``spacing`` cells a side that cover the grid; the last ones are short."""
    if spacing < 1:
        raise BadInput(f"a spacing is at least one cell: {spacing}")
    ends = lambda n: [(a, min(a + spacing, n) - 1) for a in range(0, n, spacing)]
    return [Block(n, s, f, e) for n, s in ends(grid.height) for f, e in ends(grid.width)]


@dataclass(frozen=True)
class Candidate:
    row: int
    col: int
    population: float

    def better(self, other: Candidate) -> Candidate:
        if other.population > self.population:
            return other
        if other.population < self.population:
            return self
        return min(self, other, key=lambda c: (c.row, c.col))


@dataclass
class SearchStats:
    levels: int = 0
    blocks_examined: int = 0
    blocks_pruned: int = 0
    circles_evaluated: int = 0
    kernels_built: int = 0

    def add(self, other: SearchStats) -> None:
        for k, v in vars(other).items():
            setattr(self, k, getattr(self, k) + v)


@dataclass(frozen=True)
class MostPopulous:
    centre: Candidate
    radius: RadiusKm
    stats: SearchStats
    tolerance_persons: float = 0.0


class Level:
    """The discs of a level's blocks, evaluated by one job."""

    def __init__(self, searcher: Searcher) -> None:
        self.searcher = searcher

    def begin(self, blocks: np.ndarray, radius: RadiusKm) -> None:
        values = self.searcher.evaluate([(Block(*b), radius) for b in blocks.tolist()])
        self.ceiling, self.exact = np.array(values).reshape(-1, 2).T

    def ceilings(self, at: np.ndarray, row: int, cols: np.ndarray, wide: np.ndarray) -> np.ndarray:
        return self.ceiling[at]

    def exacts(self, at: np.ndarray, row: int, cols: np.ndarray, radius: RadiusKm) -> np.ndarray:
        return self.exact[at]


class Held:
    """Discs evaluated when they are asked for, on a table at hand."""

    def __init__(self, table: HeldTable) -> None:
        self.table = table

    def begin(self, blocks: np.ndarray, radius: RadiusKm) -> None:
        pass

    def ceilings(self, at: np.ndarray, row: int, cols: np.ndarray, wide: np.ndarray) -> np.ndarray:
        out = np.empty(len(cols))
        for km in np.unique(wide):
            out[wide == km] = self.table.populations(row, cols[wide == km], float(km))
        return out

    def exacts(self, at: np.ndarray, row: int, cols: np.ndarray, radius: RadiusKm) -> np.ndarray:
        return self.table.populations(row, cols, radius.km)


def _tiles(grid: Grid, spacing: int) -> np.ndarray:
    """``tile`` as rows (north, south, first, last)."""
    north, first = np.arange(0, grid.height, spacing), np.arange(0, grid.width, spacing)
    n, f = (x.ravel() for x in np.meshgrid(north, first, indexing="ij"))
    return np.stack([n, np.minimum(n + spacing, grid.height) - 1, f, np.minimum(f + spacing, grid.width) - 1], axis=1)


def _split(blocks: np.ndarray) -> np.ndarray:
    """``Block.split`` of many (north, south, first, last)."""
    north, south, first, last = blocks.T
    row, col = north + (south - north) // 2, first + (last - first) // 2
    parts = []
    for n, s, tall in ((north, row, None), (row + 1, south, south > north)):
        for f, e, broad in ((first, col, None), (col + 1, last, last > first)):
            keep = (south > north) | (last > first)
            for more in (tall, broad):
                keep = keep if more is None else keep & more
            parts.append(np.stack([n, s, f, e], axis=1)[keep])
    return np.concatenate(parts)


def descend(grid: Grid, radius: RadiusKm, spacing: int, discs: Level | Held, progress: Progress | None = None) -> MostPopulous:
    """The search itself: levels of blocks, pruned and split, until none is left.

    Blocks are taken in the order of their middle cells, those of one row together. A block is pruned if its bound is below the best exact
    disc among all blocks before it; as no exact disc exceeds its bound, that is the running maximum over the row, pruned blocks and all.
    """
    level = _tiles(grid, spacing)
    best: Candidate | None = None
    stats = SearchStats()
    seed = (grid.middle_row, radius.km)
    wide_held, exact_held, built = seed, seed, 2
    while len(level):
        rows, cols = level[:, 0] + (level[:, 1] - level[:, 0]) // 2, level[:, 2] + (level[:, 3] - level[:, 2]) // 2
        order = np.lexsort((cols, rows))
        level, rows, cols = level[order], rows[order], cols[order]
        wide = np.maximum(radius.km, radius.km + disc.slacks_km(grid, level))
        stats.levels += 1
        with bracket(f"level {stats.levels}"):
            discs.begin(level, radius)
        stays = np.zeros(len(level), bool)
        names, begins = np.unique(rows, return_index=True)
        for row, lo, hi in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            at, w = np.arange(lo, hi), wide[lo:hi]
            ceiling = discs.ceilings(at, row, cols[lo:hi], w)
            least = -np.inf if best is None else best.population
            open_ = ceiling >= least
            exact = np.full(hi - lo, -np.inf)
            exact[open_] = np.minimum(discs.exacts(at[open_], row, cols[lo:hi][open_], radius), ceiling[open_])
            before = np.maximum(np.concatenate([[least], np.maximum.accumulate(exact)[:-1]]), least)
            kept = ceiling >= before
            built += (row, float(w[0])) != wide_held
            built += int((w[1:] != w[:-1]).sum())
            wide_held = (row, float(w[-1]))
            stats.blocks_examined += hi - lo
            stats.blocks_pruned += int((~kept).sum())
            stats.circles_evaluated += int(kept.sum())
            if kept.any():
                built += (row, radius.km) != exact_held
                exact_held = (row, radius.km)
                top = int(np.argmax(np.where(kept, exact, -np.inf)))
                here = Candidate(row, int(cols[lo + top]), float(exact[top]))
                best = here if best is None else best.better(here)
            stays[lo:hi] = kept
            if progress:
                progress.advance(hi, len(level))
        level = _split(level[stays])
    stats.kernels_built = built
    assert best is not None  # a grid has a cell, and the first block is never pruned
    return MostPopulous(best, radius, stats)


_FOUND = "km double, row int, col int, population double, levels int, blocks_examined int, blocks_pruned int, circles_evaluated int, kernels_built int"
_ARROW = {"int": pa.int32(), "double": pa.float64()}
_FOUND_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _FOUND.split(", "))])


@dataclass
class Searcher:
    """Searches over one table; what was found is kept by spacing and radius."""

    prefix: DataFrame
    grid: Grid
    bound_bytes: int = disc.BROADCAST_BYTES
    found: dict[tuple[int, float], MostPopulous] = field(default_factory=dict)
    _sent: object = None

    @property
    def sends(self) -> bool:
        """Whether the table goes to the executors whole."""
        return self.grid.height * (self.grid.width + 1) * 8 <= self.bound_bytes

    def evaluate(self, wanted: list[tuple[Block, RadiusKm]]) -> list[tuple[float, float]]:
        """(bound, exact population) of each block at its radius, in one job."""
        rows = []
        for k, (b, radius) in enumerate(wanted):
            row, col = b.probe
            wide = radius.widened_by(disc.slack_km(self.grid, b.north, b.south, b.first, b.last))
            rows += [(2 * k, row, col, wide.km), (2 * k + 1, row, col, radius.km)]
        import pandas as pd

        centres = self.prefix.sparkSession.createDataFrame(
            pd.DataFrame(rows, columns=["id", "centre_row", "centre_col", "radius_km"]), "id int, centre_row int, centre_col int, radius_km double"
        )
        out = [0.0] * len(rows)
        with described(self.prefix.sparkSession, f"{len(wanted)} blocks of a level"):
            got = disc.populations(self.prefix, self.grid, centres).toPandas()
        for i, p in zip(got["id"].to_numpy(), got["population"].to_numpy()):
            out[i] = float(p)
        return list(zip(out[::2], out[1::2]))

    def prepare(self, radii: list[RadiusKm], spacing: int) -> None:
        """Search several radii in one job, a task each, where the table is sent."""
        fresh = sorted({r.km for r in radii if (spacing, r.km) not in self.found})
        if not fresh or not self.sends:
            return
        self.grid.require_closed()
        spark, grid = self.prefix.sparkSession, self.grid
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(HeldTable.of(self.prefix, grid))
        sent = self._sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for km in b.column("km").to_pylist():
                    got = descend(grid, RadiusKm(km), spacing, Held(sent.value))
                    rows.append({"km": km, "row": got.centre.row, "col": got.centre.col, "population": got.centre.population, **vars(got.stats)})
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

        # Wide discs take longest: a task a radius, the widest first.
        order = F.array(*[F.lit(km) for km in reversed(fresh)])
        todo = spark.range(0, len(fresh), 1, len(fresh)).select(F.element_at(order, (F.col("id") + 1).cast("int")).alias("km"))
        with described(spark, f"search of {len(fresh)} radii from {fresh[0]:g} to {fresh[-1]:g} km"):
            rows = todo.mapInArrow(run, _FOUND).collect()  # one row a radius
        for r in rows:
            stats = SearchStats(r["levels"], r["blocks_examined"], r["blocks_pruned"], r["circles_evaluated"], r["kernels_built"])
            self.found[spacing, r["km"]] = MostPopulous(Candidate(r["row"], r["col"], r["population"]), RadiusKm(r["km"]), stats)

    def most_populous(self, radius: RadiusKm, spacing: int, progress: Progress | None = None) -> MostPopulous:
        self.grid.require_closed()
        if spacing < 1:
            raise BadInput(f"a spacing is at least one cell: {spacing}")
        self.prepare([radius], spacing)
        if (spacing, radius.km) not in self.found:
            self.found[spacing, radius.km] = descend(self.grid, radius, spacing, Level(self), progress)
        return self.found[spacing, radius.km]
