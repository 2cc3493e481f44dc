"""Summed-area tables: prefix sums, rectangles, decimation, digests, and their publication under an identity.

Three shapes of one thing: ``sat(r, c, v)`` is the padded two-dimensional table; ``row_prefix(row, prefix)`` holds for each raster row the
running sums along it, which is all that discs need; ``cells(row, col, value)`` is the cleaned raster.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessarion.functions import geodesy
from tessarion.functions.sums import running
from tessarion.plans.grid import TOLERANCE_DEG, ColSpan, Grid

TABLE_FORMAT = 1


class TableError(ValueError):
    """``kind``: window_off_grid, or what a table lacks."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


class CacheError(ValueError):
    """A published table that can't be used; ``kind``: absent, format, not_this_table, incomplete."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


def row_prefix(cells: DataFrame, grid: Grid) -> DataFrame:
    """(row, prefix array of width + 1 doubles), prefix[c] being the sum strictly west of column c."""
    west = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("row", "col", F.sum("value").over(west).alias("v"))
    packed = sums.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("p"))
    return packed.select("row", F.concat(F.array(F.lit(0.0)), "p").alias("prefix"))


def sat(cells: DataFrame, grid: Grid) -> DataFrame:
    """The padded table: v at (r, c) is the sum of the cells strictly north of r and strictly west of c."""
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    body = cells.select("row", "col", F.sum("value").over(along).alias("v"))
    body = body.select((F.col("row") + 1).alias("r"), (F.col("col") + 1).alias("c"), "v")
    body = body.select("r", "c", F.sum("v").over(down).alias("v"))
    spark = cells.sparkSession
    top = spark.range(grid.width + 1).select(F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.lit(0.0).alias("v"))
    side = spark.range(1, grid.height + 1).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("v"))
    return body.union(top).union(side)


def corners(band: tuple[int, int], span: ColSpan, width: int) -> list[tuple[int, int, int]]:
    """(r, c, weight) whose weighted table values add up to the rectangle: four for each span that doesn't wrap."""
    north, south = min(band), max(band)
    return [x for w, e in span.ranges(width) for x in ((south + 1, e + 1, 1), (north, e + 1, -1), (south + 1, w, -1), (north, w, 1))]


def rectangle(table: DataFrame, grid: Grid, band: tuple[int, int], span: ColSpan) -> DataFrame:
    """One row: the population of a rectangle, from the table's corners alone (at most eight rows of it are read)."""
    wanted = corners(band, span, grid.width)
    at = None
    for r, c, w in wanted:
        this = F.when((F.col("r") == r) & (F.col("c") == c), F.lit(float(w))).otherwise(0.0)
        at = this if at is None else at + this
    there = F.col("r").isin(sorted({x[0] for x in wanted})) & F.col("c").isin(sorted({x[1] for x in wanted}))
    return table.where(there).agg(F.coalesce(F.sum(F.col("v") * at), F.lit(0.0)).alias("population"))


def rectangles(prefix: DataFrame, rects: DataFrame) -> DataFrame:
    """(id, population) of many rectangles ``rects(id, north, south, west, east)`` that don't wrap, one row of ``prefix`` a join key."""
    rows = rects.select("id", "west", "east", F.explode(F.sequence("north", "south")).alias("row"))
    piece = F.element_at("prefix", F.col("east") + 2) - F.element_at("prefix", F.col("west") + 1)
    return rows.join(prefix, "row").groupBy("id").agg(F.sum(piece).alias("population"))


def in_rectangle(band: tuple[int, int], span: ColSpan) -> Column:
    """The predicate of a rectangle on (row, col)."""
    rows = F.col("row").between(min(band), max(band))
    if span.full_turn:
        return rows
    if span.west <= span.east:
        return rows & F.col("col").between(span.west, span.east)
    return rows & ((F.col("col") >= span.west) | (F.col("col") <= span.east))


def decimate(cells: DataFrame, factor: int) -> DataFrame:
    """Cells of the coarser grid: sums of factor x factor blocks."""
    return cells.groupBy(F.expr(f"row div {factor}").cast("int").alias("row"), F.expr(f"col div {factor}").cast("int").alias("col")).agg(F.sum("value").alias("value"))


def decimate_sat(table: DataFrame, factor: int) -> DataFrame:
    """The coarser grid's table: every factor-th row and column of the finer one."""
    keep = (F.col("r") % factor == 0) & (F.col("c") % factor == 0)
    return table.where(keep).select(F.expr(f"r div {factor}").cast("int").alias("r"), F.expr(f"c div {factor}").cast("int").alias("c"), "v")


def exact_total(cells: DataFrame) -> float:
    """The total, each row's sum exact: one correctly rounded number for each row, added with compensation on the driver."""

    def by_row(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame({"row": [key[0]], "s": [math.fsum(pdf["value"])]})

    return math.fsum(r["s"] for r in cells.groupBy("row").applyInPandas(by_row, "row int, s double").toLocalIterator())


#: Parameters of the 64-bit FNV-1a hash (fixed values).
FNV_SEED, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv_digest(clean: DataFrame) -> str:
    """The order-dependent digest of cleaned cells: the bits of each 32-bit value, one word at a time, in row-major order. It is serial
    by definition: rows stream through the driver one partition at a time. ``parallel_digest`` is the one for large rasters."""
    state = FNV_SEED
    for r in clean.orderBy("row", "col").select(F.col("value").cast("float").alias("value")).toLocalIterator(prefetchPartitions=True):
        state = ((state ^ struct.unpack("<I", struct.pack("<f", r["value"]))[0]) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return hexadecimal(state)


def pack_rows(cells: DataFrame) -> DataFrame:
    """(row, values array<float>) of raw cells."""
    return cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("values"))


_TALLIES = ("nodata", "unexpected_negative", "zero", "populated")
_SUMMED = "row int, prefix array<double>, nodata long, unexpected_negative long, zero long, populated long, hx long, hs long"


def prefix_rows(rows: DataFrame, grid: Grid, factor: int = 1, nodata: float | None = None) -> DataFrame:
    """One pass over packed raster rows: the row prefixes of the (decimated) grid, with the tallies of the raw cells and two order-free
    combinations of the raw rows' hashes. Rows stand alone, so undecimated ones are never shuffled; a decimated row gathers ``factor``."""
    from tessarion.sources import raster

    nodata = raster.NODATA if nodata is None else nodata
    coarse = grid.decimated(factor)

    def batch(rows: list, sums: list, counts: list, hashes: list) -> pa.RecordBatch:
        cols = [pa.array(rows, pa.int32()), pa.array(sums, pa.list_(pa.float64())), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), *(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _SUMMED.split(", ")])

    def scan(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k in range(0, b.num_rows, 64):
                at, sums, counts, hashes = [], [], [], []
                for row, v in zip(b.column("row").slice(k, 64).to_pylist(), b.column("values").slice(k, 64)):
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32)
                    if len(x) != grid.width or not 0 <= row < grid.height:
                        raise ValueError(f"row {row} holds {len(x)} cells of {grid.width}")
                    none = np.isnan(x) if math.isnan(nodata) else x == np.float32(nodata)
                    good = ~none & (x > 0)
                    below = ~none & (x < 0)
                    clean = np.where(good, x, 0).astype(np.float64)
                    counts.append((int(none.sum()), int(below.sum()), int(grid.width - none.sum() - below.sum() - good.sum()), int(good.sum())))
                    h = int.from_bytes(hashlib.blake2b(clean.astype("<f4").tobytes(), digest_size=8, key=row.to_bytes(8, "little")).digest(), "little", signed=True)
                    hashes.append((h, h))
                    at.append(row)
                    sums.append(clean.reshape(-1, factor).sum(axis=1) if factor > 1 else np.concatenate([[0.0], running(clean)]))
                yield batch(at, sums, counts, hashes)

    scanned = rows.select("row", "values").mapInArrow(scan, _SUMMED)
    if factor == 1:
        return scanned

    def gather(key, t):  # noqa: ANN001, ANN202
        if t.num_rows != factor:
            raise ValueError(f"{t.num_rows} raster rows of {factor} for row {key[0]}")
        order = np.argsort(t.column("row").to_numpy())
        total = np.zeros(coarse.width)
        for i in order:
            total += t.column("prefix")[int(i)].values.to_numpy()
        counts = [tuple(int(t.column(c).to_numpy().sum()) for c in _TALLIES)]
        hashes = [(int(np.bitwise_xor.reduce(t.column("hx").to_numpy())), int(np.add.reduce(t.column("hs").to_numpy())))]
        return pa.Table.from_batches([batch([key[0].as_py()], [np.concatenate([[0.0], running(total)])], counts, hashes)])

    return scanned.groupBy(F.expr(f"row div {factor}").cast("int").alias("coarse")).applyInArrow(gather, _SUMMED)


def digest_of_rows() -> Column:
    """The aggregate that names a raster: an order-free digest of its cleaned rows, whatever the decimation."""
    both = F.concat_ws(":", F.bit_xor("hx").cast("string"), F.pmod(F.sum(F.col("hs").cast("decimal(38,0)")), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("string"))
    return F.concat(F.lit("0x"), F.substring(F.sha2(both, 256), 1, 16))


def parallel_digest(cells_raw: DataFrame, grid: Grid) -> str:
    return prefix_rows(pack_rows(cells_raw), grid).agg(digest_of_rows().alias("d")).first()[0]


def hexadecimal(value: int) -> str:
    return f"0x{value & 0xFFFFFFFFFFFFFFFF:016x}"


def hexadecimal_of(value: Column) -> Column:
    """``hexadecimal`` of a long, as an expression."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 16, "0"))


def parse_digest(text: str) -> int:
    digits = text[2:] if text[:2].lower() == "0x" else text
    if len(digits) != 16 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError(f"a digest is sixteen hexadecimal digits: {text!r}")
    return int(digits, 16)


@dataclass(frozen=True)
class Identity:
    """What a table, or a ledger of radii, was made from."""

    digest: str
    decimation: int
    grid: Grid

    def fields(self) -> dict:
        g = self.grid
        return {"digest": self.digest, "width": g.width, "height": g.height, "decimation": self.decimation, "origin_lat": g.origin_lat, "origin_lon": g.origin_lon, "lon_step": g.lon_step, "lat_step": g.lat_step}

    def mismatch(self, other: dict) -> str | None:
        """The first field in which ``other`` differs, or None."""
        own = self.fields()
        for name, value in own.items():
            found = other.get(name)
            if name in ("digest", "width", "height", "decimation"):
                if found != value:
                    return name
            elif name == "origin_lon":
                if found is None or abs(geodesy.wrap_lon_at(found - value)) > TOLERANCE_DEG:
                    return name
            elif found is None or not abs(found - value) <= TOLERANCE_DEG:
                return name
        return None


def first_mismatch(have: DataFrame, want: Identity) -> DataFrame:
    """``have`` (the identity columns) with ``reason``: the first field that differs from ``want``, null where none does."""
    reason = None
    for name, value in reversed(list(want.fields().items())):
        c = F.col(name)
        if name in ("digest", "width", "height", "decimation"):
            differs = ~c.eqNullSafe(F.lit(value))
        elif name == "origin_lon":
            differs = F.coalesce(F.abs(geodesy.wrap_lon(c - value)) > TOLERANCE_DEG, F.lit(True))
        else:
            differs = F.coalesce(F.abs(c - value) > TOLERANCE_DEG, F.lit(True))
        reason = F.when(differs, F.lit(name)).otherwise(F.lit(None).cast("string") if reason is None else reason)
    return have.withColumn("reason", reason)


@dataclass(frozen=True)
class Built:
    identity: Identity
    total: float
    tallies: dict
    path: str = ""
    files: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # no side files next to documents that people may edit
    fs.setVerifyChecksum(False)
    return fs, where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place with one rename; a temporary one that is already there is refused, not overwritten."""
    fs, where = _fs(spark, path)
    held = where.suffix(".tmp")
    if fs.exists(held):
        raise CacheError("temporary_held", f"{held}: another run publishes this, or one was interrupted; remove it to go on")
    out = fs.create(held, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(held, where):
        raise CacheError("write", path)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def publish(rows: DataFrame, grid: Grid, path: str, decimation: int = 1, nodata: float | None = None) -> Built:
    """Clean, decimate and publish packed raster rows under ``path``: data first, then ``identity.json`` as the commit mark."""
    coarse = grid.decimated(decimation)
    spark = rows.sparkSession
    prefix_rows(rows, grid, decimation, nodata).sortWithinPartitions("row").write.mode("errorifexists").parquet(f"{path}/rows")
    made = spark.read.parquet(f"{path}/rows")
    facts = made.agg(digest_of_rows().alias("digest"), F.count("*").alias("n"), F.countDistinct("row").alias("distinct"), F.sum(F.element_at("prefix", -1)).alias("total"), *[F.sum(c).alias(c) for c in _TALLIES]).first()
    if not facts["n"] == facts["distinct"] == coarse.height:
        raise CacheError("incomplete", f"{facts['n']} rows for a grid of {coarse.width} x {coarse.height}")
    counts = {c: facts[c] for c in _TALLIES}
    counts["total"] = sum(counts.values())
    identity = Identity(facts["digest"], decimation, coarse)
    header = {"format": TABLE_FORMAT, **identity.fields(), "total": facts["total"], "tallies": counts}
    write_text(spark, f"{path}/identity.json", json.dumps(header))
    return Built(identity, facts["total"], counts, path, {"header": f"{path}/identity.json", "payload": f"{path}/rows"})


def open_table(spark: SparkSession, path: str, want: Identity) -> DataFrame:
    """The row prefixes of a published table, or a refusal that names the field that differs."""
    text = read_text(spark, f"{path}/identity.json")
    if text is None:
        raise CacheError("absent", f"no table at {path}")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise CacheError("syntax", path) from e
    if found.get("format") != TABLE_FORMAT:
        raise CacheError("format", f"this build reads format {TABLE_FORMAT}, the table has {found.get('format')}")
    if (name := want.mismatch(found)) is not None:
        raise CacheError("not_this_table", f"{name} is {found.get(name)}, wanted {want.fields()[name]}")
    return spark.read.schema("row int, prefix array<double>").parquet(f"{path}/rows")


def grid_of(fields: dict) -> Grid:
    return Grid(fields["width"], fields["height"], fields["origin_lat"], fields["origin_lon"], fields["lon_step"], fields["lat_step"])

