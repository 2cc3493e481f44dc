"""GeoTIFF rasters as a Python data source: one partition for each run of strips, one row for each raster row.

The raster's grid, EPSG code and nodata value are declared; a file that says otherwise is refused before any cell is read. Strips of
32-bit floats, uncompressed or LZW, little or big endian, classic or big TIFF.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessarion.functions.geodesy import wrap_lon_at
from tessarion.plans.grid import TOLERANCE_DEG, Grid
from tessarion.sources import raster
from tessarion.sources.raster import RasterError

#: Tags and keys of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, SAMPLE_FORMAT = 317, 322, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, GDAL_NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_TYPE = 1024, 1025, 2048
_FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


@dataclass(frozen=True)
class RasterSpec:
    """What a file must say."""

    width: int
    height: int
    origin_lat: float
    origin_lon: float
    lon_step: float
    lat_step: float
    epsg: int = 4326
    nodata: float = raster.NODATA

    @classmethod
    def of(cls, grid: Grid, epsg: int = 4326, nodata: float = raster.NODATA) -> RasterSpec:
        return cls(grid.width, grid.height, grid.origin_lat, grid.origin_lon, grid.lon_step, grid.lat_step, epsg, nodata)


def _open(path: str):  # noqa: ANN202
    fs, at = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    try:
        return fs.open_input_file(at)
    except FileNotFoundError as e:
        raise RasterError("absent", path) from e
    except OSError as e:
        raise RasterError("read", str(e)) from e


class Tiff:
    """The first directory of a TIFF file."""

    def __init__(self, file) -> None:  # noqa: ANN001
        head = file.read_at(16, 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or len(head) < 8:
            raise RasterError("decode", "not a TIFF file")
        magic = self._get("H", head, 2)[0]
        if magic == 42:
            at, wide = self._get("I", head, 4)[0], False
        elif magic == 43:
            at, wide = self._get("Q", head, 8)[0], True
        else:
            raise RasterError("decode", f"not a TIFF file: {magic}")
        try:
            self.tags = self._directory(file, at, wide)
        except struct.error as e:
            raise RasterError("decode", "the directory is cut short") from e

    def _get(self, kind: str, data: bytes, at: int = 0, n: int = 1) -> tuple:
        return struct.unpack_from(f"{self.order}{n}{kind}", data, at)

    def _directory(self, file, at: int, wide: bool) -> dict[int, tuple]:  # noqa: ANN001
        count, size, word = ("Q", 20, "Q") if wide else ("H", 12, "I")
        n = self._get(count, file.read_at(8, at))[0]
        data = file.read_at(n * size, at + struct.calcsize("=" + count))
        tags = {}
        for k in range(n):
            tag, kind = self._get("H", data, k * size, 2)
            length = self._get(word, data, k * size + 4)[0]
            if kind not in _FORMATS:
                continue
            held = struct.calcsize("=" + word)
            total = length * struct.calcsize("=" + _FORMATS[kind])
            spot = k * size + 4 + held
            raw = data[spot : spot + total] if total <= held else file.read_at(total, self._get(word, data, spot)[0])
            tags[tag] = (raw[:length].rstrip(b"\0").decode("latin-1"),) if kind == 2 else self._get(_FORMATS[kind], raw, 0, length)
        return tags

    def one(self, tag: int, default: int | None = None, name: str = "") -> int:
        if tag not in self.tags:
            if default is None:
                raise RasterError("missing_tag", f"{name or tag}")
            return default
        return self.tags[tag][0]

    def geo_key(self, key: int, name: str) -> int:
        entries = self.tags.get(GEO_KEYS)
        if entries is None:
            raise RasterError("missing_tag", "GeoKeyDirectory")
        for k in range(4, len(entries) - 3, 4):
            if entries[k] == key and entries[k + 1] == 0:
                return entries[k + 3]
        raise RasterError("missing_geo_key", name)


def validate(t: Tiff, spec: RasterSpec) -> None:
    """Every rule a file must meet, in order; the first that fails is the refusal."""
    if TILE_WIDTH in t.tags:
        raise RasterError("layout", "tiles, not strips")
    if t.one(SAMPLES, 1) != 1:
        raise RasterError("samples_per_pixel", str(t.one(SAMPLES)))
    if t.one(SAMPLE_FORMAT, 1) != 3 or t.one(BITS, 1) != 32:
        raise RasterError("pixel_format", f"format {t.one(SAMPLE_FORMAT, 1)} of {t.one(BITS, 1)} bits")
    if (model := t.geo_key(MODEL_TYPE, "GTModelType")) != 2:
        raise RasterError("model_type", str(model))
    if (kind := t.geo_key(RASTER_TYPE, "GTRasterType")) != 1:
        raise RasterError("raster_type", str(kind))
    if (epsg := t.geo_key(GEOGRAPHIC_TYPE, "GeographicType")) != spec.epsg:
        raise RasterError("epsg", f"{epsg}, declared {spec.epsg}")
    if GDAL_NODATA not in t.tags:
        raise RasterError("nodata_missing", f"declared {spec.nodata}")
    text = t.tags[GDAL_NODATA][0].strip()
    try:
        found = float(text)
    except ValueError as e:
        raise RasterError("nodata_not_a_number", text) from e
    if not raster.same_bits(found, spec.nodata):
        raise RasterError("nodata_mismatch", f"{text}, declared {spec.nodata}")
    if (t.one(WIDTH, None, "ImageWidth"), t.one(HEIGHT, None, "ImageLength")) != (spec.width, spec.height):
        raise RasterError("dimensions", f"{t.one(WIDTH)} x {t.one(HEIGHT)}, declared {spec.width} x {spec.height}")
    if TRANSFORMATION in t.tags:
        raise RasterError("transformation", "a model transformation isn't read")
    for tag, name in ((PIXEL_SCALE, "ModelPixelScale"), (TIEPOINT, "ModelTiepoint")):
        if tag not in t.tags:
            raise RasterError("missing_tag", name)
    lon_step, lat_step = t.tags[PIXEL_SCALE][0], -t.tags[PIXEL_SCALE][1]
    if not (abs(lon_step - spec.lon_step) <= TOLERANCE_DEG and abs(lat_step - spec.lat_step) <= TOLERANCE_DEG):
        raise RasterError("step", f"{lon_step}, {lat_step}")
    i, j, _, lon, lat = t.tags[TIEPOINT][:5]
    lon, lat = lon - i * lon_step, lat - j * lat_step  # walked back to the first cell's corner
    if not (abs(lat - spec.origin_lat) <= TOLERANCE_DEG and abs(wrap_lon_at(lon - spec.origin_lon)) <= TOLERANCE_DEG):
        raise RasterError("origin", f"{lat}, {lon}")
    if t.one(COMPRESSION, 1) not in (1, 5):
        raise RasterError("decode", f"compression {t.one(COMPRESSION)} isn't read")
    if t.one(PREDICTOR, 1) != 1:
        raise RasterError("decode", f"predictor {t.one(PREDICTOR)} isn't read")


def unlzw(data: bytes, most: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widths rising one code early."""
    out, size = [], 0
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, None
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
            width, last = 9, None
            continue
        if code == 257 or size >= most:
            break
        if last is None:
            if code > 255:
                raise RasterError("decode", "LZW data begin amiss")
            piece = table[code] if table else bytes([code])
            table = table or [bytes([k]) for k in range(256)] + [b"", b""]
        else:
            if code > len(table):
                raise RasterError("decode", "an LZW code isn't there yet")
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out.append(piece)
        size += len(piece)
        last = piece
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:most]


class Strips(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, spec: RasterSpec, strips: int) -> None:
        self.path, self.spec, self.strips = path, spec, strips

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as file:
            t = Tiff(file)
            validate(t, self.spec)
            n = len(t.tags.get(STRIP_OFFSETS, ()))
            if n != -(-self.spec.height // t.one(ROWS_PER_STRIP, self.spec.height)) or n != len(t.tags.get(STRIP_BYTES, ())):
                raise RasterError("decode", f"{n} strips")
        return [Strips(a, min(a + self.strips, n)) for a in range(0, n, self.strips)]

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as file:
            t = Tiff(file)
            per, packed = t.one(ROWS_PER_STRIP, self.spec.height), t.one(COMPRESSION, 1) == 5
            for k in range(partition.first, partition.last):
                rows = min(per, self.spec.height - k * per)
                want = rows * self.spec.width * 4
                raw = file.read_at(t.tags[STRIP_BYTES][k], t.tags[STRIP_OFFSETS][k])
                raw = unlzw(raw, want) if packed else raw
                if len(raw) < want:
                    raise RasterError("decode", f"strip {k} holds {len(raw)} bytes of {want}")
                values = np.frombuffer(raw[:want], t.order + "f4").astype("=f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * self.spec.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * per, k * per + rows), pa.int32()), lists], ["row", "values"])


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_rows"

    def schema(self) -> str:
        return "row int, values array<float>"

    def reader(self, schema) -> GeoTiffReader:  # noqa: ANN001
        return GeoTiffReader(self.options["path"], RasterSpec(**json.loads(self.options["spec"])), int(self.options.get("strips", 64)))


def check(path: str, spec: RasterSpec) -> None:
    """Refuse a file on the driver, with the typed error, before any plan is made."""
    with _open(path) as file:
        validate(Tiff(file), spec)


def read(spark: SparkSession, path: str, spec: RasterSpec, strips: int = 64) -> DataFrame:
    """(row, values array<float>) of a raster."""
    check(path, spec)
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff_rows").option("spec", json.dumps(asdict(spec))).option("strips", strips).load(path)


def cells(spark: SparkSession, path: str, spec: RasterSpec) -> DataFrame:
    return raster.from_rows(read(spark, path, spec))
