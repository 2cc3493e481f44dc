"""The dataset registry (TOML), and datasets fetched and verified by it."""

from __future__ import annotations

import hashlib
import os
import tempfile
import tomllib
import urllib.parse
import urllib.request
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.plans.grid import Grid

SCHEMA = (
    "key string, kind string, path string, bytes long, sha256 string, source_url string, licence string, licence_url string, attribution string, fetch_url string, "
    "width int, height int, origin_lat double, origin_lon double, lat_step double, lon_step double, epsg int, nodata double"
)
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_RASTER = ("width", "height", "origin_lat", "origin_lon", "lat_step", "lon_step", "epsg", "nodata")
_EVERY = ("path", "bytes", "sha256", "source_url", "licence", "licence_url")


class RegistryError(ValueError):
    """``kind``: syntax, unknown_dataset, not_a_raster, key_is_not_the_stem."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


class FetchError(RuntimeError):
    pass


def parse(text: str) -> dict[str, dict]:
    """Datasets by key, ascending. A key is the stem of its file's name; a raster states its grid."""
    try:
        found = tomllib.loads(text)["datasets"]
        out = {}
        for key in sorted(found):
            d = dict(found[key])
            needed = _EVERY + (_RASTER if d["kind"] == "population-raster" else ())
            if d["kind"] not in ("population-raster", "boundary-vector") or any(n not in d for n in needed):
                raise RegistryError("syntax", f"{key}: {sorted(set(needed) - set(d)) or d['kind']}")
            if PurePosixPath(d["path"]).stem != key:
                raise RegistryError("key_is_not_the_stem", f"{key}: {d['path']}")
            out[key] = d
        return out
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
        raise RegistryError("syntax", str(e)) from e


def load(path: str) -> dict[str, dict]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def frame(spark: SparkSession, datasets: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([tuple({"key": k, **d}.get(c) for c in _COLUMNS) for k, d in datasets.items()], SCHEMA)


def raster(datasets: dict[str, dict], key: str) -> dict:
    if key not in datasets:
        raise RegistryError("unknown_dataset", key)
    if datasets[key]["kind"] != "population-raster":
        raise RegistryError("not_a_raster", key)
    return datasets[key]


def grid_of(dataset: dict) -> Grid:
    return Grid(dataset["width"], dataset["height"], dataset["origin_lat"], dataset["origin_lon"], dataset["lon_step"], dataset["lat_step"])


def attributions(documents: DataFrame, datasets: DataFrame) -> DataFrame:
    """``documents(dataset, ...)`` with the attribution each owes; a dataset the registry lacks stops the query."""
    known = datasets.select(F.col("key").alias("dataset"), F.lit(True).alias("known"), "attribution")
    full = documents.join(F.broadcast(known), "dataset", "left")  # a registry is a hand-written file
    return full.where(F.assert_true(F.coalesce("known", F.lit(False)), F.lit("a document's dataset isn't registered")).isNull()).drop("known")


def verify(path: str, size: int, sha256: str) -> None:
    if os.path.getsize(path) != size:
        raise FetchError(f"{path} has {os.path.getsize(path)} bytes, {size} are registered")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    if digest.hexdigest() != sha256:
        raise FetchError(f"{path} has sha256 {digest.hexdigest()}, {sha256} is registered")


def verified(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, computed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def acquire(datasets: dict[str, dict], root: str, opener=urllib.request.urlopen) -> list[str]:  # noqa: ANN001
    """Fetch what has a ``fetch_url`` and isn't there yet; https only, checked before it is put in place. Ascending by key."""
    placed = []
    for key, d in sorted(datasets.items()):
        if "fetch_url" not in d:
            continue
        path = os.path.join(root, d["path"])
        if os.path.exists(path):
            verify(path, d["bytes"], d["sha256"])
            continue
        if urllib.parse.urlsplit(d["fetch_url"]).scheme != "https":
            raise FetchError(f"{key}: only https is fetched")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        held = tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False)
        try:
            with opener(d["fetch_url"]) as source, held:
                while piece := source.read(1 << 20):
                    held.write(piece)
            verify(held.name, d["bytes"], d["sha256"])
            os.replace(held.name, path)
        except BaseException:
            os.unlink(held.name)
            raise
        placed.append(key)
    return placed
