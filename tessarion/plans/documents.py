"""Result documents: one versioned JSON object a command, with the same key order every time; absent values are absent keys."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tessarion
from tessarion.functions.geodesy import EARTH_RADIUS_KM, great_circle_km_at, wrap_lon_at
from tessarion.operators.search import MostPopulous
from tessarion.operators.smallest import Smallest, share_of
from tessarion.operators.table import Built, Identity
from tessarion.plans.errors import BadInput, MissingData
from tessarion.plans.grid import ColSpan, Grid, Window

SCHEMA_VERSION = 1
KINDS = ("distance", "grid", "table-build", "table-query", "circle", "most-populous", "smallest-circle", "smallest", "sweep")
#: Kinds that hold one circle that can be drawn.
CIRCLE_KINDS = ("circle", "most-populous", "smallest")


def envelope(kind: str, result: dict, provenance: dict | None = None) -> dict:
    if kind not in KINDS:
        raise BadInput(f"no such document: {kind}")
    head = {"schema_version": SCHEMA_VERSION, "document": kind, "tool": "tessarion", "tool_version": tessarion.__version__, "earth_model": {"model": "sphere", "radius_km": EARTH_RADIUS_KM}}
    return {**head, **({"provenance": provenance} if provenance else {}), "result": result}


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2, allow_nan=False)


def _present(**values: object) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def coordinate(lat: float, lon: float) -> dict:
    return {"lat": lat, "lon": wrap_lon_at(lon)}


def provenance(identity: Identity, files: dict, dataset: str | None = None) -> dict:
    return _present(digest=identity.digest, decimation=identity.decimation, dataset=dataset, grid=identity.grid.describe(), cache=files)


def distance(lat1: float, lon1: float, lat2: float, lon2: float) -> dict:
    return envelope("distance", {"from": {"lat": lat1, "lon": lon1}, "to": {"lat": lat2, "lon": lon2}, "great_circle_km": great_circle_km_at(lat1, lon1, lat2, lon2)})


def grid(g: Grid) -> dict:
    return envelope("grid", g.describe())


def table_build(built: Built, dataset: str | None = None) -> dict:
    result = {"digest": built.identity.digest, "decimation": built.identity.decimation, "grid": built.identity.grid.describe(), "total_population": built.total, "cells": built.tallies, "cache": built.files}
    return envelope("table-build", result, {"dataset": dataset} if dataset else None)


def table_query(identity: Identity, window: Window | None, band: tuple[int, int], span: ColSpan, population: float) -> dict:
    return envelope(
        "table-query",
        _present(
            digest=identity.digest,
            grid=identity.grid.describe(),
            window=None if window is None else {"north": window.north, "south": window.south, "west": window.west, "east": window.east},
            rows={"north": band[0], "south": band[1]},
            columns={"west": span.west, "east": span.east, "full_turn": span.full_turn},
            population=population,
        ),
    )


def _centre(g: Grid, row: int, col: int) -> dict:
    return {"centre": coordinate(g.centre_lat_at(row), g.centre_lon_at(col)), "row": row, "col": col}


def circle(g: Grid, lat: float, lon: float, row: int, col: int, radius_km: float, population: float, total: float, source: dict | None = None) -> dict:
    result = {"requested": coordinate(lat, lon), **_centre(g, row, col), "radius_km": radius_km, "population": population, "total_population": total, "share_of_total": share_of(population, total)}
    return envelope("circle", result, source)


def most_populous(g: Grid, found: MostPopulous, total: float, source: dict | None = None) -> dict:
    c = found.centre
    result = {**_centre(g, c.row, c.col), "radius_km": found.radius.km, "population": c.population, "total_population": total, "share_of_total": share_of(c.population, total), "tolerance_persons": found.tolerance_persons, "stats": dict(vars(found.stats))}
    return envelope("most-populous", result, source)


def smallest_circle(g: Grid, s: Smallest) -> dict:
    return _present(
        radius_km=s.radius_km,
        **_centre(g, s.centre.row, s.centre.col),
        population=s.centre.population,
        target={"share": s.target.share.value, "persons": s.target.persons, "total": s.target.total},
        share_achieved=s.share_achieved,
        short_below=None if s.short_below is None else {"radius_km": s.short_below[0], "population": s.short_below[1]},
        covers_whole_grid=s.covers_whole_grid,
        predicate_slack_persons=s.predicate_slack_persons,
        ambiguity=None if s.ambiguity is None else {"lowest_km": s.ambiguity.lowest_km, "highest_km": s.ambiguity.highest_km, "radii": s.ambiguity.radii},
        tolerance_persons=s.tolerance_persons,
        stats={"radii_evaluated": s.stats.radii_evaluated, "radii_reused": s.stats.radii_reused, "searched": dict(vars(s.stats.searched))},
    )


def smallest(g: Grid, s: Smallest, ledger: str, radii: int, source: dict | None = None) -> dict:
    return envelope("smallest", {"ledger": {"path": ledger, "radii": radii}, "circle": smallest_circle(g, s)}, source)


def sweep(g: Grid, found: list[Smallest], start: int, to: int, step: int, ledger: str, radii: int, source: dict | None = None) -> dict:
    records = [smallest_circle(g, s) for s in sorted(found, key=lambda s: s.target.share.value)]
    return envelope("sweep", {"ledger": {"path": ledger, "radii": radii}, "shares": {"from_percent": start, "to_percent": to, "step_percent": step}, "records": records}, source)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; null fields are left out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("document"))


@dataclass(frozen=True)
class Circle:
    lat: float
    lon: float
    radius_km: float
    population: float
    share: float
    dataset: str
    table: str
    earth_radius_km: float


def circle_of(document: dict) -> Circle:
    """The circle of a document, or a refusal: newer schema, another earth, a kind without one circle, an unnamed dataset or table."""
    try:
        version, kind, earth = document["schema_version"], document["document"], document["earth_model"]
        if not isinstance(version, int) or isinstance(version, bool) or version > SCHEMA_VERSION:
            raise BadInput(f"this reader knows schema {SCHEMA_VERSION}, the document has {version}")
        if kind not in KINDS or kind not in CIRCLE_KINDS:
            raise BadInput(f"a {kind} document holds no circle")
        if earth["model"] != "sphere":
            raise BadInput(f"only a sphere can be drawn: {earth['model']}")
        origin = document.get("provenance") or {}
        if not origin.get("dataset"):
            raise MissingData("the document names no dataset")
        if origin.get("digest") is None or origin.get("decimation") is None:
            raise MissingData("the document names no table")
        held = document["result"]["circle"] if kind == "smallest" else document["result"]
        share = held["share_achieved"] if kind == "smallest" else held["share_of_total"]
        return Circle(float(held["centre"]["lat"]), float(held["centre"]["lon"]), float(held["radius_km"]), float(held["population"]), float(share), origin["dataset"], f"{origin['digest']} (1:{origin['decimation']})", float(earth["radius_km"]))
    except (KeyError, TypeError) as e:
        raise BadInput(f"the document lacks {e}") from e
