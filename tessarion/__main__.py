"""The command line: one JSON document on standard output, messages on standard error, exit codes 0, 1, 2 and 3."""

from __future__ import annotations

import argparse
import json
import logging
import math
import sys

from tessarion.operators import disc, figures, smallest, table
from tessarion.operators.search import Searcher
from tessarion.plans import documents
from tessarion.plans.errors import BadInput, MissingData, exit_code
from tessarion.plans.grid import Grid, Window
from tessarion.plans.progress import Meter
from tessarion.sources import corpus, geotiff, registry


def whole_percent(text: str) -> int:
    value = int(text)
    if not 1 <= value <= 100:
        raise argparse.ArgumentTypeError(f"a whole percent from 1 to 100: {text}")
    return value


def length(text: str) -> float:
    value = float(text)
    if not math.isfinite(value) or value < 0:
        raise argparse.ArgumentTypeError(f"a finite length of at least zero: {text}")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessarion")
    p.add_argument("--log-level", default="warning", choices=["error", "warning", "info", "debug"])
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("distance")
    for n in ("lat1", "lon1", "lat2", "lon2"):
        d.add_argument(n, type=float)

    def gridded(q: argparse.ArgumentParser) -> None:
        q.add_argument("--width", type=int, required=True)
        q.add_argument("--height", type=int, required=True)
        for n in ("--origin-lat", "--origin-lon", "--lon-step", "--lat-step"):
            q.add_argument(n, type=float, required=True)

    gridded(sub.add_parser("grid").add_subparsers(dest="action", required=True).add_parser("describe"))

    def tabled(q: argparse.ArgumentParser) -> None:
        q.add_argument("--cache", required=True)
        q.add_argument("--digest", required=True)
        q.add_argument("--decimate", type=int, default=1)
        q.add_argument("--dataset")
        q.add_argument("--registry")
        gridded(q)

    t = sub.add_parser("table").add_subparsers(dest="action", required=True)
    b = t.add_parser("build")
    b.add_argument("--registry", required=True)
    b.add_argument("--dataset", required=True)
    b.add_argument("--root", default=".")
    b.add_argument("--cache", required=True)
    b.add_argument("--decimate", type=int, default=1)
    q = t.add_parser("query")
    tabled(q)
    for n in ("--north", "--south", "--west", "--east"):
        q.add_argument(n, type=float)
    a = sub.add_parser("population-at")
    tabled(a)
    a.add_argument("--lat", type=float, required=True)
    a.add_argument("--lon", type=float, required=True)
    a.add_argument("--radius-km", type=length, required=True)
    m = sub.add_parser("most-populous")
    tabled(m)
    m.add_argument("--radius-km", type=length, required=True)
    m.add_argument("--spacing", type=int, required=True)
    s = sub.add_parser("smallest-for-share")
    tabled(s)
    s.add_argument("--share", type=whole_percent, required=True)
    w = sub.add_parser("sweep")
    tabled(w)
    w.add_argument("--from", dest="start", type=int, required=True)
    w.add_argument("--to", type=int, required=True)
    w.add_argument("--step", type=int, required=True)
    for x in (s, w):
        x.add_argument("--spacing", type=int, required=True)
        x.add_argument("--ledger", required=True)
    r = sub.add_parser("render").add_subparsers(dest="action", required=True)
    for name in ("map", "gallery"):
        x = r.add_parser(name)
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--registry", required=True)
        if name == "map":
            x.add_argument("--projection", default=figures.PROJECTIONS[0], choices=figures.PROJECTIONS)
            x.add_argument("--coastlines")
    return p


def _grid(o: argparse.Namespace) -> Grid:
    return Grid(o.width, o.height, o.origin_lat, o.origin_lon, o.lon_step, o.lat_step)


def run(o: argparse.Namespace, spark) -> dict | None:  # noqa: ANN001
    if o.command == "distance":
        return documents.distance(o.lat1, o.lon1, o.lat2, o.lon2)
    if o.command == "grid":
        return documents.grid(_grid(o))
    if o.command == "render":
        cited = {k: d.get("attribution", "") for k, d in registry.load(o.registry).items()}
        if o.action == "gallery":
            corpus.build_gallery(spark(), o.input, o.output, cited)
            return None
        with open(o.input, encoding="utf-8") as f:
            circle = documents.circle_of(json.load(f))
        if circle.dataset not in cited:
            raise MissingData(f"{circle.dataset} isn't registered")
        svg = figures.render_svg(spark(), circle, cited[circle.dataset], o.projection, o.coastlines)
        with open(o.output, "w", encoding="utf-8") as f:
            f.write(svg)
        return None
    if o.command == "table" and o.action == "build":
        dataset = registry.raster(registry.load(o.registry), o.dataset)
        grid = registry.grid_of(dataset)
        grid.decimated(o.decimate)
        spec = geotiff.RasterSpec.of(grid, dataset["epsg"], dataset["nodata"])
        rows = geotiff.read(spark(), f"{o.root}/{dataset['path']}", spec)
        return documents.table_build(table.publish(rows, grid, o.cache, o.decimate, dataset["nodata"]), o.dataset)

    if o.dataset is not None and o.registry:
        registry.raster(registry.load(o.registry), o.dataset)
    grid = _grid(o).decimated(o.decimate)
    identity = table.Identity(table.hexadecimal(table.parse_digest(o.digest)), o.decimate, grid)
    window = None
    if o.command == "table":
        bounds = (o.north, o.south, o.west, o.east)
        if any(x is None for x in bounds) and any(x is not None for x in bounds):
            raise BadInput("a window has all four bounds, or there is none")
        window = Window(*bounds) if bounds[0] is not None else None
    if o.command == "sweep":
        percents = smallest.sweep_percents(o.start, o.to, o.step)
    prefix = table.open_table(spark(), o.cache, identity)
    source = documents.provenance(identity, {"header": f"{o.cache}/identity.json", "payload": f"{o.cache}/rows"}, o.dataset)
    if o.command == "table":
        place = grid.whole() if window is None else grid.covering(window)
        if place is None:
            raise table.TableError("window_off_grid", str(window))
        band, span = place
        rects = spark().createDataFrame([(k, *band, w, e) for k, (w, e) in enumerate(span.ranges(grid.width))], "id int, north int, south int, west int, east int")
        population = sum(r["population"] for r in table.rectangles(prefix, rects).collect())
        return documents.table_query(identity, window, band, span, population)
    prefix = prefix.persist()
    total = prefix.selectExpr("coalesce(sum(element_at(prefix, -1)), 0d)").first()[0]
    if o.command == "population-at":
        r = disc.population_at(prefix, grid, o.lat, o.lon, o.radius_km).first()
        return documents.circle(grid, o.lat, o.lon, r["row"], r["col"], o.radius_km, r["population"], total, source)
    searcher = Searcher(prefix, grid)
    if o.command == "most-populous":
        from tessarion.functions.geodesy import RadiusKm

        return documents.most_populous(grid, searcher.most_populous(RadiusKm(o.radius_km), o.spacing, Meter(sys.stderr)), total, source)
    ledger = smallest.Ledger(spark(), o.ledger, identity)
    if o.command == "smallest-for-share":
        found = smallest.smallest(searcher, smallest.Share.from_percent(o.share), o.spacing, ledger, Meter(sys.stderr), total)
        return documents.smallest(grid, found, o.ledger, len(ledger.radii), source)
    return documents.sweep(grid, smallest.sweep(searcher, percents, o.spacing, ledger), o.start, o.to, o.step, o.ledger, len(ledger.radii), source)


def main(argv: list[str] | None = None) -> int:
    try:
        o = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    logging.basicConfig(stream=sys.stderr, level=o.log_level.upper())

    def spark():  # noqa: ANN202
        from pyspark.sql import SparkSession

        return SparkSession.builder.appName("tessarion").getOrCreate()

    try:
        document = run(o, spark)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return exit_code(e)
    if document is not None:
        print(documents.dumps(document))
    return 0


if __name__ == "__main__":
    sys.exit(main())
