"""Registered queries of the population engine over the provided tables, and the independent SQL of each.

The tables hold no coordinates, so a raster is derived from order keys by a fixed rule (``CELLS``): counts of orders on a globe of
36 x 18 cells, sentinel values where there are none, and some negative cells. Values are whole numbers, so sums are exact in any order.
The SQL answers by definition (distances between all cells), never by kernels or prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarion.functions import geodesy, sums
from tessarion.functions.geodesy import RadiusKm
from tessarion.operators import disc, figures, smallest, table
from tessarion.operators.search import Searcher, tile
from tessarion.plans import documents, scratch
from tessarion.plans.grid import Grid, Window
from tessarion.sources import raster
from tessarion.streaming import cells as streaming

GLOBE = Grid.globe(36, 18)
SMALL = -1.0


def raw_cells(spark: SparkSession, sf_dir: str, grid: Grid = GLOBE) -> DataFrame:
    """(row, col, value float) of every cell."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    at = orders.select(
        F.pmod(F.col("o_custkey") * F.col("o_custkey") + 5, F.lit(grid.height)).cast("int").alias("row"),
        F.pmod(F.col("o_custkey") + F.col("o_orderkey") * F.col("o_orderkey"), F.lit(grid.width)).cast("int").alias("col"),
    )
    counted = at.groupBy("row", "col").agg(F.count("*").cast("float").alias("n"))
    every = grid.cells(spark).join(counted, ["row", "col"], "left")
    value = F.when((F.col("row") * grid.width + F.col("col")) % 97 == 5, F.lit(SMALL)).otherwise(F.coalesce("n", F.lit(raster.NODATA)))
    return every.select("row", "col", value.cast("float").alias("value"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sanitised(raw_cells(spark, sf_dir))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.row_prefix(people(spark, sf_dir), GLOBE)


#: The same raster for the SQL side: raw (row, col, value) and clean (row, col, value).
CELLS = f"""
counted AS (SELECT CAST((o_custkey * o_custkey + 5) % 18 AS INTEGER) AS row, CAST((o_custkey + o_orderkey * o_orderkey) % 36 AS INTEGER) AS col, count(*) AS n FROM orders GROUP BY ALL),
every AS (SELECT CAST(i // 36 AS INTEGER) AS row, CAST(i % 36 AS INTEGER) AS col FROM range(648) t(i)),
raw AS (SELECT every.row, every.col, CAST(CASE WHEN (every.row * 36 + every.col) % 97 = 5 THEN -1 ELSE coalesce(n, {raster.NODATA}) END AS FLOAT) AS value
  FROM every LEFT JOIN counted ON every.row = counted.row AND every.col = counted.col),
cells AS (SELECT row, col, CASE WHEN value > 0 THEN CAST(value AS DOUBLE) ELSE 0 END AS value FROM raw),
geo AS (SELECT *, 90 - 10 * (row + 0.5) AS lat, -180 + 10 * (col + 0.5) AS lon FROM cells)"""
_LAT, _LAT2 = "radians(a.lat)", "radians(b.lat)"
_H = f"least(1, greatest(0, sin(({_LAT2} - {_LAT}) / 2) ** 2 + cos({_LAT}) * cos({_LAT2}) * sin(radians(b.lon - a.lon) / 2) ** 2))"
_KM = f"(6371.0088 * 2 * atan2(sqrt({_H}), sqrt(1 - {_H})))"
#: Distances between all pairs of cells.
PAIRS = CELLS + f""",
pairs AS (SELECT a.row, a.col, b.row AS r, b.col AS c, b.value, {_KM} AS km FROM geo a CROSS JOIN geo b)"""


def cell_tallies(spark, d):  # noqa: ANN001, ANN201
    return raster.tallies(raw_cells(spark, d))


def cell_classes(spark, d):  # noqa: ANN001, ANN201
    return raw_cells(spark, d).select("row", "col", raster.cell_class(F.col("value")).alias("kind"))


def dataset_statistics(spark, d):  # noqa: ANN001, ANN201
    return raster.statistics(raw_cells(spark, d))


def sanitised_cells(spark, d):  # noqa: ANN001, ANN201
    return people(spark, d)


def summed_area_table(spark, d):  # noqa: ANN001, ANN201
    return table.sat(people(spark, d), GLOBE)


def row_prefix_sums(spark, d):  # noqa: ANN001, ANN201
    return prefixes(spark, d).select("row", F.posexplode("prefix").alias("c", "v"))


def _window(spark, d, window):  # noqa: ANN001, ANN202
    place = GLOBE.whole() if window is None else GLOBE.covering(window)
    return table.rectangle(table.sat(people(spark, d), GLOBE), GLOBE, *place)


def window_population(spark, d):  # noqa: ANN001, ANN201
    return _window(spark, d, Window(55.0, -12.0, -31.0, 47.5))


def window_wrapped(spark, d):  # noqa: ANN001, ANN201
    return _window(spark, d, Window(35.0, -80.0, 142.0, -127.0))


def whole_extent(spark, d):  # noqa: ANN001, ANN201
    return _window(spark, d, None)


def many_windows(spark, d):  # noqa: ANN001, ANN201
    rects = spark.range(18 * 6).select(F.col("id").cast("int"), F.expr("cast(id % 18 as int)").alias("north"), F.expr("cast(least(17, id % 18 + id div 18) as int)").alias("south"), F.expr("cast(id div 18 * 3 as int)").alias("west"), F.expr("cast(20 + id % 15 as int)").alias("east"))
    return table.rectangles(prefixes(spark, d), rects)


def decimated_cells(spark, d):  # noqa: ANN001, ANN201
    return table.decimate(people(spark, d), 3)


def decimated_table(spark, d):  # noqa: ANN001, ANN201
    return table.decimate_sat(table.sat(people(spark, d), GLOBE), 6)


def _coordinates(spark, d):  # noqa: ANN001, ANN202
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return c.select("c_custkey", (F.pmod(F.col("c_custkey") * 37, F.lit(1801)) / 10 - 90).alias("lat"), (F.pmod(F.col("c_custkey") * 53, F.lit(7201)) / 10 - 360).alias("lon"))


def distances(spark, d):  # noqa: ANN001, ANN201
    km = geodesy.great_circle_km(F.col("lat"), F.col("lon"), F.lit(48.858), F.lit(2.294))
    return _coordinates(spark, d).select("c_custkey", F.round(km, 5).alias("km"), F.round(geodesy.wrap_lon(F.col("lon")), 6).alias("reduced"))


def coordinate_to_cell(spark, d):  # noqa: ANN001, ANN201
    at = _coordinates(spark, d).select("c_custkey", GLOBE.cell_of(F.col("lat"), F.col("lon")).alias("x"))
    return at.select("c_custkey", "x.row", "x.col")


def column_steps(spark, d):  # noqa: ANN001, ANN201
    return _coordinates(spark, d).select("c_custkey", GLOBE.col_further(F.lit(0), F.col("c_custkey") - 50).alias("col"))


def cell_geometry(spark, d):  # noqa: ANN001, ANN201
    row, col = F.col("row"), F.col("col")
    (n, s), (w, e) = GLOBE.lat_bounds(row), GLOBE.lon_bounds(col)
    return GLOBE.cells(spark).select("row", "col", GLOBE.centre_lat(row).alias("lat"), GLOBE.centre_lon(col).alias("lon"), n.alias("north"), s.alias("south"), w.alias("west"), e.alias("east"), F.round(GLOBE.cell_area_km2(row), 4).alias("area_km2"))


def _kernel_centres(spark):  # noqa: ANN001, ANN202
    return GLOBE.rows(spark).select(F.col("row").alias("centre_row"), F.explode(F.array(F.lit(1500.0), F.lit(4000.0), F.lit(8000.0), F.lit(20016.0))).alias("radius_km"))


def kernel(spark, d):  # noqa: ANN001, ANN201
    return disc.kernels(GLOBE, _kernel_centres(spark))


def population_at(spark, d):  # noqa: ANN001, ANN201
    return disc.population_at(prefixes(spark, d), GLOBE, 48.0, 11.0, 4000.0)


def population_all_centres(spark, d):  # noqa: ANN001, ANN201
    centres = disc.all_centres(spark, GLOBE, [3000.0])
    return centres.join(disc.populations(prefixes(spark, d), GLOBE, centres), "id").select(F.col("centre_row").alias("row"), F.col("centre_col").alias("col"), "population")


def most_populous(spark, d):  # noqa: ANN001, ANN201
    return disc.most_populous_of_all(prefixes(spark, d), GLOBE, [1500.0, 3000.0, 8000.0])


def _search(spark, d, km, spacing):  # noqa: ANN001, ANN202
    return Searcher(prefixes(spark, d).persist(), GLOBE).most_populous(RadiusKm(km), spacing)


def most_populous_pruned(spark, d):  # noqa: ANN001, ANN201
    c = _search(spark, d, 3000.0, 4).centre
    return spark.createDataFrame([(3000.0, c.row, c.col, c.population)], "radius_km double, row int, col int, population double")


def search_counters(spark, d):  # noqa: ANN001, ANN201
    rows = [(s, *vars(_search(spark, d, 3000.0, s).stats).values()) for s in (1, 4)]
    return spark.createDataFrame(rows, "spacing int, levels int, blocks_examined int, blocks_pruned int, circles_evaluated int, kernels_built int")


def smallest_for_shares(spark, d):  # noqa: ANN001, ANN201
    return smallest.radii_for_shares(people(spark, d), GLOBE, [0.1, 0.25, 0.5, 1.0])


def smallest_for_share(spark, d):  # noqa: ANN001, ANN201
    s = smallest.smallest(Searcher(prefixes(spark, d), GLOBE), smallest.Share(0.25), 4, smallest.MemoryLedger())
    row = (s.radius_km, s.centre.row, s.centre.col, s.centre.population, s.target.persons, *s.short_below, s.covers_whole_grid, s.ambiguity is not None)
    return spark.createDataFrame([row], "radius_km int, row int, col int, population double, persons double, short_km int, short_population double, covers boolean, ambiguous boolean")


def smallest_by_bracket(spark, d):  # noqa: ANN001, ANN201
    km, c = smallest.smallest_by_bracket(prefixes(spark, d).persist(), GLOBE, smallest.Share(0.25))
    return spark.createDataFrame([(km, c.row, c.col, c.population)], "radius_km int, row int, col int, population double")


def two_sums(spark, d):  # noqa: ANN001, ANN201
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double").alias("a"), (F.col("o_custkey") / 7).alias("b"))
    total, lost = sums.two_sum(F.col("a"), F.col("b"))
    return o.select("o_orderkey", total.alias("total"), lost.alias("lost"))


def ambiguous_radii(spark, d):  # noqa: ANN001, ANN201
    margins = people(spark, d).select((F.col("row") * 36 + F.col("col")).alias("km"), (F.col("value") - 60.0).alias("margin"))
    return smallest.ambiguity_of(margins, 5.0)


def ledger_upsert(spark, d):  # noqa: ANN001, ANN201
    cells = people(spark, d).select((F.col("row") * 36 + F.col("col")).alias("km"), F.col("value").alias("population"), "row", "col")
    return smallest.upsert(cells.where("km < 400"), cells.where("km >= 300").withColumn("population", F.col("population") + 1))


def block_tiling(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(b.north, b.south, b.first, b.last) for b in tile(GLOBE, 5)], "north int, south int, first int, last int")


def block_split(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(c.north, c.south, c.first, c.last) for b in tile(GLOBE, 5) for c in b.split()], "north int, south int, first int, last int")


def identity_refusal(spark, d):  # noqa: ANN001, ANN201
    want = table.Identity("0x3a5d5e3b082f2fb7", 1, GLOBE)
    have = [("0x3a5d5e3b082f2fb7", 36, 18, 1, 90.0, 180.0, 10.0, -10.0), ("0x3a5d5e3b082f2fb8", 36, 18, 1, 90.0, -180.0, 10.0, -10.0), ("0x3a5d5e3b082f2fb7", 36, 18, 2, 90.0, -180.0, 10.0, -10.0), ("0x3a5d5e3b082f2fb7", 36, 18, 1, 90.0, -180.0, 10.1, -10.0), ("0x3a5d5e3b082f2fb7", 36, 18, 1, 89.0, -180.0, 10.0, None)]
    return table.first_mismatch(spark.createDataFrame(have, "digest string, width int, height int, decimation int, origin_lat double, origin_lon double, lon_step double, lat_step double"), want)


def ring_turns(spark, d):  # noqa: ANN001, ANN201
    ring = figures.boundary(spark, 10.0, 178.0, 3000.0, 72)
    return figures.turns(ring).select("vertex", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "turn")


def graticule(spark, d):  # noqa: ANN001, ANN201
    return figures.graticule(spark)


def orthographic_cells(spark, d):  # noqa: ANN001, ANN201
    points = GLOBE.cells(spark).select("row", "col", GLOBE.centre_lat(F.col("row")).alias("lat"), GLOBE.centre_lon(F.col("col")).alias("lon"))
    return figures.framed(points, "orthographic", 30.0, 100.0).select("row", "col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "visible")


def digest(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(table.fnv_digest(people(spark, d)), table.parallel_digest(raw_cells(spark, d), GLOBE))], "serial string, parallel string")


def published_table(spark, d):  # noqa: ANN001, ANN201
    path = scratch.path(spark, "table")
    built = table.publish(table.pack_rows(raw_cells(spark, d)), GLOBE, path, decimation=2)
    prefix = table.open_table(spark, path, built.identity)
    return prefix.select("row", F.element_at("prefix", -1).alias("total"))


def grid_document(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(documents.dumps(documents.grid(GLOBE)),)], "document string")


def streamed_prefixes(spark, d):  # noqa: ANN001, ANN201
    packed = table.pack_rows(raw_cells(spark, d))
    rows, out, state = (scratch.path(spark, f"stream-{k}") for k in ("rows", "prefix", "state"))
    packed.write.parquet(rows)
    streaming.write_prefixes(spark.readStream.schema("row int, values array<float>").parquet(rows), GLOBE, out, state).awaitTermination()
    return spark.read.schema("row int, prefix array<double>").parquet(out).select("row", F.posexplode("prefix").alias("c", "v"))


def event_people(spark, d):  # noqa: ANN001, ANN201
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", F.pmod(F.col("user_id"), F.lit(18)).cast("int").alias("row"), F.pmod(F.col("event_id"), F.lit(36)).cast("int").alias("col"))
    return streaming.event_cells(events, GLOBE).groupBy("row", "col").agg(F.sum("value").alias("value"))


def sweep(spark, d):  # noqa: ANN001, ANN201
    found = smallest.sweep(Searcher(prefixes(spark, d), GLOBE), smallest.sweep_percents(10, 90, 20), 4)
    rows = [(s.target.share.value, s.target.persons, s.radius_km, s.centre.row, s.centre.col, s.centre.population) for s in found]
    return spark.createDataFrame(rows, "share double, persons double, radius_km int, row int, col int, population double")


def block_slack(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(b.north, b.first, round(disc.slack_km(GLOBE, b.north, b.south, b.first, b.last), 5)) for b in tile(GLOBE, 5)], "north int, first int, slack_km double")


def window_cells(spark, d):  # noqa: ANN001, ANN201
    windows = [(55.0, -12.0, -31.0, 47.5), (35.0, -80.0, 142.0, -127.0), (10.0, 0.0, -180.0, 180.0), (10.0, -90.0, 0.0, 10.0)]
    rows = []
    for w in windows:
        place = GLOBE.covering(Window(*w))
        rows.append((*w, *((place[0][0], place[0][1], place[1].west, place[1].east, place[1].full_turn) if place else (None,) * 5)))
    return spark.createDataFrame(rows, "north double, south double, west double, east double, first_row int, last_row int, first_col int, last_col int, full_turn boolean")


def wrapped_spans(spark, d):  # noqa: ANN001, ANN201
    centres = GLOBE.cells(spark).select((F.col("row") * 36 + F.col("col")).alias("id"), F.col("row").alias("centre_row"), F.col("col").alias("centre_col"), F.lit(3000.0).alias("radius_km"))
    spans = disc.placed(disc.kernels(GLOBE, centres.select("centre_row", "radius_km").distinct()), centres, GLOBE)
    return spans.groupBy("id").agg(F.sum(F.col("east") - F.col("west") + 1).cast("long").alias("cells"), F.countDistinct("row").alias("rows"))


def whole_grid_kernels(spark, d):  # noqa: ANN001, ANN201
    return disc.covering(disc.kernels(GLOBE, _kernel_centres(spark)), GLOBE)


def best_by_row(spark, d):  # noqa: ANN001, ANN201
    cells = people(spark, d).select((F.col("row") % 3).alias("band"), "row", "col", F.col("value").alias("population"))
    return disc.best(cells, "band")


def ledger_lookup(spark, d):  # noqa: ANN001, ANN201
    probes = people(spark, d).select((F.col("row") * 36 + F.col("col")).alias("km"))
    settled = people(spark, d).where("value > 60").select((F.col("row") * 36 + F.col("col")).alias("km"))
    return smallest.looked_up(settled, probes)


def digest_text(spark, d):  # noqa: ANN001, ANN201
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return o.select("o_orderkey", table.hexadecimal_of(F.col("o_orderkey")).alias("digest"))


def enclosed_poles(spark, d):  # noqa: ANN001, ANN201
    caps = [(10.0, 3000.0), (78.0, 3000.0), (-80.0, 4000.0), (25.125, 16384.0), (30.0, 3300.0)]
    return spark.createDataFrame([(lat, km, -90.0 in (p := figures.enclosed_poles(lat, km)), 90.0 in p) for lat, km in caps], "lat double, radius_km double, south boolean, north boolean")


def cells_as_json(spark, d):  # noqa: ANN001, ANN201
    kept = raw_cells(spark, d).select("row", "col", F.when(F.col("value") > 0, F.col("value").cast("int")).alias("people"))
    return documents.as_json(kept)


_ALL = (
    sweep, block_slack, window_cells, wrapped_spans, whole_grid_kernels, best_by_row, ledger_lookup, digest_text, enclosed_poles, cells_as_json,
    cell_tallies, cell_classes, dataset_statistics, sanitised_cells, summed_area_table, row_prefix_sums, window_population, window_wrapped, whole_extent, many_windows,
    decimated_cells, decimated_table, distances, coordinate_to_cell, column_steps, cell_geometry, kernel, population_at, population_all_centres, most_populous,
    most_populous_pruned, search_counters, smallest_for_shares, smallest_for_share, ambiguous_radii, ledger_upsert, block_tiling, block_split, identity_refusal,
    smallest_by_bracket, two_sums, ring_turns, graticule, orthographic_cells, digest, published_table, grid_document, streamed_prefixes, event_people,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    coordinates = "coords AS (SELECT c_custkey, (c_custkey * 37) % 1801 / 10.0 - 90 AS lat, (c_custkey * 53) % 7201 / 10.0 - 360 AS lon FROM customer)"
    within = lambda km: f"km <= {km} + 1e-9 OR {km} >= 20015.2"
    top = lambda km: f"(SELECT CAST({km} AS DOUBLE) AS radius_km, row, col, sum(value) AS population FROM pairs WHERE {within(km)} GROUP BY row, col ORDER BY population DESC, row, col LIMIT 1)"
    rings = f"""{PAIRS}, total AS (SELECT sum(value) AS total FROM cells),
goals AS (SELECT share, share * total AS persons FROM total, (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0)) s(share)),
grown AS (SELECT row, col, km, sum(value) OVER (PARTITION BY row, col ORDER BY km RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pop FROM pairs)"""
    half = "(SELECT max(x) FROM range(19) o(x) WHERE 6371.0088 * 2 * atan2(sqrt({h}), sqrt(1 - {h})) <= k.radius_km OR k.radius_km >= 20015.2)"
    h = "least(1, greatest(0, sin(radians(-10 * (r.row - k.centre_row)) / 2) ** 2 + cos(radians(90 - 10 * (k.centre_row + 0.5))) * cos(radians(90 - 10 * (r.row + 0.5))) * sin(radians(x * 10.0) / 2) ** 2))"
    blocks = "tiles AS (SELECT CAST(n AS INTEGER) AS north, CAST(least(n + 4, 17) AS INTEGER) AS south, CAST(f AS INTEGER) AS first, CAST(least(f + 4, 35) AS INTEGER) AS last FROM range(0, 18, 5) a(n), range(0, 36, 5) b(f))"
    ring = """
v AS (SELECT CAST(i AS INTEGER) AS vertex, radians((i % 72) * 5.0) AS t, radians(10.0) AS p, 3000 / 6371.0088 AS a FROM range(73) x(i)),
w AS (SELECT *, sin(p) * cos(a) + cos(p) * sin(a) * cos(t) AS up FROM v),
g AS (SELECT vertex, degrees(asin(up)) AS lat, 178 + degrees(atan2(sin(t) * sin(a) * cos(p), cos(a) - sin(p) * up)) AS l FROM w),
z AS (SELECT vertex, lat, CASE WHEN l >= 180 THEN l - 360 WHEN l < -180 THEN l + 360 ELSE l END AS lon FROM g),
j AS (SELECT *, lon - lag(lon) OVER (ORDER BY vertex) AS jump FROM z)"""
    ortho = f"{CELLS}, o AS (SELECT row, col, radians(lat) AS p, radians(lon - 100) AS d, radians(30.0) AS q FROM geo)"
    area = "6371.0088 * 6371.0088 * radians(10.0) * (sin(radians(90.0 - 10 * row)) - sin(radians(90.0 - 10 * (row + 1))))"
    sat = f"WITH {CELLS} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce((SELECT sum(value) FROM cells WHERE row < r AND col < c), 0) AS v FROM range(0, 19) a(r), range(0, 37) b(c)"
    kernels = f"WITH k AS (SELECT CAST(i AS INTEGER) AS centre_row, radius_km FROM range(18) a(i), (VALUES (1500::DOUBLE), (4000), (8000), (20016)) b(radius_km)), r AS (SELECT CAST(i AS INTEGER) AS row FROM range(18) c(i)), w AS (SELECT k.centre_row, k.radius_km, r.row, {half.format(h=h)} AS half_width FROM k, r)"
    return {
        "sweep": f"""WITH {rings.replace('(0.1::DOUBLE), (0.25), (0.5), (1.0)', '(0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)')}, a AS (SELECT share, persons, ceil(min(km)) AS radius_km FROM goals JOIN grown ON pop >= persons GROUP BY share, persons),
t AS (SELECT share, persons, radius_km, row, col, sum(value) AS population FROM a JOIN pairs ON km <= radius_km GROUP BY ALL)
SELECT share, persons, CAST(radius_km AS INTEGER) AS radius_km, row, col, population FROM t QUALIFY row_number() OVER (PARTITION BY share ORDER BY population DESC, row, col) = 1""",
        "two_sums": "WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) / 7 AS b FROM orders) SELECT o_orderkey, a + b AS total, (a - ((a + b) - ((a + b) - a))) + (b - ((a + b) - a)) AS lost FROM x",
        "block_slack": f"WITH {blocks}, m AS (SELECT *, north + (south - north) // 2 AS pr, first + (last - first) // 2 AS pc FROM tiles) SELECT north, first, round(6371.0088 * (radians(10.0 * greatest(pr - north, south - pr)) + radians(10.0 * greatest(pc - first, last - pc)) * cos(radians(85 - 10.0 * pr))), 5) AS slack_km FROM m",
        "window_cells": """WITH w AS (SELECT * FROM (VALUES (55::DOUBLE, -12::DOUBLE, -31::DOUBLE, 47.5::DOUBLE), (35, -80, 142, -127), (10, 0, -180, 180), (10, -90, 0, 10)) t(north, south, west, east)),
c AS (SELECT *, floor((90 - north) / 10) AS r0, floor((90 - south) / 10) AS r1, floor((west + 180) / 10) % 36 AS c0, floor((east + 180) / 10) % 36 AS c1, north <= 90 AND south > -90 AS good, east - west >= 360 AS turn FROM w)
SELECT north, south, west, east, CASE WHEN good THEN CAST(r0 AS INTEGER) END AS first_row, CASE WHEN good THEN CAST(r1 AS INTEGER) END AS last_row, CASE WHEN good THEN CAST(CASE WHEN turn THEN 0 ELSE c0 END AS INTEGER) END AS first_col,
CASE WHEN good THEN CAST(CASE WHEN turn THEN 35 ELSE c1 END AS INTEGER) END AS last_col, CASE WHEN good THEN turn END AS full_turn FROM c""",
        "wrapped_spans": f"WITH {PAIRS} SELECT row * 36 + col AS id, count(*) AS cells, count(DISTINCT r) AS rows FROM pairs WHERE km <= 3000 GROUP BY ALL",
        "whole_grid_kernels": f"{kernels} SELECT centre_row, radius_km, bool_and(coalesce(half_width >= 18, false)) AS covers FROM w GROUP BY ALL",
        "best_by_row": f"WITH {CELLS} SELECT row % 3 AS band, row, col, value AS population FROM cells QUALIFY row_number() OVER (PARTITION BY row % 3 ORDER BY value DESC, row, col) = 1",
        "ledger_lookup": f"WITH {CELLS} SELECT row * 36 + col AS km, CASE WHEN value > 60 THEN 'reused' ELSE 'searched' END AS how FROM cells",
        "digest_text": "SELECT o_orderkey, printf('0x%016x', o_orderkey) AS digest FROM orders",
        "enclosed_poles": "SELECT lat, radius_km, 6371.0088 * radians(90 + lat) < radius_km AS south, 6371.0088 * radians(90 - lat) < radius_km AS north FROM (VALUES (10::DOUBLE, 3000::DOUBLE), (78, 3000), (-80, 4000), (25.125, 16384), (30, 3300)) t(lat, radius_km)",
        "cells_as_json": f"""WITH {CELLS} SELECT '{{"row":' || row || ',"col":' || col || CASE WHEN value > 0 THEN ',"people":' || CAST(value AS INTEGER) ELSE '' END || '}}' AS document FROM raw""",
        "cell_tallies": f"WITH {CELLS} SELECT count(*) FILTER (value < -1) AS nodata, count(*) FILTER (value = -1) AS unexpected_negative, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value > 0) AS populated, count(*) AS total FROM raw",
        "cell_classes": f"WITH {CELLS} SELECT row, col, CASE WHEN value < -1 THEN 'nodata' WHEN value < 0 THEN 'unexpected_negative' WHEN value = 0 THEN 'zero' ELSE 'populated' END AS kind FROM raw",
        "dataset_statistics": f"WITH {CELLS} SELECT count(*) FILTER (value < -1) AS nodata, count(*) FILTER (value = -1) AS unexpected_negative, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value > 0) AS populated, count(*) AS total, CAST(sum(value) FILTER (value > 0) AS DOUBLE) AS total_population, CAST(max(value) FILTER (value > 0) AS DOUBLE) AS largest FROM raw",
        "sanitised_cells": f"WITH {CELLS} SELECT * FROM cells",
        "summed_area_table": sat,
        "row_prefix_sums": f"WITH {CELLS} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS c, coalesce((SELECT sum(value) FROM cells WHERE row = r AND col < c), 0) AS v FROM range(0, 18) a(r), range(0, 37) b(c)",
        "window_population": f"WITH {CELLS} SELECT sum(value) AS population FROM cells WHERE row BETWEEN 3 AND 10 AND col BETWEEN 14 AND 22",
        "window_wrapped": f"WITH {CELLS} SELECT sum(value) AS population FROM cells WHERE row BETWEEN 5 AND 17 AND (col >= 32 OR col <= 5)",
        "whole_extent": f"WITH {CELLS} SELECT sum(value) AS population FROM cells",
        "many_windows": f"WITH {CELLS}, w AS (SELECT CAST(i AS INTEGER) AS id, i % 18 AS north, least(17, i % 18 + i // 18) AS south, i // 18 * 3 AS west, 20 + i % 15 AS east FROM range(108) t(i)) SELECT id, sum(value) AS population FROM w JOIN cells ON row BETWEEN north AND south AND col BETWEEN west AND east GROUP BY id",
        "decimated_cells": f"WITH {CELLS} SELECT CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, sum(value) AS value FROM cells GROUP BY ALL",
        "decimated_table": f"WITH {CELLS} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce((SELECT sum(value) FROM cells WHERE row < r * 6 AND col < c * 6), 0) AS v FROM range(0, 4) a(r), range(0, 7) b(c)",
        "distances": f"WITH {coordinates}, x AS (SELECT *, least(1, greatest(0, sin(radians(48.858 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(48.858)) * sin(radians(2.294 - lon) / 2) ** 2)) AS h FROM coords) SELECT c_custkey, round(6371.0088 * 2 * atan2(sqrt(h), sqrt(1 - h)), 5) AS km, round(lon - 360 * floor((lon + 180) / 360), 6) AS reduced FROM x",
        "coordinate_to_cell": f"WITH {coordinates}, x AS (SELECT c_custkey, floor((lat - 90.0) / -10.0) AS r, floor((((lon + 180.0) / 10.0) % 36 + 36) % 36) AS c FROM coords) SELECT c_custkey, CASE WHEN r BETWEEN 0 AND 17 AND c BETWEEN 0 AND 35 THEN CAST(r AS INTEGER) END AS row, CASE WHEN r BETWEEN 0 AND 17 AND c BETWEEN 0 AND 35 THEN CAST(c AS INTEGER) END AS col FROM x",
        "column_steps": "SELECT c_custkey, CAST((c_custkey - 50 + 72) % 36 AS INTEGER) AS col FROM customer",
        "cell_geometry": f"WITH {CELLS} SELECT row, col, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(90 - 10 * row AS DOUBLE) AS north, CAST(80 - 10 * row AS DOUBLE) AS south, CAST(-180 + 10 * col AS DOUBLE) AS west, CAST(-170 + 10 * col AS DOUBLE) AS east, round({area}, 4) AS area_km2 FROM geo",
        "kernel": f"WITH k AS (SELECT CAST(i AS INTEGER) AS centre_row, radius_km FROM range(18) a(i), (VALUES (1500::DOUBLE), (4000), (8000), (20016)) b(radius_km)), r AS (SELECT CAST(i AS INTEGER) AS row FROM range(18) c(i)), w AS (SELECT k.centre_row, k.radius_km, r.row, {half.format(h=h)} AS half_width FROM k, r) SELECT centre_row, radius_km, row, CAST(least(half_width, 18) AS INTEGER) AS half_width, half_width >= 18 AS full_turn FROM w WHERE half_width IS NOT NULL",
        "population_at": f"WITH {PAIRS} SELECT row, col, CAST(45 AS DOUBLE) AS lat, CAST(15 AS DOUBLE) AS lon, CAST(4000 AS DOUBLE) AS radius_km, sum(value) AS population FROM pairs WHERE row = 4 AND col = 19 AND km <= 4000 GROUP BY row, col",
        "population_all_centres": f"WITH {PAIRS} SELECT row, col, sum(value) AS population FROM pairs WHERE km <= 3000 GROUP BY row, col",
        "most_populous": f"WITH {PAIRS} {top(1500)} UNION ALL {top(3000)} UNION ALL {top(8000)}",
        "most_populous_pruned": f"WITH {PAIRS} {top(3000)}",
        "smallest_for_shares": f"WITH {rings} SELECT share, persons, CAST(least(20016, ceil(min(km))) AS INTEGER) AS radius_km FROM goals JOIN grown ON pop >= persons GROUP BY share, persons",
        "smallest_by_bracket": f"WITH {rings}, a AS (SELECT ceil(min(km)) AS radius_km FROM goals JOIN grown ON pop >= persons WHERE share = 0.25) SELECT CAST(radius_km AS INTEGER) AS radius_km, row, col, sum(value) AS population FROM pairs, a WHERE km <= radius_km GROUP BY radius_km, row, col ORDER BY population DESC, row, col LIMIT 1",
        "smallest_for_share": f"""WITH {rings}, a AS (SELECT persons, ceil(min(km)) AS radius_km FROM goals JOIN grown ON pop >= persons WHERE share = 0.25 GROUP BY persons),
t AS (SELECT radius_km, row, col, persons, sum(value) AS population FROM pairs, a WHERE km <= radius_km GROUP BY ALL ORDER BY population DESC, row, col LIMIT 1),
s AS (SELECT max(population) AS short_population FROM (SELECT sum(value) AS population FROM pairs, a WHERE km <= radius_km - 1 GROUP BY row, col))
SELECT CAST(radius_km AS INTEGER) AS radius_km, row, col, population, persons, CAST(radius_km - 1 AS INTEGER) AS short_km, short_population,
(SELECT count(*) FROM pairs p WHERE p.row = t.row AND p.col = t.col AND p.km <= t.radius_km) = 648 AS covers, abs(population - persons) < 1e-6 OR abs(short_population - persons) < 1e-6 AS ambiguous FROM t, s""",
        "ambiguous_radii": f"WITH {CELLS} SELECT min(row * 36 + col) AS lowest_km, max(row * 36 + col) AS highest_km, count(*) AS radii FROM cells WHERE abs(value - 60) <= 5",
        "ledger_upsert": f"WITH {CELLS} SELECT row * 36 + col AS km, CASE WHEN row * 36 + col >= 300 THEN value + 1 ELSE value END AS population, row, col FROM cells",
        "block_tiling": f"WITH {blocks} SELECT * FROM tiles",
        "block_split": f"""WITH {blocks}, m AS (SELECT *, north + (south - north) // 2 AS pr, first + (last - first) // 2 AS pc FROM tiles),
v AS (SELECT north AS n, pr AS s, first, last, pc FROM m UNION ALL SELECT pr + 1, south, first, last, pc FROM m WHERE south > north)
SELECT n AS north, s AS south, first, pc AS last FROM v UNION ALL SELECT n, s, pc + 1, last FROM v WHERE last > first""",
        "identity_refusal": """WITH have AS (SELECT * FROM (VALUES ('0x3a5d5e3b082f2fb7', 36, 18, 1, 90::DOUBLE, 180::DOUBLE, 10::DOUBLE, -10::DOUBLE), ('0x3a5d5e3b082f2fb8', 36, 18, 1, 90, -180, 10, -10),
('0x3a5d5e3b082f2fb7', 36, 18, 2, 90, -180, 10, -10), ('0x3a5d5e3b082f2fb7', 36, 18, 1, 90, -180, 10.1, -10), ('0x3a5d5e3b082f2fb7', 36, 18, 1, 89, -180, 10, NULL))
t(digest, width, height, decimation, origin_lat, origin_lon, lon_step, lat_step))
SELECT *, CASE WHEN digest <> '0x3a5d5e3b082f2fb7' THEN 'digest' WHEN width <> 36 THEN 'width' WHEN height <> 18 THEN 'height' WHEN decimation <> 1 THEN 'decimation' WHEN abs(origin_lat - 90) > 1e-6 THEN 'origin_lat'
WHEN (origin_lon + 180) % 360 > 1e-6 THEN 'origin_lon' WHEN abs(lon_step - 10) > 1e-6 THEN 'lon_step' WHEN lat_step IS NULL OR abs(lat_step + 10) > 1e-6 THEN 'lat_step' END AS reason FROM have""",
        "ring_turns": f"WITH {ring} SELECT vertex, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(sum(CASE WHEN jump > 180 THEN -1 WHEN jump < -180 THEN 1 ELSE 0 END) OVER (ORDER BY vertex) AS INTEGER) AS turn FROM j",
        "graticule": """SELECT 'm' || m AS line, CAST((y + 90) // 2 AS INTEGER) AS vertex, CAST(y AS DOUBLE) AS lat, CAST(m AS DOUBLE) AS lon FROM range(-180, 181, 30) a(m), range(-90, 91, 2) b(y)
UNION ALL SELECT 'p' || p, CAST((x + 180) // 2 AS INTEGER), CAST(p AS DOUBLE), CAST(x AS DOUBLE) FROM range(-60, 61, 30) c(p), range(-180, 181, 2) d(x)""",
        "orthographic_cells": f"WITH {ortho} SELECT row, col, round(6371.0088 * cos(p) * sin(d), 4) AS x, round(6371.0088 * (cos(q) * sin(p) - sin(q) * cos(p) * cos(d)), 4) AS y, sin(q) * sin(p) + cos(q) * cos(p) * cos(d) >= 0 AS visible FROM o",
        "published_table": f"WITH {CELLS} SELECT CAST(row // 2 AS INTEGER) AS row, sum(value) AS total FROM cells GROUP BY ALL",
        "streamed_prefixes": f"WITH {CELLS} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS c, coalesce((SELECT sum(value) FROM cells WHERE row = r AND col < c), 0) AS v FROM range(0, 18) a(r), range(0, 37) b(c)",
        "event_people": "SELECT CAST(user_id % 18 AS INTEGER) AS row, CAST(event_id % 36 AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL",
    }

