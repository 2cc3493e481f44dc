import math

import pytest
from pyspark.sql import functions as F

from tessarion.functions.geodesy import RadiusKm
from tessarion.operators import disc, smallest, table
from tessarion.operators.search import Candidate, Searcher
from tessarion.operators.smallest import LedgerError, MemoryLedger, Share, ShareError, SweepError
from tessarion.operators.table import CacheError, Identity
from tessarion.plans.grid import ColSpan, Grid, KernelError
from tessarion.sources import raster
from tessarion.streaming import cells as streaming

G = Grid.globe(36, 18)
N = raster.NODATA


@pytest.fixture(scope="module")
def dense(spark):
    cells = G.cells(spark).select("row", "col", (F.col("row") * 36 + F.col("col") + 1).cast("double").alias("value"))
    return cells, table.row_prefix(cells, G).persist()


def patch(spark, people, grid=G):
    return raster.synthetic(spark, grid, [[people.get((r, c), 0.0) for c in range(grid.width)] for r in range(grid.height)])


def searcher(spark, people, grid=G):
    return Searcher(table.row_prefix(raster.sanitised(patch(spark, people, grid)), grid).persist(), grid)


def test_padded_table(spark):
    g = Grid(4, 3, 90, -180, 90, -60)
    cells = raster.sanitised(raster.synthetic(spark, g, [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]))
    got = {(r["r"], r["c"]): r["v"] for r in table.sat(cells, g).collect()}
    want = [[0, 0, 0, 0, 0], [0, 1, 3, 6, 10], [0, 6, 14, 24, 36], [0, 15, 33, 54, 78]]
    assert got == {(r, c): want[r][c] for r in range(4) for c in range(5)}
    sat = table.sat(cells, g).persist()
    for n in range(3):
        for s in range(n, 3):
            for w in range(4):
                for e in range(0, 4, 3):
                    cols = range(w, e + 1) if w <= e else [*range(w, 4), *range(e + 1)]
                    direct = sum(r * 4 + c + 1 for r in range(n, s + 1) for c in cols)
                    assert sum(x * got[r, c] for r, c, x in table.corners((n, s), ColSpan(w, e), 4)) == direct
    assert table.rectangle(sat, g, (2, 0), ColSpan(0, 3, True)).first()[0] == 78
    assert cells.where(table.in_rectangle((0, 1), ColSpan(3, 0))).agg(F.sum("value")).first()[0] == 4 + 1 + 8 + 5
    with pytest.raises(raster.RasterError):
        raster.synthetic(spark, g, [[1]])


def test_tallies_and_digest(spark):
    g = Grid(4, 1, 90, -180, 90, -90)
    cells = raster.synthetic(spark, g, [[N, -1, 0, 12.5]])
    assert tuple(raster.tallies(cells).first()) == (1, 1, 1, 1, 4)
    assert [r["value"] for r in raster.sanitised(cells).orderBy("col").collect()] == [0, 0, 0, 12.5]
    odd = raster.synthetic(spark, g, [[math.nan, math.inf, -0.0, N]])
    assert tuple(raster.tallies(odd).first()) == (1, 0, 2, 1, 4) and tuple(raster.tallies(odd, math.nan).first()) == (1, 1, 1, 1, 4)
    three = Grid(3, 1, 90, -180, 120, -180)
    sample = raster.synthetic(spark, three, [[1.0, N, 2.5]])
    assert table.fnv_digest(raster.sanitised(sample)) == "0x3a5d5e3b082f2fb7"
    assert table.parallel_digest(sample, three) == table.parallel_digest(sample.repartition(3), three) != table.parallel_digest(sample.withColumn("value", F.col("value") + 1), three)
    assert table.exact_total(raster.sanitised(sample)) == 3.5
    with pytest.raises(Exception, match="off the grid"):
        raster.checked(sample.withColumn("col", F.lit(3)), three).count()
    assert raster.checked(sample, three).count() == 3


def test_decimation(spark):
    g = Grid(12, 6, 90, -180, 30, -30)
    cells = g.cells(spark).select("row", "col", ((F.col("row") * 12 + F.col("col") + 1) / 3).alias("value"))
    a = {tuple(r)[:2]: r["v"] for r in table.sat(table.decimate(cells, 3), g.decimated(3)).collect()}
    b = {tuple(r)[:2]: r["v"] for r in table.decimate_sat(table.sat(cells, g), 3).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-15) for k in a)


def test_disc_golden(dense):
    _, prefix = dense
    r = disc.population_at(prefix, G, 48.0, 11.0, 1200.0).first()
    assert (r["row"], r["col"], r["lat"], r["lon"], r["population"]) == (4, 19, 45.0, 15.0, 820.0)


@pytest.mark.parametrize("grid", [G, Grid(36, 18, 90.0, -180.0, -10.0, -10.0), Grid(15, 8, 60.0, 20.0, 24.0, -15.0)])
def test_every_disc_equals_its_definition(spark, grid):
    cells = grid.cells(spark).select("row", "col", (F.col("row") * F.col("row") * 7 + F.col("col") * 3 + 1).cast("double").alias("value"))
    prefix = table.row_prefix(cells, grid)
    centres = disc.all_centres(spark, grid, [0.0, 900.0, 3100.0, 12_000.0]).persist()
    a = {r["id"]: r["population"] for r in disc.populations(prefix, grid, centres).collect()}
    b = {r["id"]: r["population"] for r in disc.population_by_distance(cells, grid, centres).collect()}
    assert a == b and len(a) == 4 * grid.width * grid.height


def test_search_golden_and_spacings(dense):
    _, prefix = dense
    s = Searcher(prefix, G)
    found = s.most_populous(RadiusKm(3000.0), 4)
    assert (found.centre.population, found.centre.row, found.centre.col) == (55986.0, 17, 25)
    assert tuple(vars(found.stats).values()) == (3, 369, 269, 100, 29)
    for spacing in (1, 5, 40):
        assert s.most_populous(RadiusKm(3000.0), spacing).centre == found.centre
    best = {r["radius_km"]: (r["row"], r["col"], r["population"]) for r in disc.most_populous_of_all(prefix, G, [3000.0, 0.0]).collect()}
    assert best[3000.0] == (17, 25, 55986.0) and best[0.0] == (17, 35, 648.0)


def test_level_by_level_equals_a_table_that_is_sent(dense):
    _, prefix = dense
    for km in (0.0, 1500.0, 9000.0, 20015.0):
        sent = Searcher(prefix, G).most_populous(RadiusKm(km), 6)
        assert Searcher(prefix, G, bound_bytes=0).most_populous(RadiusKm(km), 6) == sent


def test_kernels_of_a_sent_table(spark, dense):
    from pyspark.sql import functions as F

    from tessarion.operators.held import HeldTable

    _, prefix = dense
    held = HeldTable.of(prefix, G)
    radii = [0.0, 700.0, 1500.0, 5000.0, 10007.5, 20015.0]
    centres = G.rows(spark).select(F.col("row").alias("centre_row"), F.explode(F.array(*[F.lit(r) for r in radii])).alias("radius_km"))
    want = {(r["centre_row"], r["radius_km"], r["row"]): r["half_width"] for r in disc.kernels(G, centres).collect()}
    got = {(row, km, int(r)): int(h) for row in range(G.height) for km in radii for r, h in zip(*held.kernel(row, km))}
    assert got == want


def test_running_sums_keep_what_rounding_loses():
    import math

    import numpy as np

    from tessarion.functions.sums import running

    rng = np.random.default_rng(3)
    for x in (rng.random(43_200) * 1e4, 10.0 ** rng.uniform(-8, 8, 43_200), np.where(np.arange(5000) % 2, 1e16, 1.0)):
        x = x.astype(np.float32).astype(np.float64)
        got = running(x)
        for n in (1, 2, 77, 4_999, len(x)):
            true = math.fsum(x[:n])
            assert abs(got[n - 1] - true) <= np.spacing(true)
    whole = np.arange(1, 43_201, dtype=np.float64)
    assert (running(whole) == np.cumsum(whole)).all()


def test_discs_of_fractions_stay_within_the_slack(spark):
    """A raster whose values aren't whole and whose total is that of the world: computed discs against exact sums."""
    import math

    import numpy as np

    from tessarion.operators.held import HeldTable

    rng = np.random.default_rng(4)
    values = (rng.random((G.height, G.width)) ** 8 * 1e9 / 7).astype(np.float32)
    rows = spark.createDataFrame([(r, [float(v) for v in values[r]]) for r in range(G.height)], "row int, values array<float>")
    prefix = table.prefix_rows(rows, G).select("row", "prefix").persist()
    total = math.fsum(values.astype(float).ravel())
    held = HeldTable.of(prefix, G)
    centres = disc.all_centres(spark, G, [2500.0])
    spread = {r["id"]: r["population"] for r in disc.populations(prefix, G, centres).collect()}
    for row in range(0, G.height, 3):
        for col in range(0, G.width, 7):
            at, half = held.kernel(row, 2500.0)
            cells = [float(values[r, (col + k) % G.width]) for r, h in zip(at, half) for k in (range(G.width) if h == G.width // 2 else range(-h, h + 1))]
            true, slack = math.fsum(cells), smallest.predicate_slack(G, total)
            assert abs(held.population(row, col, 2500.0) - true) <= slack and abs(spread[row * G.width + col] - true) <= slack


def test_a_planted_cluster_prunes_most_blocks(spark):
    import numpy as np

    from tessarion.plans.grid import Grid

    grid = Grid.globe(720, 360)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 4, (grid.height, grid.width)).astype(np.float32)
    values[100:104, 500:504] = 5000
    rows = spark.createDataFrame([(r, [float(v) for v in values[r]]) for r in range(grid.height)], "row int, values array<float>")
    prefix = table.prefix_rows(rows, grid).select("row", "prefix").persist()
    found = Searcher(prefix, grid).most_populous(RadiusKm(200.0), 32)
    assert 100 <= found.centre.row <= 103 and 500 <= found.centre.col <= 503
    assert 3 * found.stats.blocks_pruned > 2 * found.stats.blocks_examined


def test_ties_seam_pole_zeros(spark):
    twins = {(r + a, c + b): 100.0 for r, c in ((3, 5), (12, 25)) for a in (0, 1) for b in (0, 1)}
    s = searcher(spark, twins)
    assert {s.most_populous(RadiusKm(1200.0), k).centre.row < 9 for k in (1, 4)} == {True}
    assert searcher(spark, {(9, 35): 100.0, (9, 0): 100.0}).most_populous(RadiusKm(1200.0), 3).centre.population == 200
    pole = searcher(spark, {(0, 0): 100.0, (0, 1): 100.0}).most_populous(RadiusKm(2000.0), 3).centre
    assert (pole.row, pole.population) == (0, 200)
    assert searcher(spark, {}).most_populous(RadiusKm(500.0), 4).centre == Candidate(0, 0, 0.0)
    assert Candidate(1, 1, 5.0).better(Candidate(0, 9, 5.0)) == Candidate(0, 9, 5.0)
    with pytest.raises(KernelError):
        searcher(spark, {}, Grid(4, 3, 45, 0, 1, -1)).most_populous(RadiusKm(5.0), 1)


def test_nan_never_wins(spark):
    rows = spark.createDataFrame([(0, 0, math.nan), (1, 1, 3.0), (1, 0, 3.0)], "row int, col int, population double")
    assert tuple(disc.best(rows).first()) == (1, 0, 3.0)


CLUSTER = {(r, c): 100.0 for r in (8, 9) for c in (15, 16)}


def test_smallest_golden_cluster(spark):
    found = smallest.smallest(searcher(spark, CLUSTER), Share(1.0), 4)
    assert (found.radius_km, found.centre, found.short_below) == (1572, Candidate(8, 15, 400.0), (1571, 300.0))
    assert (found.ambiguity.lowest_km, found.ambiguity.highest_km, found.ambiguity.radii) == (1572, 2048, 7)
    assert (found.stats.radii_evaluated, found.stats.radii_reused) == (22, 0) and found.predicate_slack_persons == pytest.approx(5.6914473134384025e-12)
    assert tuple(vars(found.stats.searched).values()) == (66, 8214, 6320, 1894, 792)


def test_sweep_golden(dense):
    _, prefix = dense
    s, ledger = Searcher(prefix, G), MemoryLedger()
    got = [smallest.smallest(s, Share.from_percent(p), 4, ledger) for p in (30, 20, 10)]
    assert [(x.radius_km, x.centre.population, x.short_below[1]) for x in got] == [(3329, 63665.0, 62580.0), (2199, 42366.0, 41205.0), (1108, 22085.0, 20856.0)]
    assert [(x.stats.radii_evaluated, x.stats.radii_reused) for x in got] == [(24, 0), (10, 14), (10, 12)]
    assert [tuple(vars(x.stats.searched).values()) for x in got] == [(72, 14200, 10453, 3747, 921), (30, 3690, 2688, 1002, 290), (30, 6666, 4919, 1747, 428)]
    assert len(ledger.radii) == 44
    ordered = smallest.sweep(s, [20, 10], 4, ledger)
    assert [x.radius_km for x in ordered] == [1108, 2199] and all(not x.stats.radii_evaluated for x in ordered)


def test_ceiling(dense):
    _, prefix = dense
    found = smallest.smallest(Searcher(prefix, G), Share(1.0), 9)
    assert (found.radius_km, found.centre, found.covers_whole_grid, found.short_below) == (20_016, Candidate(0, 0, 210276.0), True, (20_015, 210275.0))


def test_one_pass_and_brackets_agree(spark, dense):
    cells, prefix = dense
    got = {r["share"]: r["radius_km"] for r in smallest.radii_for_shares(cells, G, [0.1, 0.2, 0.5, 1.0]).collect()}
    assert got == {0.1: 1108, 0.2: 2199, 0.5: 5770, 1.0: 20016}
    assert smallest.smallest_by_bracket(prefix, G, Share(0.5)) == (5770, Candidate(*[getattr(smallest.smallest(Searcher(prefix, G), Share(0.5), 4).centre, k) for k in ("row", "col")], 105623.0))


def test_shares_and_sweeps():
    for bad in (0.0, -0.1, 1.1, math.nan):
        with pytest.raises(ShareError):
            Share(bad)
    assert len(smallest.sweep_percents(10, 90, 10)) == len(smallest.sweep_percents(10, 95, 10)) == 9 and smallest.sweep_percents(100, 100, 5) == [100]
    for bad in ((10, 90, 0), (0, 10, 5), (90, 150, 10), (60, 40, 5)):
        with pytest.raises(SweepError):
            smallest.sweep_percents(*bad)
    assert smallest.share_of(5, 0) == 0 and smallest.within_slack(-1.0, 1.0)
    assert smallest.predicate_slack(G, 210276.0) == 2.9359075170987126e-09


def test_ledger_resumes_and_refuses(spark, dense, tmp_path):
    _, prefix = dense
    identity = Identity("0x0000000000000001", 1, G)
    path = str(tmp_path / "radii.json")
    cold = smallest.smallest(Searcher(prefix, G), Share(0.1), 4, smallest.Ledger(spark, path, identity))
    warm = smallest.smallest(Searcher(prefix, G), Share(0.1), 4, smallest.Ledger(spark, path, identity))
    assert warm.stats.radii_evaluated == 0 and (warm.radius_km, warm.centre) == (cold.radius_km, cold.centre)
    assert smallest.Ledger(spark, path, identity).frame().count() == cold.stats.radii_evaluated
    text = (tmp_path / "radii.json").read_text()
    import json

    found = json.loads(text)
    for change, kind in (({"digest": "0x2"}, "not_this_table"), ({"format": 9}, "format"), ({"radii": found["radii"][:1] * 2}, "duplicate_radius"), ({"radii": [{"km": 1, "population": 1.0, "row": 99, "col": 0}]}, "centre_off_grid")):
        (tmp_path / "radii.json").write_text(json.dumps(found | change))
        with pytest.raises(LedgerError) as e:
            smallest.Ledger(spark, path, identity)
        assert e.value.kind == kind
    (tmp_path / "radii.json").write_text("{")
    with pytest.raises(LedgerError):
        smallest.Ledger(spark, path, identity)
    (tmp_path / "radii.json").write_text(text)
    (tmp_path / "radii.json.tmp").write_text("")
    with pytest.raises(LedgerError) as e:
        smallest.Ledger(spark, path, identity).put(5, Candidate(0, 0, 1.0))
    assert e.value.kind == "temporary_held"


def test_published_tables(spark, tmp_path):
    raw = table.pack_rows(patch(spark, CLUSTER))
    built = table.publish(raw, G, str(tmp_path / "t"), 2)
    assert built.total == 400 and built.tallies["populated"] == 4
    prefix = table.open_table(spark, str(tmp_path / "t"), built.identity)
    whole = table.publish(raw, G, str(tmp_path / "w"))
    assert whole.identity.digest == built.identity.digest and whole.total == 400
    with pytest.raises(Exception, match="raster rows of 2"):
        table.publish(raw.where("row > 0"), G, str(tmp_path / "x"), 2)
    assert prefix.count() == 9 and "PushedFilters" in prefix.where("row = 3")._jdf.queryExecution().toString()
    for other, name in ((Identity(built.identity.digest, 1, G), "width"), (Identity("0x0", 2, G.decimated(2)), "digest")):
        with pytest.raises(CacheError, match=name):
            table.open_table(spark, str(tmp_path / "t"), other)
    turned = Grid(18, 9, 90.0, 180.0, 20.0, -20.0)
    assert table.open_table(spark, str(tmp_path / "t"), Identity(built.identity.digest, 2, turned)).count() == 9
    with pytest.raises(CacheError) as e:
        table.open_table(spark, str(tmp_path / "none"), built.identity)
    assert e.value.kind == "absent"
    with pytest.raises(Exception, match="already exists|ALREADY"):
        table.publish(raw, G, str(tmp_path / "t"), 2)


def test_streamed_rows_equal_batch(spark):
    packed = spark.createDataFrame([(0, [1.0, float(N), math.nan, -3.0, 2.5])], "row int, values array<float>")
    assert streaming.row_prefixes(packed, Grid(5, 1, 90, -180, 72, -180)).first()["prefix"] == [0, 1, 1, 1, 1, 3.5]


def test_plans(spark, dense):
    cells, prefix = dense
    text = disc.populations(prefix, G, disc.all_centres(spark, G, [500.0]))._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text
