import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarion.functions import geodesy
from tessarion.functions.geodesy import RadiusError, RadiusKm
from tessarion.operators.search import tile
from tessarion.operators import table
from tessarion.plans.grid import ColSpan, DecimationError, Grid, GridError, KernelError, Window

LAT, LON = st.floats(-90, 90), st.floats(-720, 720)


@pytest.mark.parametrize("a,b,angle,tolerance", [((38.898, -77.037), (48.858, 2.294), math.radians(55.411), 1e-5), ((-33, -71.6), (31.4, 121.8), math.radians(168.56), 5e-5), ((33.95, -118.4), (40.6333, -73.7833), 0.623585, 2e-6)])
def test_published_angles(spark, a, b, angle, tolerance):
    assert geodesy.central_angle_at(*a, *b) == pytest.approx(angle, rel=tolerance)
    got = spark.range(1).select(geodesy.central_angle(*[F.lit(float(x)) for x in (*a, *b)]).alias("x")).first()["x"]
    assert got == pytest.approx(geodesy.central_angle_at(*a, *b), rel=1e-14)


def test_published_distance():
    assert geodesy.great_circle_km_at(50.0782, 8.2398, 41.9028, 12.4964) == pytest.approx(966.3013398709427, rel=1e-14)
    assert geodesy.great_circle_km_at(0, 0, 0, 180) == pytest.approx(math.pi * geodesy.EARTH_RADIUS_KM)


@given(LAT, LON, LAT, LON, LAT, LON)
def test_distance_is_a_metric(a, b, c, d, e, f):
    x, y, z = geodesy.central_angle_at(a, b, c, d), geodesy.central_angle_at(c, d, e, f), geodesy.central_angle_at(a, b, e, f)
    assert x == pytest.approx(geodesy.central_angle_at(c, d, a, b), abs=1e-9) and z <= x + y + 1e-7 and 0 <= x <= math.pi


def test_radius():
    for bad, kind in ((math.nan, "non_finite"), (math.inf, "non_finite"), (-1.0, "negative")):
        with pytest.raises(RadiusError) as e:
            RadiusKm(bad)
        assert e.value.kind == kind
    assert RadiusKm(5.0).widened_by(2.0).km == 7 and RadiusKm(5.0).widened_by(-2.0).km == 5 and RadiusKm(5.0).widened_by(math.inf).km > 1e300


@pytest.mark.parametrize(
    "args,kind",
    [
        ((0, 1, 90, 0, 1, -1), "empty_dimension"), ((1, 1, math.nan, 0, 1, -1), "non_finite_origin"), ((1, 1, 91, 0, 1, -1), "origin_lat_out_of_range"),
        ((1, 1, 90, 0, math.inf, -1), "non_finite_step"), ((1, 1, 90, 0, 0, -1), "zero_step"), ((1, 1, 0, 0, 1, 1), "lat_step_not_southward"),
        ((1, 19, 90, 0, 1, -10), "runs_past_south_pole"), ((37, 1, 90, 0, -10, -10), "runs_past_a_full_turn"),
    ],
)
def test_grid_refusals(args, kind):
    with pytest.raises(GridError) as e:
        Grid(*args)
    assert e.value.kind == kind


@given(st.integers(1, 90), st.integers(1, 60), st.booleans(), st.data())
def test_centres_round_trip(width, height, west, data):
    g = Grid(width, height, 90.0, data.draw(st.floats(-600, 600)), (-1 if west else 1) * 360 / width, -180 / height)
    row, col = data.draw(st.integers(0, height - 1)), data.draw(st.integers(0, width - 1))
    assert g.cell_containing(g.centre_lat_at(row), g.centre_lon_at(col)) == (row, col)


def test_cells_on_edges_and_columns_agree_with_scalars(spark):
    for g in (Grid.globe(36, 18), Grid(36, 18, 90.0, -180.0, -10.0, -10.0), Grid(40, 10, 45.0, 170.0, 1 / 3, -2.0)):
        points = [(float(a), float(o)) for a in (-90, -80, 0, 15, 45, 44.9, 90, math.nan, math.inf) for o in (-540, -180, -10, 0, 3.3, 175, 179.999, 180, 360, math.nan, math.inf)]
        rows = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lon double").select("k", g.cell_of(F.col("lat"), F.col("lon")).alias("x")).collect()
        for r in rows:
            want = g.cell_containing(*points[r["k"]])
            assert (None if r["x"] is None else tuple(r["x"])) == want, points[r["k"]]
    assert Grid.globe(36, 18).cell_containing(-90, 0) is None and Grid.globe(36, 18).cell_containing(90, 180) == (0, 0)
    assert Grid.globe(36, 18).col_along(0, -1) == 35 and Grid.globe(36, 18).row(18) is None


def test_windows_and_spans():
    g = Grid.globe(36, 18)
    assert g.covering(Window(55, -12, -31, 47.5)) == ((3, 10), ColSpan(14, 22))
    assert g.covering(Window(55, -12, -180, 180))[1].full_turn and g.covering(Window(55, -90, 0, 1)) is None
    assert g.covering(Window(10, 0, 170, -170))[1].ranges(36) == [(35, 35), (0, 1)]
    assert ColSpan(0, 35, True).ranges(36) == [(0, 35)]
    with pytest.raises(KernelError):
        Grid(10, 10, 45, 0, 1, -1).require_closed()
    with pytest.raises(DecimationError):
        Grid.globe(12, 6).decimated(4)
    assert sum(Grid.globe(36, 18).cell_area_km2_at(r) * 36 for r in range(18)) == pytest.approx(4 * math.pi * geodesy.EARTH_RADIUS_KM**2)


@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 50))
@settings(max_examples=40)
def test_tiles_and_splits_cover_once(width, height, spacing):
    g = Grid.globe(width, height)
    cells = lambda blocks: sorted((r, c) for b in blocks for r in range(b.north, b.south + 1) for c in range(b.first, b.last + 1))
    every = [(r, c) for r in range(height) for c in range(width)]
    blocks = tile(g, spacing)
    assert cells(blocks) == every
    for b in blocks[:3]:
        assert not b.split() or cells(b.split()) == cells([b])
        assert bool(b.split()) == ((b.north, b.first) != (b.south, b.last))


def test_digest_text():
    assert table.parse_digest("0x3a5d5e3b082f2fb7") == table.parse_digest("3A5D5E3B082F2FB7") == 0x3A5D5E3B082F2FB7
    assert table.hexadecimal(5) == "0x0000000000000005"
    with pytest.raises(ValueError):
        table.parse_digest("0x12")
