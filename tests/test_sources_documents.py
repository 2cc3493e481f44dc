import hashlib
import io
import json
import struct

import pytest

from tessarion import __main__ as cli
from tessarion.functions.geodesy import great_circle_km_at
from tessarion.operators import figures, table
from tessarion.plans import documents
from tessarion.plans.errors import BadInput, MissingData, exit_code
from tessarion.plans.grid import Grid, GridError
from tessarion.sources import corpus, geotiff, raster, registry

G = Grid.globe(12, 6)
SPEC = geotiff.RasterSpec.of(G)


def lzw(data: bytes) -> bytes:
    """Packs 9 to 12 bit codes, most significant bit first."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table_ = {bytes([k]): k for k in range(256)}
    nxt = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table_:
            word += c
            continue
        put(table_[word])
        table_[word + c] = nxt
        nxt += 1
        if nxt >= (1 << width):
            width += 1
        if nxt == 4094:
            put(256)
            table_, nxt, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    put(table_[word])
    nxt += 1
    if nxt >= (1 << width) and width < 12:
        width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def tiff(values, order="<", compression=1, rows_per_strip=4, drop=(), **change):
    h, w = len(values), len(values[0])
    strips = []
    for k in range(0, h, rows_per_strip):
        raw = b"".join(struct.pack(f"{order}{w}f", *row) for row in values[k : k + rows_per_strip])
        strips.append(lzw(raw) if compression == 5 else raw)
    tags = {
        256: ("H", [w]), 257: ("H", [h]), 258: ("H", [32]), 259: ("H", [compression]), 277: ("H", [1]), 278: ("H", [rows_per_strip]), 279: ("I", [len(s) for s in strips]), 339: ("H", [3]),
        33550: ("d", [30.0, 30.0, 0.0]), 33922: ("d", [0, 0, 0, -180.0, 90.0, 0]),
        34735: ("H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]), 42113: ("s", "-3.40282306073709653e+38"), 273: ("I", [0] * len(strips)),
    }
    tags.update({int(k[1:]): v for k, v in change.items()})
    tags = {k: v for k, v in sorted(tags.items()) if k not in drop}
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    body = io.BytesIO()
    at = 8 + 2 + 12 * len(tags) + 4
    payload = b""
    spots = []
    base = at + sum(max(0, len(struct.pack(order + (f"{len(v)}{k}" if k != "s" else f"{len(v) + 1}s"), *(v if k != "s" else [v.encode() + b"\0"]))) if True else 0) for k, v in tags.values())
    for s in strips:
        spots.append(base + len(payload))
        payload += s
    if 273 in tags:
        tags[273] = ("I", spots)
    body.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)))
    extra = b""
    for tag, (kind, v) in tags.items():
        data = v.encode() + b"\0" if kind == "s" else struct.pack(f"{order}{len(v)}{kind}", *v)
        n = len(data) if kind == "s" else len(v)
        if len(data) <= 4:
            body.write(struct.pack(order + "HHI", tag, codes[kind], n) + data.ljust(4, b"\0"))
        else:
            body.write(struct.pack(order + "HHII", tag, codes[kind], n, at + len(extra)))
            extra += data
    body.write(struct.pack(order + "I", 0) + extra)
    out = body.getvalue()
    return out.ljust(base, b"\0") + payload


VALUES = [[float(r * 12 + c) if (r + c) % 5 else raster.NODATA for c in range(12)] for r in range(6)]


@pytest.mark.parametrize("order,compression,per", [("<", 1, 4), (">", 1, 1), ("<", 5, 6), (">", 5, 4)])
def test_geotiff_cells(spark, tmp_path, order, compression, per):
    (tmp_path / "a.tif").write_bytes(tiff(VALUES, order, compression, per))
    got = geotiff.read(spark, str(tmp_path / "a.tif"), SPEC, strips=1)
    assert got.rdd.getNumPartitions() == -(-6 // per)
    cells = {(r["row"], r["col"]): r["value"] for r in geotiff.cells(spark, str(tmp_path / "a.tif"), SPEC).collect()}
    assert cells == {(r, c): pytest.approx(VALUES[r][c]) for r in range(6) for c in range(12)}


def test_lzw_over_many_codes():
    import random

    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdefgh") for _ in range(60_000))
    assert geotiff.unlzw(lzw(data), len(data)) == data


@pytest.mark.parametrize(
    "kind,options",
    [
        ("layout", {"t322": ("H", [16])}), ("samples_per_pixel", {"t277": ("H", [3])}), ("pixel_format", {"t339": ("H", [1])}), ("pixel_format", {"t258": ("H", [16])}),
        ("model_type", {"t34735": ("H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 2048, 0, 1, 4326])}), ("raster_type", {"t34735": ("H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 2, 2048, 0, 1, 4326])}),
        ("epsg", {"t34735": ("H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4258])}), ("missing_geo_key", {"t34735": ("H", [1, 1, 0, 1, 1024, 0, 1, 2])}), ("missing_tag", {"drop": (34735,)}),
        ("nodata_missing", {"drop": (42113,)}), ("nodata_not_a_number", {"t42113": ("s", "none")}), ("nodata_mismatch", {"t42113": ("s", "-9999")}), ("dimensions", {"t257": ("H", [5])}),
        ("missing_tag", {"drop": (33550,)}), ("missing_tag", {"drop": (33922,)}), ("transformation", {"t34264": ("d", [0.0] * 16)}), ("step", {"t33550": ("d", [30.1, 30.0, 0.0])}),
        ("origin", {"t33922": ("d", [0, 0, 0, -170.0, 90.0, 0])}), ("decode", {"t259": ("H", [7])}), ("decode", {"t317": ("H", [2])}),
    ],
)
def test_geotiff_refusals(tmp_path, kind, options):
    (tmp_path / "a.tif").write_bytes(tiff(VALUES, **options))
    with pytest.raises(raster.RasterError) as e:
        geotiff.check(str(tmp_path / "a.tif"), SPEC)
    assert e.value.kind == kind


def test_geotiff_origin_through_the_seam_absent_and_short(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(VALUES, t33922=("d", [2, 1, 0, 240.0, 60.0, 0])))
    geotiff.check(str(tmp_path / "a.tif"), SPEC)
    for content, kind in ((None, "absent"), (b"no", "decode"), (b"II" + bytes(20), "decode")):
        path = tmp_path / f"{kind}{len(content or b'')}.tif"
        if content is not None:
            path.write_bytes(content)
        with pytest.raises(raster.RasterError) as e:
            geotiff.check(str(path), SPEC)
        assert e.value.kind == kind
    (tmp_path / "s.tif").write_bytes(tiff(VALUES)[:-40])
    with pytest.raises(Exception, match="strip 1 holds"):
        geotiff.read(spark, str(tmp_path / "s.tif"), SPEC).count()


REGISTRY = """
[datasets.people]
kind = "population-raster"
path = "data/people.tif"
bytes = {bytes}
sha256 = "{sha}"
source_url = "https://example.org/people"
fetch_url = "https://example.org/people.tif"
licence = "CC BY 4.0"
licence_url = "https://example.org/licence"
attribution = "The people who counted."
width = 12
height = 6
origin_lat = 90.0
origin_lon = -180.0
lat_step = -30.0
lon_step = 30.0
epsg = 4326
nodata = -3.40282306073709653e38

[datasets.coast]
kind = "boundary-vector"
path = "data/coast.geojson"
bytes = 1
sha256 = "00"
source_url = "https://example.org/coast"
licence = "public domain"
licence_url = "https://example.org/terms"
"""


@pytest.fixture()
def place(tmp_path):
    content = tiff(VALUES)
    (tmp_path / "registry.toml").write_text(REGISTRY.format(bytes=len(content), sha=hashlib.sha256(content).hexdigest()))
    return tmp_path, content


def test_registry_and_fetch(spark, place):
    root, content = place
    found = registry.load(str(root / "registry.toml"))
    assert list(found) == ["coast", "people"] and registry.grid_of(registry.raster(found, "people")) == G
    assert registry.frame(spark, found).where("kind = 'population-raster'").count() == 1
    for key, kind in (("none", "unknown_dataset"), ("coast", "not_a_raster")):
        with pytest.raises(registry.RegistryError) as e:
            registry.raster(found, key)
        assert e.value.kind == kind
    for text, kind in (("x", "syntax"), (REGISTRY.format(bytes=1, sha="0").replace("people.tif\"\nbytes", "other.tif\"\nbytes"), "key_is_not_the_stem"), (REGISTRY.format(bytes=1, sha="0").replace("width = 12", ""), "syntax")):
        with pytest.raises(registry.RegistryError) as e:
            registry.parse(text)
        assert e.value.kind == kind
    assert registry.acquire(found, str(root), lambda url: io.BytesIO(content)) == ["people"]
    assert registry.acquire(found, str(root)) == []
    row = registry.verified(spark, [str(root / "data/people.tif")]).first()
    assert (row["bytes"], row["sha256"]) == (len(content), found["people"]["sha256"])
    (root / "data/people.tif").unlink()
    with pytest.raises(registry.FetchError):
        registry.acquire(found, str(root), lambda url: io.BytesIO(content + b"x"))
    assert not list((root / "data").iterdir())
    with pytest.raises(registry.FetchError):
        registry.acquire({"people": found["people"] | {"fetch_url": "http://example.org"}}, str(root))
    docs = spark.createDataFrame([("people",), ("none",)], "dataset string")
    assert registry.attributions(docs.limit(1), registry.frame(spark, found)).first()["attribution"] == "The people who counted."
    with pytest.raises(Exception, match="isn't registered"):
        registry.attributions(docs, registry.frame(spark, found)).count()


def grid_args(g):
    return f"--width {g.width} --height {g.height} --origin-lat {g.origin_lat} --origin-lon {g.origin_lon} --lon-step {g.lon_step} --lat-step {g.lat_step}"


def test_commands_end_to_end(spark, place, capsys, tmp_path):
    root, content = place
    (root / "data").mkdir()
    (root / "data/people.tif").write_bytes(content)

    def run(line):
        code = cli.main(line.split())
        out = capsys.readouterr().out
        return code, json.loads(out) if out else None

    code, built = run(f"table build --registry {root}/registry.toml --dataset people --root {root} --cache {tmp_path}/cache")
    assert code == 0 and built["document"] == "table-build" and list(built) == ["schema_version", "document", "tool", "tool_version", "earth_model", "provenance", "result"]
    total = sum(v for row in VALUES for v in row if v > 0)
    assert built["result"]["total_population"] == total and sum(v for k, v in built["result"]["cells"].items() if k != "total") == 72
    opened = f"--cache {tmp_path}/cache --digest {built['result']['digest']} --dataset people --registry {root}/registry.toml {grid_args(G)}"
    code, doc = run(f"table query {opened}")
    assert code == 0 and doc["result"]["population"] == total and "window" not in doc["result"]
    code, doc = run(f"table query {opened} --north 45 --south 20 --west 100 --east -100")
    assert code == 0 and doc["result"]["columns"] == {"west": 9, "east": 2, "full_turn": False}
    assert run(f"table query {opened} --north 45")[0] == 2 and run(f"table query {opened} --north 45 --south -90 --west 1 --east 2")[0] == 2
    assert run(f"table query {opened.replace(built['result']['digest'], '0x' + '0' * 16)}")[0] == 3
    code, circle = run(f"population-at {opened} --lat 10 --lon 20 --radius-km 3500")
    assert code == 0 and circle["result"]["row"] == 2 and 0 < circle["result"]["share_of_total"] < 1 and circle["provenance"]["dataset"] == "people"
    assert run(f"population-at {opened} --lat 99 --lon 20 --radius-km 3500")[0] == 2 and run(f"population-at {opened} --lat 9 --lon 20 --radius-km -1")[0] == 2
    code, most = run(f"most-populous {opened} --radius-km 3500 --spacing 3")
    assert code == 0 and most["result"]["population"] >= circle["result"]["population"]
    code, least = run(f"smallest-for-share {opened} --share 40 --spacing 3 --ledger {tmp_path}/radii.json")
    assert code == 0 and least["result"]["circle"]["share_achieved"] >= 0.4
    code, swept = run(f"sweep {opened} --from 20 --to 40 --step 20 --spacing 3 --ledger {tmp_path}/radii.json")
    assert code == 0 and [r["target"]["share"] for r in swept["result"]["records"]] == [0.2, 0.4] and swept["result"]["records"][1]["stats"]["radii_evaluated"] == 0
    assert run(f"sweep {opened} --from 20 --to 40 --step 0 --spacing 3 --ledger x")[0] == 2
    assert run("table build --registry nowhere --dataset people --cache x")[0] == 1

    docs = tmp_path / "docs"
    docs.mkdir()
    for name, d in (("a", circle), ("b", most), ("c", least), ("d", built)):
        (docs / f"{name}.json").write_text(documents.dumps(d))
    assert run(f"render gallery --input {docs} --output {tmp_path}/out --registry {root}/registry.toml")[0] == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.json", "a.svg", "b.json", "b.svg", "c.json", "c.svg", "index.html"]
    assert "The people who counted." in (tmp_path / "out/a.svg").read_text() and "a.svg" in (tmp_path / "out/index.html").read_text()
    (tmp_path / "coast.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [10, 5], [20, 0]]}}]}))
    assert run(f"render map --input {docs}/b.json --output {tmp_path}/m.svg --registry {root}/registry.toml --projection orthographic --coastlines {tmp_path}/coast.geojson")[0] == 0
    assert run(f"render map --input {docs}/d.json --output {tmp_path}/m.svg --registry {root}/registry.toml")[0] == 2
    assert [r["name"] for r in corpus.circles(corpus.documents(spark, str(docs))).collect()] == ["a", "b", "c"]


def test_circle_of_refusals():
    good = {"schema_version": 1, "document": "circle", "earth_model": {"model": "sphere", "radius_km": 1.0}, "provenance": {"dataset": "d", "digest": "0x1", "decimation": 2}, "result": {"centre": {"lat": 1, "lon": 2}, "radius_km": 3, "population": 4, "share_of_total": 0.5}, "unknown": 1}
    assert documents.circle_of(good).table == "0x1 (1:2)"
    for change, error in (({"schema_version": 2}, BadInput), ({"document": "sweep"}, BadInput), ({"earth_model": {"model": "ellipsoid"}}, BadInput), ({"provenance": None}, MissingData), ({"provenance": {"dataset": "d"}}, MissingData), ({"result": {}}, BadInput)):
        with pytest.raises(error):
            documents.circle_of(good | change)
    with pytest.raises(BadInput):
        documents.envelope("none", {})
    assert exit_code(GridError("zero_step", "")) == 2 and exit_code(table.CacheError("absent")) == 3 and exit_code(RuntimeError()) == 1


CAPS = [(10.0, 178.0, 3000.0, []), (78.0, 20.0, 3000.0, [90.0]), (-80.0, -170.0, 4000.0, [-90.0]), (25.125, 79.708, 16384.0, [-90.0, 90.0]), (30.0, 100.0, 3300.0, []), (10.0, 1.0, 16384.0, [-90.0, 90.0]), (-35.0, 170.0, 12000.0, [-90.0]), (0.0, 0.0, 10100.0, [-90.0, 90.0])]


@pytest.mark.parametrize("lat,lon,km,poles", CAPS)
def test_caps(spark, lat, lon, km, poles):
    ring = figures.boundary(spark, lat, lon, km).collect()
    assert len(ring) == 721 and all(great_circle_km_at(lat, lon, r["lat"], r["lon"]) == pytest.approx(km, rel=1e-9) for r in ring)
    assert figures.enclosed_poles(lat, km) == poles
    shape = figures.geographic(spark, lat, lon, km)
    assert all(-180 <= x <= 180 and -90 <= y <= 90 for part in shape for r in part for x, y in r)

    def inside(x, y):
        hit = False
        for part in shape:
            for r in part:
                for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
                    if (y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0):
                        hit = not hit
        return hit

    for y in range(-85, 90, 10):
        for x in range(-175, 180, 10):
            d = great_circle_km_at(lat, lon, y + 0.3, x + 0.7)
            if abs(d - km) > 60:
                assert inside(x + 0.7, y + 0.3) == (d < km), (x, y)


def test_frames(spark):
    with pytest.raises(BadInput):
        figures.framed(figures.graticule(spark), "mercator")
    seen = figures.framed(figures.graticule(spark), "orthographic", 0.0, 0.0)
    assert seen.where("visible and abs(lon) > 90.001 and abs(lat) < 90").count() == 0 and figures.graticule(spark).count() == 13 * 91 + 5 * 181


def test_lines_are_cut_at_the_horizon(spark):
    out = figures._paths([("a", 0.0, 0.0, 1.0), ("a", 6000.0, 0.0, 0.5), ("a", 6300.0, 0.0, -0.5), ("a", 6000.0, 0.0, -1.0), ("b", 1.0, 1.0, -1.0)], 1.0, 0.0, 0.0)
    assert out == f"M0.00 0.00L6000.00 0.00L{figures.EARTH_RADIUS_KM:.2f} 0.00"


def test_coastlines_of_every_kind(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    kinds = {"LineString": ring, "MultiLineString": [ring, ring], "Polygon": [ring, ring], "MultiPolygon": [[ring], [ring, ring]], "Point": [0, 0]}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}} for k, c in kinds.items()]}))
    got = figures.coastlines(spark, str(tmp_path / "c.geojson")).collect()
    assert len(got) == 8 * 4 and len({r["feature"] for r in got}) == 8 and {(r["lon"], r["lat"]) for r in got} == {(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)}


def test_progress_meter_and_job_descriptions(spark):
    from tessarion.plans.progress import Meter, described

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    screen = Terminal()
    meter = Meter(screen, 10)
    for k in range(5):
        meter.advance(k, 4)
    assert screen.getvalue().endswith("\r[##########] 4 of 4\n") and screen.getvalue().startswith("\r[..........] 0 of 4")
    with described(spark, "a search"):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "a search"
    assert spark.sparkContext.getLocalProperty("spark.job.description") != "a search"
