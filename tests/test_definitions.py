"""Operators against definitions written in numpy, anchors and properties."""

import math
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import exprs as X
from pixelmill.functions import spaces as S
from pixelmill.operators import geometry, lut, metering, stats
from pixelmill.operators import pixels as P
from pixelmill.plans import cli
from pixelmill.plans.develop import Params, messages, process_path
from pixelmill.sources import cube, images, lens_db, sinks
from pixelmill.streaming import events as E

PX = "image_id long, y int, x int, r double, g double, b double"


def frame(spark, *arrays):
    rows = [(k, y, x, *map(float, a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PX)


def grid(df):
    p = df.toPandas()
    a = np.zeros((p.y.max() + 1, p.x.max() + 1, 3))
    for i, c in enumerate("rgb"):
        a[p.y, p.x, i] = p[c]
    return a


def lum(a):
    return a @ np.array(S.luminance_row())


def test_matrices():
    assert np.allclose(S.luminance_row(), (0.288071128, 0.711843218, 0.0000856539606), atol=1e-8)
    for g in X.CURVES and S.PRIMARIES:
        if g != "ProPhoto":
            assert np.allclose(S.gamut_matrix(g).sum(1), 1)
    with pytest.raises(ValueError):
        S.resolve("no log")
    assert S.resolve("v-log")[1:] == ("V-Gamut", "V-Log")


@pytest.mark.parametrize(
    ("curve", "code"),
    [("F-Log", 469.9), ("F-Log2", 400.0), ("V-Log", 433.0), ("N-Log", 372.0), ("L-Log", 445.3), ("S-Log3", 420.0), ("Arri LogC3", 400.0), ("D-Log", 407.9), ("Arri LogC4", 284.8), ("Log3G10", 341.0), ("Canon Log 2", 407.5), ("Canon Log 3", 351.2)],
)
def test_grey_anchor(spark, curve, code):
    got = spark.sql(f"select 1023*({X.log_curve(curve, '0.18e0')}) v").first()["v"]
    assert abs(got - code) < 0.3


def test_tetrahedral_six_branches(spark):
    r = np.random.default_rng(3)
    table, pts = r.random((5, 5, 5, 3)), np.round(r.random((1, 400, 3)) * 1.2 - 0.1, 2)
    got = grid(lut.apply_3d(frame(spark, pts), lut.Lut3D(table)))[0]
    for v, out in zip(pts[0], got, strict=True):
        i = np.clip(v * 4, 0, 4)
        n = np.floor(i).astype(int)
        d, m = i - n, np.minimum(np.floor(i).astype(int) + 1, 4)
        order = np.argsort(-d, kind="stable")
        node, want = n.copy(), table[tuple(n)] * (1 - d[order[0]])
        for k, axis in enumerate(order):
            node[axis] = m[axis]
            want = want + table[tuple(node)] * (d[axis] - (d[order[k + 1]] if k < 2 else 0))
        assert np.allclose(out, want, atol=1e-12)


def test_identity_lut(spark):
    i = np.linspace(0, 1, 9)
    table = np.stack(np.meshgrid(i, i, i, indexing="ij"), -1)
    a = np.random.default_rng(1).random((4, 5, 3))
    assert np.allclose(grid(lut.apply_3d(frame(spark, a), lut.Lut3D(table))), a)
    assert np.allclose(grid(lut.apply_1d(frame(spark, a), lut.Lut1D(np.repeat(i[:, None], 3, 1)))), a)


def test_metering_by_numpy(spark):
    r = np.random.default_rng(7)
    a, dark, tiny = r.random((23, 31, 3)) * 1.3, np.zeros((9, 9, 3)), r.random((6, 9, 3)) * 0.3
    px = frame(spark, a, dark, tiny)
    gains = {m: {x.image_id: x.gain for x in metering.meter(px, m).collect()} for m in metering.STRATEGIES}
    assert all(math.isfinite(v) for g in gains.values() for v in g.values())
    lums, top = lum(a), np.percentile(a.max(2), 99)
    geo = np.exp(np.mean(np.log(np.maximum(lums, 1e-10) + 1e-6)))
    assert np.isclose(gains["average"][0], np.clip(0.18 / geo, 1, 50))
    assert np.isclose(gains["highlight-safe"][0], 0.9 / top)
    g = 0.18 / (geo + 1e-6)
    assert np.isclose(gains["hybrid"][0], np.clip(6 / top if top * g > 6 else g, 0.1, 100))
    yy, xx = np.mgrid[0:23, 0:31]
    w = np.exp(-((xx - 15.5) ** 2 + (yy - 11.5) ** 2) / (2 * 11.5**2))
    assert np.isclose(gains["center-weighted"][0], np.clip(0.18 / np.average(lums, weights=w), 0.1, 100))
    cells = lums[:21, :28].reshape(7, 3, 7, 4).mean((1, 3))
    jj, ii = np.meshgrid(range(7), range(7))
    w = 1 + 1.5 * np.exp(-((jj - 3) ** 2 + (ii - 3) ** 2) / (2 * 2.8**2))
    w = w * np.where(cells > np.percentile(cells, 90), 0.2, 1) * np.where(cells < np.percentile(cells, 10), 1.2, 1)
    assert np.isclose(gains["matrix"][0], np.clip(0.18 / np.average(cells, weights=w), 0.1, 100))
    assert gains["matrix"][2] == 1.0
    with pytest.raises(ValueError):
        metering.meter(px, "nothing")


def test_look_and_display(spark):
    a = np.full((2, 2, 3), 0.18)
    assert np.allclose(grid(P.boost(frame(spark, a))), a)
    ends = frame(spark, np.array([[[0.0] * 3, [1.0] * 3]]))
    assert np.allclose(grid(P.display_srgb(ends)), [[[0] * 3, [1] * 3]])
    assert grid(P.quantize(frame(spark, np.full((1, 1, 3), 0.99999)))).max() == 65534


def test_histogram(spark):
    a = np.random.default_rng(5).random((20, 20, 3)) * 1.2 - 0.1
    a[0, 0] = 1.0
    h = stats.histogram(frame(spark, a)).toPandas()
    for i, c in enumerate("rgb"):
        got = h[h.channel == c].sort_values("bin").n.to_numpy()
        assert (got == np.histogram(a[..., i], bins=128, range=(0, 1))[0]).all()


def test_geometry(spark):
    a = np.random.default_rng(2).random((8, 11, 3))
    px = frame(spark, a)
    assert np.allclose(grid(geometry.remap_bilinear(px, 0, 0, 0)), a)
    assert np.allclose(grid(geometry.remap_cubic(px, 0, 0, 0)), a)
    assert np.allclose(grid(geometry.devignette(px, 0, 0, 0)), a)
    assert geometry.auto_scale(100, 150, 0.0, 0.0, 0.0) == pytest.approx(1)
    assert geometry.auto_scale(100, 150, 0.05, 0.0, 0.0) > 1 and geometry.auto_scale(100, 150, -0.05, 0.0, 0.0) >= 1


def whole_frame(a, lens):
    """Cubic resampling by the spline's own system of equations over whole rows and columns, mirrored ends."""
    h, w, _ = a.shape

    def system(n):
        m = np.zeros((n, n))
        for i in range(n):
            for d, k in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
                j = abs(i + d)
                m[i, 2 * n - 2 - j if j >= n else j] += k
        return m

    def basis(place, n):
        out = np.zeros((len(place), n))
        for i, v in enumerate(place):
            for j in range(math.floor(v) - 1, math.floor(v) + 3):
                t = abs(v - j)
                m = abs(j)
                out[i, 2 * n - 2 - m if m >= n else m] += 2 / 3 - t * t + t**3 / 2 if t < 1 else max(0.0, 2 - t) ** 3 / 6
        return out

    y, x = (v.ravel() for v in np.mgrid[0:h, 0:w])
    out = np.zeros((h * w, 3))
    for k, (sy, sx) in enumerate(geometry.source_places(y, x, lens)):
        coded = np.linalg.solve(system(w), np.linalg.solve(system(h), a[..., k]).T).T
        ok = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1)
        out[ok, k] = np.einsum("ni,ij,nj->n", basis(sy[ok], h), coded, basis(sx[ok], w))
    return out.reshape(h, w, 3)


@pytest.mark.parametrize("scaled", [False, True])
def test_cubic_over_tiles(spark, monkeypatch, scaled):
    a = np.random.default_rng(6).random((90, 70, 3))
    monkeypatch.setattr(geometry, "TILE", 32)
    warp = {"a": 0.03, "b": -0.06, "c": 0.02, "kr": 1.002, "kb": 0.998}
    scale = geometry.auto_scale(90, 70, 0.03, -0.06, 0.02) if scaled else 1.0
    got = grid(geometry.remap_cubic(frame(spark, a), **warp, scaled=scaled))
    assert np.allclose(got, whole_frame(a, {"h": 90, "w": 70, "scale": scale, **warp}), atol=1e-9)
    assert not scaled or (got != 0).any(-1).all()


def test_correct_lenses(spark):
    a, b = np.random.default_rng(8).random((2, 20, 24, 3))
    px = frame(spark, a, b)
    matched = spark.createDataFrame([(0, "matched", 0.1, 0.02, 1.001), (1, "no lens", None, None, None)], "image_id long, lens_status string, k1 double, a double, kr double")
    matched = matched.selectExpr("*", "cast(null as double) k2", "0e0 k3", "0e0 b", "0e0 c", "cast(null as double) kb")
    done = geometry.correct_lenses(px, matched, P.dims(px)).cache()
    assert np.allclose(grid(done.filter("image_id = 1")), b)
    first = px.filter("image_id = 0")
    want = geometry.remap_cubic(geometry.devignette(first, 0.1, 0, 0), 0.02, 0, 0, 1.001, 1.0, scaled=True)
    assert np.allclose(grid(done.filter("image_id = 0")), grid(want))
    off = geometry.correct_lenses(px, matched, P.dims(px), distortion=False, tca=False)
    assert np.allclose(grid(off.filter("image_id = 0")), grid(geometry.devignette(first, 0.1, 0, 0)))


def test_lens_match(spark):
    lenses = spark.createDataFrame([("A", "cam", "M", "lens", 35.0, 0.1), ("A", "cam", "M", "lens", 50.0, 0.2)], "camera_maker string, camera_model string, lens_maker string, lens_model string, focal double, k1 double")
    for c in ("k2", "k3", "a", "b", "c", "kr", "kb"):
        lenses = lenses.withColumn(c, F.lit(0.0))
    exif = spark.createDataFrame([(1, None, "CAM", "m", "lens", 48.0, 2.0), (2, None, None, None, "lens", 48.0, 2.0), (3, None, "other", None, "lens", 48.0, 2.0)], "image_id long, camera_maker string, camera_model string, lens_maker string, lens_model string, focal_length double, aperture double")
    got = {r.image_id: (r.lens_status, r.k1) for r in geometry.match_lens(exif, lenses).collect()}
    assert got == {1: ("matched", 0.2), 2: ("no exif", None), 3: ("no lens", None)}


def test_cube():
    text = "TITLE x\n# note\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\nDOMAIN_MAX 1 1 1\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    t = cube.parse(text)
    assert (t.table[1, 0, 0] == [1, 0, 0]).all() and (t.table[0, 0, 1] == [0, 0, 1]).all()
    assert cube.parse("LUT_1D_SIZE 2\n0 0 0\n1 1 1").table.shape == (2, 3)
    with pytest.raises(ValueError):
        cube.parse("LUT_3D_SIZE 3\n0 0 0")


def test_tiff_codes():
    a = np.random.default_rng(9).random((70, 5, 3))
    made = sinks.encode_tiff(a)
    n = struct.unpack_from("<H", made, 8)[0]
    tags = {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", made, 10 + 12 * i) for i in range(n))}
    offs, lens = (struct.unpack_from(f"<{tags[t][1]}I", made, tags[t][2]) for t in (273, 279))
    raw = b"".join(zlib.decompress(made[o : o + s]) for o, s in zip(offs, lens, strict=True))
    got = np.cumsum(np.frombuffer(raw, "<u2").reshape(70, 5, 3), axis=1, dtype=np.uint16)
    assert (got == (a * 65535).astype(np.uint16)).all()


def test_batch(spark, tmp_path):
    a = (np.random.default_rng(4).random((30, 40, 3)) * 65535).astype(">u2")
    (tmp_path / "one.PPM").write_bytes(b"P6\n40 30\n65535\n" + a.tobytes())
    (tmp_path / "notes.txt").write_text("x")
    done = process_path(spark, str(tmp_path), str(tmp_path / "out"), "S-Log3", exposure=0.0, suffixes=(".ppm",)).collect()
    assert [(r.out, r.error) for r in done] == [("one.tif", None)] and (tmp_path / "out/one.tif").stat().st_size == done[0].bytes
    assert len(list((tmp_path / "out").glob(".pixelmill-*/tiles"))) == 0
    px = images.tiles_to_pixels(images.decode_tiles(images.scan(spark, str(tmp_path), (".ppm",)), tile=16))
    assert np.allclose(grid(px), a / 65535.0, atol=1e-6)
    assert grid(images.resize(px, 20)).shape == (15, 20, 3)
    with pytest.raises(ValueError):
        images.scan(spark, str(tmp_path))
    with pytest.raises(ValueError):
        Params("nothing")


def test_batch_goes_on_after_failures(spark, tmp_path):
    a = (np.random.default_rng(4).random((6, 8, 3)) * 255).astype("u1")
    (tmp_path / "good.ppm").write_bytes(b"P6\n8 6\n255\n" + a.tobytes())
    (tmp_path / "bad.ppm").write_bytes(b"not an image")
    lenses = spark.createDataFrame([], lens_db.SCHEMA)
    report = process_path(spark, str(tmp_path), str(tmp_path / "out"), "S-Log3", str(tmp_path / "no.cube"), suffixes=(".ppm",), lenses=lenses)
    got = {r.out: (r.error is None, r.lens_status) for r in report.collect()}
    assert got == {"good.tif": (True, "no exif"), "bad.tif": (False, None)}
    said = messages(report)
    assert E.progress_counts(said).first().asDict() == {"processed": 2, "total": 2}
    assert [m.level for m in said.orderBy("seq").collect()] == ["info", "error", "info"]
    with pytest.raises(Exception, match="(?i)no.cube|not exist|PATH_NOT_FOUND"):
        process_path(spark, str(tmp_path), str(tmp_path / "out"), "S-Log3", str(tmp_path / "no.cube"), suffixes=(".ppm",), on_lut_error="fail")


def test_single_file(spark, tmp_path):
    (tmp_path / "one.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes(6))
    process_path(spark, str(tmp_path / "one.ppm"), str(tmp_path / "made.tiff"), "V-Log", exposure=0.0, suffixes=(".ppm",))
    assert (tmp_path / "made.tiff").read_bytes()[:2] == b"II"
    (tmp_path / "to").mkdir()
    process_path(spark, str(tmp_path / "one.ppm"), str(tmp_path / "to"), "V-Log", exposure=0.0, suffixes=(".ppm",))
    assert (tmp_path / "to/one.tif").exists()


def test_each_file_by_its_lens(spark, tmp_path, monkeypatch):
    raw = SimpleNamespace(camera_params=SimpleNamespace(make="M", model="cam"), lens_params=SimpleNamespace(make=None, model="lens"), other_params=SimpleNamespace(focal_len=35, aperture=2.0))
    assert images.extract_exif(raw) == {"camera_maker": "M", "camera_model": "cam", "lens_model": "lens", "focal_length": 35.0, "aperture": 2.0}
    assert images.extract_exif(SimpleNamespace(other_params=SimpleNamespace(aperture=4))) == {"aperture": 4.0}
    exif = images.extract_exif(raw)
    monkeypatch.setitem(images.DECODERS, ".lens", lambda content, half: (np.ones((3, 3, 3), np.float32), exif))
    (tmp_path / "a.lens").write_bytes(b"x")
    (tmp_path / "lenses.xml").write_text("<db><lens><camera_model>CAM</camera_model><lens_model>lens</lens_model><focal>35</focal><k1>0.5</k1></lens></db>")
    (tmp_path / "own.xml").write_text("<db><lens><camera_model>other</camera_model><lens_model>lens</lens_model><focal>35</focal></lens></db>")
    options = cli.parser().parse_args([str(tmp_path), "out", "--log-space", "V-Log", "--lens-db", str(tmp_path / "lenses.xml"), "--custom-lensfun-db", str(tmp_path / "own.xml")])
    lenses = cli.lenses(spark, options)
    assert sorted((r.camera_model, r.k1, r.kr) for r in lenses.collect()) == [("CAM", 0.5, 1.0), ("other", 0.0, 1.0)]
    options.lens_correct = False
    assert cli.lenses(spark, options) is None
    report = process_path(spark, str(tmp_path), str(tmp_path / "out"), "V-Log", exposure=0.0, suffixes=(".lens",), lenses=lenses)
    assert [(r.error, r.lens_status) for r in report.collect()] == [(None, "matched")]


def test_output_names_and_tables(spark, tmp_path):
    names = spark.createDataFrame([("a.tif",), ("a.tif",), ("b.tif",)], "out string")
    assert [tuple(r) for r in sinks.collisions(names).collect()] == [("a.tif", 2)]
    for n in ("b.CUBE", "a.cube", "c.txt"):
        (tmp_path / n).write_text("LUT_1D_SIZE 2\n0 0 0\n1 1 1")
    assert [r.name for r in cube.folder(spark, str(tmp_path)).collect()] == ["a.cube", "b.CUBE"]
    assert cube.default(spark, str(tmp_path)).endswith("a.cube")
    px = frame(spark, np.zeros((4, 6, 3)))
    assert stats.histogram_sample(px, P.dims(px), above=23).count() == 6 and stats.histogram_sample(px, P.dims(px), above=24).count() == 24
