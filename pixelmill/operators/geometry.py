"""Lens geometry: gating, vignetting, distortion and colour fringes, bilinear and cubic resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions.exprs import num
from pixelmill.operators.pixels import dims, with_dims

GATE = "coalesce(camera_model, '') <> '' and coalesce(lens_model, '') <> '' and coalesce(focal_length, 0) <> 0 and coalesce(aperture, 0) <> 0"


def match_lens(exif: DataFrame, lenses: DataFrame) -> DataFrame:
    """One calibration an image at most: same camera and lens model, makers equal where both are known; first by maker, then focal distance."""
    ok = exif.withColumn("usable", F.expr(GATE))
    e, c = ok.alias("e"), lenses.alias("l")
    same = (F.lower("e.camera_model") == F.lower("l.camera_model")) & (F.lower("e.lens_model") == F.lower("l.lens_model"))
    makers = (F.lower("e.lens_maker") == F.lower("l.lens_maker")) | F.col("e.lens_maker").isNull() | F.col("l.lens_maker").isNull()
    found = e.filter("usable").join(c, same & makers)
    rank = Window.partitionBy("e.image_id").orderBy(F.abs(F.col("l.focal") - F.col("e.focal_length")).asc_nulls_last(), "l.camera_maker", "l.lens_maker", "l.focal", "l.k1")
    best = found.withColumn("rank", F.row_number().over(rank)).filter("rank = 1").select("e.image_id", "l.k1", "l.k2", "l.k3", "l.a", "l.b", "l.c", "l.kr", "l.kb")
    status = F.when(~F.col("usable"), "no exif").when(F.col("k1").isNull(), "no lens").otherwise("matched")
    return ok.select("image_id", "usable").join(best, "image_id", "left").withColumn("lens_status", status).drop("usable")


#: Radius of a pixel as a share of half the diagonal.
RADIUS2 = "((pow(x-(w-1)/2e0, 2)+pow(y-(h-1)/2e0, 2))/(pow(w/2e0, 2)+pow(h/2e0, 2)))"


def devignette(px: DataFrame, k1: float, k2: float, k3: float, sizes: DataFrame | None = None) -> DataFrame:
    d = with_dims(px, sizes).withColumn("_q", F.expr(RADIUS2))
    fall = f"(1e0+{num(k1)}*_q+{num(k2)}*_q*_q+{num(k3)}*_q*_q*_q)"
    return d.withColumns({c: F.expr(f"{c}/{fall}") for c in "rgb"}).drop("_q", "h", "w")


#: Rows and columns of a tile of the result; the pixels of the frame that a tile needs meet in one task.
TILE = 256
#: Pixels beyond the taps that the cubic prefilter sees: what lies further weighs (2 - sqrt 3)^24, 2e-14.
CUBIC_HALO = 24
CHANNELS = ("red", "green", "blue")
COEFFICIENTS = {"a": 0.0, "b": 0.0, "c": 0.0, "kr": 1.0, "kb": 1.0}


def source_places(y: np.ndarray, x: np.ndarray, lens: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where red, green and blue of a pixel come from: scale, then the radial polynomial a r^3 + b r^2 + c r + (1 - a - b - c), times a channel's own k."""
    cy, cx = (lens["h"] - 1) / 2, (lens["w"] - 1) / 2
    dy, dx = (y - cy) / lens["scale"], (x - cx) / lens["scale"]
    q = (dx**2 + dy**2) / ((lens["w"] / 2) ** 2 + (lens["h"] / 2) ** 2)
    a, b, c, r = lens["a"], lens["b"], lens["c"], np.sqrt(q)
    s = a * q * r + b * q + c * r + (1 - a - b - c)
    return [(cy + dy * (s * k), cx + dx * (s * k)) for k in (lens["kr"], 1.0, lens["kb"])]


def auto_scale(h: int, w: int, a: float, b: float, c: float) -> float:
    """The scale that fills the frame up to its border, from border samples; a scale under 1 is applied as its inverse, so the result never shrinks."""
    t = np.linspace(-0.5, 0.5, 33)
    dy, dx = np.concatenate([t * h, t * h, np.full(33, h / 2)]), np.concatenate([np.full(66, w / 2), t * w])
    border = np.sqrt((dy**2 + dx**2) / ((h / 2) ** 2 + (w / 2) ** 2))
    low, high = np.zeros(len(border)), 4 * border
    for _ in range(60):  # the radius whose source lies on the border
        u = (low + high) / 2
        far = u * (a * u**3 + b * u**2 + c * u + (1 - a - b - c)) > border
        low, high = np.where(far, low, u), np.where(far, u, high)
    scale = float((border / high).max())
    return max(scale, 1 / scale)


def bilinear_sample(plane: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours' weighted values; neighbours outside the plane are 0."""
    h, w = plane.shape
    y0, x0 = np.floor(sy), np.floor(sx)
    out = np.zeros(sy.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = y0 + dy, x0 + dx
            ok = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            k = (sy - y0 if dy else 1 - (sy - y0)) * (sx - x0 if dx else 1 - (sx - x0))
            out[ok] += plane[y[ok].astype(int), x[ok].astype(int)] * k[ok]
    return out


def spline_prefilter(v: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the first axis, mirrored ends."""
    z = math.sqrt(3) - 2
    n = len(v)
    if n < 2:
        return v.astype(float)
    c = v.astype(float) * (1 - z) * (1 - 1 / z)
    tail = np.concatenate([c, c[-2:0:-1]])
    c[0] = np.tensordot(z ** np.arange(len(tail)), tail, 1) / (1 - z ** (2 * n - 2))
    for i in range(1, n):
        c[i] += z * c[i - 1]
    c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return c


def spline_sample(plane: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """Cubic spline values of a plane at (sy, sx), which lie inside it."""
    h, w = plane.shape
    c = spline_prefilter(spline_prefilter(plane).T).T
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros(sy.shape)

    def weight(t):
        t = np.abs(t)
        return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))

    def mirror(i, n):
        i = np.abs(i)
        return np.minimum(np.where(i >= n, 2 * n - 2 - i, i), n - 1).clip(0)

    for dy in range(-1, 3):
        for dx in range(-1, 3):
            out += weight(sy - y0 - dy) * weight(sx - x0 - dx) * c[mirror(y0 + dy, h), mirror(x0 + dx, w)]
    return out


def _bounds(places: list[tuple[np.ndarray, np.ndarray]], h: int, w: int, halo: int) -> tuple[int, int, int, int]:
    """First and last row and column of the frame that the taps at these places and their halo touch; last < first where none is inside."""
    out = []
    for axis, n in ((0, h), (1, w)):
        low, high = min(p[axis].min() for p in places), max(p[axis].max() for p in places)
        out += [max(0, math.floor(min(max(low, -1), n)) - halo), min(n - 1, math.floor(max(min(high, n), -2)) + 1 + halo)]
    return tuple(out)


def _remap(px: DataFrame, lens: DataFrame, cubic: bool) -> DataFrame:
    """Resample each image by its row of ``lens`` (image_id, h, w, a, b, c, kr, kb, scaled); images without a row are left out.

    A tile of the result reckons which box of the frame it needs. Pixels meet the
    tiles that ask for their own tile in one equi-join, and each tile is gathered in a
    task of its own: beside the join, a pixel moves once for each tile that needs it.
    """
    halo, sample = (CUBIC_HALO, spline_sample) if cubic else (0, bilinear_sample)
    names = ["h", "w", *COEFFICIENTS, "scale"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                row["scale"] = auto_scale(row["h"], row["w"], row["a"], row["b"], row["c"]) if row.pop("scaled") else 1.0
                h, w, ty, tx = row["h"], row["w"], row["ty"], row["tx"]
                y, x = np.mgrid[ty * TILE : min(h, (ty + 1) * TILE), tx * TILE : min(w, (tx + 1) * TILE)]
                y1, y2, x1, x2 = _bounds(source_places(y.ravel(), x.ravel(), row), h, w, halo)
                inside = {(i, j) for i in range(y1 // TILE, y2 // TILE + 1) for j in range(x1 // TILE, x2 // TILE + 1)} if y1 <= y2 and x1 <= x2 else set()
                rows += [{**row, "y1": y1, "y2": y2, "x1": x1, "x2": x2, "sy": i, "sx": j} for i, j in sorted(inside | {(ty, tx)})]
            yield pa.RecordBatch.from_pylist(rows, schema=asks)

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        first = {n: t.column(n)[0].as_py() for n in (*names, "y1", "y2", "x1", "x2")}
        y, x = (t.column(n).to_numpy() for n in ("y", "x"))
        h, w, y1, x1 = first["h"], first["w"], first["y1"], first["x1"]
        own = (y // TILE == key[1].as_py()) & (x // TILE == key[2].as_py())
        seen = (y >= y1) & (y <= first["y2"]) & (x >= x1) & (x <= first["x2"])
        box = max(0, first["y2"] - y1 + 1), max(0, first["x2"] - x1 + 1)
        out = {"image_id": pa.array(np.full(own.sum(), key[0].as_py(), "<i8")), "y": pa.array(y[own], pa.int32()), "x": pa.array(x[own], pa.int32())}
        for channel, (sy, sx) in zip(CHANNELS, source_places(y[own], x[own], first), strict=True):
            plane = np.zeros(box)
            plane[y[seen] - y1, x[seen] - x1] = t.column(channel).fill_null(0.0).to_numpy()[seen]
            value = np.zeros(len(sy))
            ok = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1) if cubic else np.full(len(sy), plane.size > 0)
            if ok.any():
                value[ok] = sample(plane, sy[ok] - y1, sx[ok] - x1)
            out[channel[0]] = pa.array(value)
        return pa.table(out)

    kinds = {n: "int" if n in ("h", "w", "ty", "tx", "sy", "sx", "y1", "y2", "x1", "x2") else "double" for n in [*names, "ty", "tx", "y1", "y2", "x1", "x2", "sy", "sx"]}
    asks = pa.schema([("image_id", pa.int64()), *((n, pa.int32() if k == "int" else pa.float64()) for n, k in kinds.items())])
    tiles = lens.select(F.col("image_id").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), *COEFFICIENTS, "scaled")
    tiles = tiles.withColumn("ty", F.explode(F.expr(f"sequence(0, cast((h-1) div {TILE} as int))"))).withColumn("tx", F.explode(F.expr(f"sequence(0, cast((w-1) div {TILE} as int))")))
    asked = tiles.mapInArrow(ask, "image_id long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    source = px.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), *[F.col(c[0]).cast("double").alias(c) for c in CHANNELS])
    source = source.withColumns({"sy": F.expr(f"cast(y div {TILE} as int)"), "sx": F.expr(f"cast(x div {TILE} as int)")})
    needed = asked.join(source, ["image_id", "sy", "sx"]).filter("y between y1 and y2 and x between x1 and x2 or sy = ty and sx = tx").drop("sy", "sx")
    return needed.groupBy("image_id", "ty", "tx").applyInArrow(gather, "image_id long, y int, x int, r double, g double, b double")


def _same_lens(px: DataFrame, sizes: DataFrame | None, scaled: bool, **coefficients: float) -> DataFrame:
    return (dims(px) if sizes is None else sizes).select("image_id", "h", "w", *[F.lit(float(v)).alias(n) for n, v in coefficients.items()], F.lit(scaled).alias("scaled"))


def remap_bilinear(px: DataFrame, a: float, b: float, c: float, kr: float = 1.0, kb: float = 1.0, sizes: DataFrame | None = None) -> DataFrame:
    """Each pixel from four neighbours of its source place, channel by channel; outside is 0."""
    return _remap(px, _same_lens(px, sizes, False, a=a, b=b, c=c, kr=kr, kb=kb), cubic=False)


def remap_cubic(px: DataFrame, a: float, b: float, c: float, kr: float = 1.0, kb: float = 1.0, sizes: DataFrame | None = None, scaled: bool = False) -> DataFrame:
    """Cubic spline resampling, tile by tile with a halo for its prefilter; outside is 0. ``scaled`` enlarges until no border is empty."""
    return _remap(px, _same_lens(px, sizes, scaled, a=a, b=b, c=c, kr=kr, kb=kb), cubic=True)


def correct_lenses(px: DataFrame, matched: DataFrame, sizes: DataFrame, distortion: bool = True, tca: bool = True, vignetting: bool = True) -> DataFrame:
    """Each image by its own calibration in ``matched`` (match_lens): vignetting, then distortion with auto-scale and colour fringes; others stay as they are."""
    known = matched.filter("lens_status = 'matched'").join(sizes, "image_id")
    given = {n: F.coalesce(F.col(n).cast("double"), F.lit(v)) for n, v in COEFFICIENTS.items()}
    given |= {n: F.lit(v) for n, v in COEFFICIENTS.items() if not (tca if n in ("kr", "kb") else distortion)}
    lens = known.select("image_id", "h", "w", *[v.alias(n) for n, v in given.items()], F.lit(distortion).alias("scaled"))
    fall = known.select("image_id", "h", "w", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in ("k1", "k2", "k3")])
    keep = ["image_id", "y", "x", "r", "g", "b"]
    rest, some = px.join(known.select("image_id"), "image_id", "left_anti").select(*keep), px.join(fall, "image_id")
    if vignetting:
        some = some.withColumn("_q", F.expr(RADIUS2))
        some = some.withColumns({c: F.expr(f"{c}/(1e0+k1*_q+k2*_q*_q+k3*_q*_q*_q)") for c in "rgb"})
    some = some.select(*keep)
    return (_remap(some, lens, cubic=True) if distortion or tca else some).unionByName(rest)
