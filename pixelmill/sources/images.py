"""Image files: directory scan, pluggable decoders, tiles, and the way between tiles and pixels."""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of camera files, in scan order.
EXTENSIONS = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".rw2", ".raf", ".orf", ".pef", ".srw")
TILE = 256
#: Lens data of a file -> where a decoded raw object holds it.
EXIF = {
    "camera_maker": "camera_params.make", "camera_model": "camera_params.model", "lens_maker": "lens_params.make", "lens_model": "lens_params.model",
    "focal_length": "other_params.focal_len", "aperture": "other_params.aperture",
}
EXIF_KINDS = {k: pa.float64() if k in ("focal_length", "aperture") else pa.string() for k in EXIF}
#: A tile; h and w are its own, rows and cols its image's. A file that can't be decoded is one row with an error and no data.
TILE_SCHEMA = (
    "image_id long, path string, y0 int, x0 int, h int, w int, data array<float>, rows int, cols int, "
    + ", ".join(f"{k} {'double' if v == pa.float64() else 'string'}" for k, v in EXIF_KINDS.items())
    + ", error string"
)
TILE_TYPES = pa.schema([
    ("image_id", pa.int64()), ("path", pa.string()), *((n, pa.int32()) for n in ("y0", "x0", "h", "w")), ("data", pa.list_(pa.float32())),
    ("rows", pa.int32()), ("cols", pa.int32()), *EXIF_KINDS.items(), ("error", pa.string()),
])

#: Suffix -> (bytes, half size) -> (H x W x 3 float32 in 0..1, lens data).
DECODERS: dict[str, Callable[[bytes, bool], tuple[np.ndarray, dict]]] = {}


def register_decoder(suffix: str, decode: Callable[[bytes, bool], tuple[np.ndarray, dict]]) -> None:
    DECODERS[suffix.lower()] = decode


def decode_ppm(content: bytes, half: bool = False) -> tuple[np.ndarray, dict]:
    """Binary PPM (P6), 8 or 16 bits: the format for tests and converted files."""
    fields, at = [], 0
    while len(fields) < 4:
        end = content.index(b"\n", at)
        fields += content[at:end].split(b"#")[0].split()
        at = end + 1
    w, h, top = (int(v) for v in fields[1:4])
    x = np.frombuffer(content, dtype=">u2" if top > 255 else "u1", offset=at, count=h * w * 3).reshape(h, w, 3).astype(np.float32) / np.float32(top)
    return (x[::2, ::2] if half else x), {}


def extract_exif(raw: object) -> dict:
    """The lens data that a decoded raw object holds; what it lacks is left out."""
    out = {}
    for name, place in EXIF.items():
        value = functools.reduce(lambda x, part: getattr(x, part, None), place.split("."), raw)
        if value is not None:
            out[name] = float(value) if EXIF_KINDS[name] == pa.float64() else str(value)
    return out


def decode_raw(content: bytes, half: bool = False) -> tuple[np.ndarray, dict]:
    """Camera raw by an optional library: linear, camera white balance, no auto brightness, 16 bits, ProPhoto."""
    if importlib.util.find_spec("rawpy") is None:
        raise RuntimeError("decoding camera raw files needs the optional rawpy library")
    import io

    import rawpy

    with rawpy.imread(io.BytesIO(content)) as raw:
        exif = extract_exif(raw)
        # The development options that results depend on.
        out = raw.postprocess(
            gamma=(1, 1), no_auto_bright=True, use_camera_wb=True, output_bps=16, bright=1.0, half_size=half, output_color=rawpy.ColorSpace.ProPhoto,
            highlight_mode=rawpy.HighlightMode.Blend, demosaic_algorithm=rawpy.DemosaicAlgorithm.AAHD,
        )
    return out.astype(np.float32) / np.float32(65535), exif


register_decoder(".ppm", decode_ppm)
for _s in EXTENSIONS:
    register_decoder(_s, decode_raw)


def has_suffix(path: str = "path", suffixes=EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*suffixes)


def scan(spark: SparkSession, folder: str, suffixes=EXTENSIONS) -> DataFrame:
    """path, content, length of the files of one folder with a known suffix, any case; an empty folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).filter(has_suffix("path", suffixes))
    if files.select("path").isEmpty():
        raise ValueError(f"no supported files in {folder}")
    return files.select("path", "content", "length")


def decode_tiles(files: DataFrame, half: bool = False, tile: int = TILE) -> DataFrame:
    """Tiles of each file (TILE_SCHEMA); image_id is a hash of the path. The largest array in a task is one image.

    A file whose decoder fails gives one row with the error; the others go on.
    """
    decoders = dict(DECODERS)

    def rows_of(key: int, path: str, content: bytes) -> Iterator[dict]:
        try:
            px, exif = decoders["." + path.rsplit(".", 1)[-1].lower()](content, half)
        except Exception as e:  # a file that fails doesn't stop the batch
            yield {"image_id": key, "path": path, "y0": 0, "x0": 0, "error": f"{type(e).__name__}: {e}"}
            return
        for y0 in range(0, px.shape[0], tile):
            for x0 in range(0, px.shape[1], tile):
                t = np.ascontiguousarray(px[y0 : y0 + tile, x0 : x0 + tile], dtype=np.float32)
                size = {"h": t.shape[0], "w": t.shape[1], "rows": px.shape[0], "cols": px.shape[1]}
                yield {"image_id": key, "path": path, "y0": y0, "x0": x0, "data": t.ravel(), **size, **exif}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for row in rows_of(*file):
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in TILE_TYPES], schema=TILE_TYPES)

    return files.select(F.xxhash64("path").alias("image_id"), "path", "content").mapInArrow(run, TILE_SCHEMA)


def image_table(tiles: DataFrame) -> DataFrame:
    """image_id, h, w, lens data, error: one row a file, from its first tile."""
    return tiles.filter("y0 = 0 and x0 = 0").select("image_id", F.col("rows").alias("h"), F.col("cols").alias("w"), *EXIF, "error")


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    tiles = tiles.filter("data is not null")
    p = tiles.select("image_id", "y0", "x0", "w", F.posexplode(F.expr("transform(sequence(0, h*w-1), i -> struct(data[3*i] as r, data[3*i+1] as g, data[3*i+2] as b))")).alias("i", "v"))
    return p.selectExpr("image_id", "cast(y0 + i div w as int) y", "cast(x0 + i % w as int) x", "cast(v.r as double) r", "cast(v.g as double) g", "cast(v.b as double) b")


def resize(px: DataFrame, long_edge: int = 1600) -> DataFrame:
    """Bilinear reduction to a long edge of at most ``long_edge``, by local joins."""
    from pixelmill.operators.pixels import dims

    sizes = dims(px).withColumn("_s", F.expr(f"least(1e0, {long_edge}e0/greatest(h, w))"))
    sizes = sizes.withColumns({"nh": F.expr("cast(round(h*_s) as int)"), "nw": F.expr("cast(round(w*_s) as int)")})
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("x"))
    grid = grid.withColumns({"_sy": F.expr("case when nh > 1 then y*(h-1)/cast(nh-1 as double) else 0e0 end"), "_sx": F.expr("case when nw > 1 then x*(w-1)/cast(nw-1 as double) else 0e0 end")})
    taps = ", ".join(
        f"named_struct('ty', least(cast(floor(_sy) as int)+{a}, h-1), 'tx', least(cast(floor(_sx) as int)+{b}, w-1), 'k', {'(_sy-floor(_sy))' if a else '(1e0-_sy+floor(_sy))'}*{'(_sx-floor(_sx))' if b else '(1e0-_sx+floor(_sx))'})"
        for a in (0, 1) for b in (0, 1)
    )
    asked = grid.select("image_id", "y", "x", F.explode(F.expr(f"array({taps})")).alias("t")).select("image_id", "y", "x", "t.*")
    source = px.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), "r", "g", "b")
    return asked.join(source, ["image_id", "ty", "tx"]).groupBy("image_id", "y", "x").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in "rgb"])
