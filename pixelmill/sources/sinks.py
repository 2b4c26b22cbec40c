"""Image output: TIFF with stdlib zlib, other formats by optional libraries; output names."""

from __future__ import annotations

import importlib.util
import io
import os
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_name(path: str, format: str) -> Column:
    """Base name with its last suffix replaced."""
    base = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("." + format))


def collisions(names: DataFrame) -> DataFrame:
    """Output names that more than one input would write."""
    return names.groupBy("out").agg(F.count("*").alias("n")).filter("n > 1")


def encode_tiff(px: np.ndarray) -> bytes:
    """16-bit RGB TIFF, truncated codes, zlib level 8, horizontal predictor, strips of 64 rows."""
    h, w, _ = px.shape
    codes = (np.clip(px, 0, 1) * 65535).astype("<u2")
    diff = codes.copy()
    diff[:, 1:] -= codes[:, :-1]
    rows = 64
    strips = [zlib.compress(diff[y : y + rows].tobytes(), 8) for y in range(0, h, rows)]
    n = len(strips)
    tags = 12
    after = 8 + 2 + 12 * tags + 4
    bits_at, offs_at = after, after + 6
    lens_at = offs_at + 4 * n
    data_at = lens_at + 4 * n
    offsets = [data_at + sum(map(len, strips[:i])) for i in range(n)]
    entry = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
    lists = (offsets[0], len(strips[0])) if n == 1 else (offs_at, lens_at)
    ifd = b"".join([
        entry(256, 4, 1, w), entry(257, 4, 1, h), entry(258, 3, 3, bits_at), entry(259, 3, 1, 8), entry(262, 3, 1, 2), entry(273, 4, n, lists[0]), entry(277, 3, 1, 3),
        entry(278, 4, 1, rows), entry(279, 4, n, lists[1]), entry(284, 3, 1, 1), entry(317, 3, 1, 2), entry(339, 3, 1, 1),
    ])
    head = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", tags) + ifd + struct.pack("<I", 0)
    return head + struct.pack("<3H", 16, 16, 16) + struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *map(len, strips)) + b"".join(strips)


def encode_jpeg(px: np.ndarray) -> bytes:
    """8 bits, quality 95, no subsampling, optimised; by an optional library."""
    if importlib.util.find_spec("PIL") is None:
        raise RuntimeError("writing JPEG needs the optional Pillow library")
    from PIL import Image

    out = io.BytesIO()
    Image.fromarray((np.clip(px, 0, 1) * 255).astype(np.uint8)).save(out, "JPEG", quality=95, subsampling=0, optimize=True)
    return out.getvalue()


def encode_heif(px: np.ndarray) -> bytes:
    """16-bit codes stored with 10 bits, without further loss; by an optional library."""
    if importlib.util.find_spec("pillow_heif") is None:
        raise RuntimeError("writing HEIF needs the optional pillow_heif library")
    import pillow_heif

    codes = (np.clip(px, 0, 1) * 65535).astype(np.uint16)
    out = io.BytesIO()
    pillow_heif.from_bytes(mode="RGB;16", size=(codes.shape[1], codes.shape[0]), data=codes.tobytes()).save(out, quality=-1, bit_depth=10)
    return out.getvalue()


#: Suffix -> encoder of an H x W x 3 array in 0..1.
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"tif": encode_tiff, "tiff": encode_tiff, "jpg": encode_jpeg, "jpeg": encode_jpeg, "heic": encode_heif, "heif": encode_heif}


def write_images(px: DataFrame, names: DataFrame, folder: str, format: str = "tif") -> DataFrame:
    """Encode each image and write it under ``folder``; returns image_id, out, bytes, error.

    ``names`` has image_id and out, a name for each image. An image is one group (its
    file is one object); a failure is reported in ``error``, the others are written.
    """
    encoders = dict(ENCODERS)
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    reported = pa.schema([("image_id", pa.int64()), ("out", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])

    def run(t: pa.Table, name: pa.Table) -> pa.Table:
        rows = []
        for out in name.column("out").to_pylist() if t.num_rows else []:
            size, error = 0, None
            try:
                y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
                a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3))
                for k, c in enumerate("rgb"):
                    a[y, x, k] = t.column(c).to_numpy()
                made = encoders.get(format, encode_jpeg)(a)
                fs, root = pafs.FileSystem.from_uri(where)
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/{out}") as f:
                    f.write(made)
                size = len(made)
            except Exception as e:  # an image that fails doesn't stop the batch
                error = f"{type(e).__name__}: {e}"
            rows.append({"image_id": name.column("image_id")[0].as_py(), "out": out, "bytes": size, "error": error})
        return pa.Table.from_pylist(rows, schema=reported)

    pixels = px.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id")
    return pixels.cogroup(names.select("image_id", "out").groupBy("image_id")).applyInArrow(run, "image_id long, out string, bytes long, error string")
