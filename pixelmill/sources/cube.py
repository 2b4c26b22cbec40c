""".cube look-up tables: parsing, and the tables of a folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.lut import Lut1D, Lut3D


def parse(text: str) -> Lut1D | Lut3D:
    """A 1-D or 3-D table; red changes fastest in a 3-D file. Anything malformed is a ValueError."""
    low, high, kind, size, rows = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), None, 0, []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words or words[0] == "TITLE":
            continue
        if words[0] in ("LUT_1D_SIZE", "LUT_3D_SIZE"):
            kind, size = words[0][4:6], int(words[1])
        elif words[0] == "DOMAIN_MIN":
            low = tuple(map(float, words[1:4]))
        elif words[0] == "DOMAIN_MAX":
            high = tuple(map(float, words[1:4]))
        elif words[0] in ("LUT_1D_INPUT_RANGE", "LUT_3D_INPUT_RANGE"):
            low, high = (float(words[1]),) * 3, (float(words[2]),) * 3
        else:
            rows.append([float(w) for w in words])
    want = {"1D": size, "3D": size**3}.get(kind, -1)
    if len(rows) != want or size < 2 or any(len(r) != 3 for r in rows):
        raise ValueError(f"malformed cube file: kind {kind}, size {size}, {len(rows)} rows")
    if any(a >= b for a, b in zip(low, high, strict=True)):
        raise ValueError("malformed cube file: empty domain")
    table = np.array(rows)
    return Lut1D(table, low, high) if kind == "1D" else Lut3D(table.reshape(size, size, size, 3).transpose(2, 1, 0, 3), low, high)


def read(spark: SparkSession, path: str) -> Lut1D | Lut3D:
    return parse(bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode())


def folder(spark: SparkSession, path: str) -> DataFrame:
    """name, path of a folder's tables in order of name; the first is the default."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".cube"))
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path").orderBy("name")


def default(spark: SparkSession, path: str) -> str | None:
    return folder(spark, path).agg(F.min_by("path", "name").alias("p")).first()["p"]
