"""Lens calibrations from XML or rows; custom records are added to the loaded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "camera_maker string, camera_model string, lens_maker string, lens_model string, focal double, k1 double, k2 double, k3 double, a double, b double, c double, kr double, kb double"


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row a <lens> element whose children are the fields of SCHEMA; missing numbers mean no correction."""
    rows = spark.read.format("xml").option("rowTag", "lens").schema(SCHEMA).load(path)
    return rows.fillna(0.0, ["k1", "k2", "k3", "a", "b", "c"]).fillna(1.0, ["kr", "kb"])


def with_custom(loaded: DataFrame, custom: DataFrame | None) -> DataFrame:
    return loaded if custom is None else loaded.unionByName(custom.select(*[F.col(c) for c in loaded.columns]))
