"""Pixel relations made from the standing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice/105000e0 r", "l_quantity/50e0 g", "l_discount*10e0 b")


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return read(spark, sf_dir, "events").selectExpr(
        "event_id div 2500 image_id", "cast((event_id % 2500) div 50 as int) y", "cast(event_id % 50 as int) x", "value/500e0 r", "props", "(user_id % 100)/100e0 b"
    ).select("image_id", "y", "x", "r", k.alias("g"), "b")


def px_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image a label: rows by vec_id, 21 columns of three values each."""
    rows = read(spark, sf_dir, "embeddings").selectExpr("label image_id", "cast(row_number() over (partition by label order by vec_id) - 1 as int) y", "embedding")
    px = rows.select("image_id", "y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    return px.selectExpr("cast(image_id as bigint) image_id", "y", "x", *[f"cast(abs(embedding[3*x+{i}]) as double) {c}" for i, c in enumerate("rgb")])
