"""Point-wise and sampling operators: DataFrame -> DataFrame over columns r, g, b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import exprs as X


def map_rgb(df: DataFrame, r: str, g: str, b: str) -> DataFrame:
    return df.withColumns({"r": F.expr(r), "g": F.expr(g), "b": F.expr(b)})


def each(df: DataFrame, make) -> DataFrame:
    return map_rgb(df, make("r"), make("g"), make("b"))


def normalize_u16(df: DataFrame) -> DataFrame:
    return each(df, lambda v: f"{v}/65535e0")


def manual_exposure(df: DataFrame, ev: float) -> DataFrame:
    return each(df, lambda v: f"{v}*pow(2e0, {X.num(ev)})")


def apply_gain(df: DataFrame, gain: str = "gain") -> DataFrame:
    return each(df, lambda v: f"{v}*{gain}")


def saturation(df: DataFrame, amount: float = 1.25) -> DataFrame:
    df = df.withColumn("_lum", F.expr(X.luminance()))
    return each(df, lambda v: X.saturated(v, "_lum", amount)).drop("_lum")


def contrast(df: DataFrame, amount: float = 1.1) -> DataFrame:
    return each(df, lambda v: X.contrasted(v, amount))


def boost(df: DataFrame, sat: float = 1.25, con: float = 1.1) -> DataFrame:
    return contrast(saturation(df, sat), con)


def to_gamut(df: DataFrame, target: str) -> DataFrame:
    return map_rgb(df, *X.gamut(target))


def log_encode(df: DataFrame, curve: str) -> DataFrame:
    return each(df, lambda v: X.log_curve(curve, v))


def display_srgb(df: DataFrame) -> DataFrame:
    return each(each(df, X.bt709_decode), X.srgb_encode)


def clip01(df: DataFrame) -> DataFrame:
    return each(df, X.clip01)


def quantize(df: DataFrame, top: int = 65535) -> DataFrame:
    return each(df, lambda v: X.quantized(v, top))


def dims(px: DataFrame) -> DataFrame:
    """image_id, h, w: one row an image."""
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_dims(px: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    return px.join(dims(px) if sizes is None else sizes, "image_id")


def subsample(px: DataFrame, sizes: DataFrame | None = None, long_edge: int = 1024) -> DataFrame:
    """Every step-th row and column, re-indexed; step = max(1, long edge div 1024). Keeps h and w of the sample's source."""
    step = F.expr(f"greatest(1, greatest(h, w) div {long_edge})")
    d = with_dims(px, sizes).withColumn("_s", step).filter("y % _s = 0 and x % _s = 0")
    return d.withColumns({"y": F.expr("cast(y div _s as int)"), "x": F.expr("cast(x div _s as int)"), "h": F.expr("cast(ceil(h/_s) as int)"), "w": F.expr("cast(ceil(w/_s) as int)")}).drop("_s")
