"""Metering: one gain an image from its sampled pixels, by five strategies; aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import exprs as X
from pixelmill.operators.pixels import apply_gain, subsample

TARGET = 0.18
LUM = X.luminance()
GEO = f"exp(avg(ln(greatest({LUM}, 1e-10)+1e-6)))"
P99 = "percentile(greatest(r, g, b), 0.99)"


def average(px: DataFrame) -> DataFrame:
    g = px.groupBy("image_id").agg(F.expr(GEO).alias("a"))
    return g.select("image_id", F.expr(f"case when a < 1e-4 then 1e0 else least(greatest({TARGET}e0/a, 1e0), 50e0) end").alias("gain"))


def center_weighted(px: DataFrame) -> DataFrame:
    w = "exp(-(pow(x-w/2e0, 2)+pow(y-h/2e0, 2))/(2e0*pow(least(h, w)/2e0, 2)))"
    g = px.withColumn("_w", F.expr(w)).groupBy("image_id").agg(F.expr(f"sum({LUM}*_w)/sum(_w)").alias("a"))
    return g.select("image_id", F.expr(f"case when a < 1e-6 then 1e0 else least(greatest({TARGET}e0/a, 0.1e0), 100e0) end").alias("gain"))


def highlight_safe(px: DataFrame) -> DataFrame:
    g = px.groupBy("image_id").agg(F.expr(P99).alias("p99"))
    return g.select("image_id", F.expr("case when p99 < 1e-6 then 1e0 else 0.9e0/p99 end").alias("gain"))


LIMITED = "least(greatest(case when p99*g > 6e0 then 6e0/p99 else g end, 0.1e0), 100e0)"


def hybrid(px: DataFrame) -> DataFrame:
    g = px.groupBy("image_id").agg(F.expr(GEO).alias("a"), F.expr(P99).alias("p99")).withColumn("g", F.expr(f"{TARGET}e0/(a+1e-6)"))
    return g.select("image_id", F.expr(LIMITED).alias("gain"))


def matrix(px: DataFrame) -> DataFrame:
    """7 x 7 cells, remainder rows and columns left out; images under 7 rows or columns have no cells and gain 1 before the limit."""
    whole = px.groupBy("image_id").agg(F.expr(P99).alias("p99"))
    cells = px.withColumns({"gh": F.expr("h div 7"), "gw": F.expr("w div 7")}).filter("gh > 0 and gw > 0 and y < 7*gh and x < 7*gw")
    cells = cells.withColumns({"i": F.expr("y div gh"), "j": F.expr("x div gw")}).groupBy("image_id", "i", "j").agg(F.expr(f"avg({LUM})").alias("c"))
    ends = cells.groupBy("image_id").agg(F.expr("percentile(c, 0.9)").alias("hi"), F.expr("percentile(c, 0.1)").alias("lo"))
    weight = "(1e0+1.5e0*exp(-(pow(j-3, 2)+pow(i-3, 2))/(2e0*pow(2.8e0, 2))))*(case when c > hi then 0.2e0 else 1e0 end)*(case when c < lo then 1.2e0 else 1e0 end)"
    mean = cells.join(ends, "image_id").withColumn("_w", F.expr(weight)).groupBy("image_id").agg(F.expr("sum(c*_w)/sum(_w)").alias("a"))
    g = whole.join(mean, "image_id", "left").withColumn("g", F.expr(f"case when a is null or a < 1e-6 then 1e0 else {TARGET}e0/a end"))
    return g.select("image_id", F.expr(LIMITED).alias("gain"))


STRATEGIES = {"average": average, "center-weighted": center_weighted, "highlight-safe": highlight_safe, "hybrid": hybrid, "matrix": matrix}


def meter(px: DataFrame, mode: str = "hybrid", sizes: DataFrame | None = None) -> DataFrame:
    """image_id, gain; only the sample of each image is read for it."""
    if mode not in STRATEGIES:
        raise ValueError(f"unknown metering mode {mode!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[mode](subsample(px, sizes))


def auto_expose(px: DataFrame, mode: str = "hybrid", sizes: DataFrame | None = None) -> DataFrame:
    """Every pixel times its image's gain. The gains' size is left to the optimizer: it broadcasts them while small."""
    return apply_gain(px.join(meter(px, mode, sizes), "image_id")).drop("gain")
