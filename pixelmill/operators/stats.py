"""Histogram, its axis limit, and running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 128


def histogram(px: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id, channel, bin, n: counts of values in [0, 1], the last bin closed; every bin is listed."""
    values = px.select("image_id", F.explode(F.expr("array(struct('r' as channel, r as v), struct('g' as channel, g as v), struct('b' as channel, b as v))")).alias("e")).select("image_id", "e.channel", "e.v")
    found = values.filter("v between 0 and 1").withColumn("bin", F.expr(f"least(cast(floor(v*{bins}) as int), {bins - 1})")).groupBy("image_id", "channel", "bin").agg(F.count("*").alias("n"))
    grid = px.select("image_id").distinct().select("image_id", F.explode(F.expr("array('r', 'g', 'b')")).alias("channel")).select("image_id", "channel", F.explode(F.expr(f"sequence(0, {bins - 1})")).alias("bin"))
    return grid.join(found, ["image_id", "channel", "bin"], "left").select("image_id", "channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_sample(px: DataFrame, sizes: DataFrame, above: int = 500_000) -> DataFrame:
    """The pixels that an image's histogram counts: every second row and column of an image of more than ``above`` pixels, all of others."""
    return px.join(sizes.select("image_id", "h", "w"), "image_id").filter(f"cast(h as long)*w <= {above} or y % 2 = 0 and x % 2 = 0").drop("h", "w")


def histogram_limit(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """image_id, ylim from the inner bins' 98th percentile and the largest bin."""
    inner = f"case when bin between 1 and {bins - 2} then n end"
    g = hist.groupBy("image_id").agg(F.expr(f"percentile({inner}, 0.98)").alias("p98"), F.expr(f"max({inner})").alias("inner_max"), F.max("n").alias("top"))
    return g.select("image_id", F.expr("case when inner_max > 0 then greatest(1.5e0*p98, 0.1e0*top) when top > 0 then cast(top as double) else 1e0 end").alias("ylim"))


def progress(events: DataFrame, block: int = 10_000) -> DataFrame:
    """seq, processed, pct: how many are done so far, of all.

    Counts inside blocks of ``block`` numbers run side by side; only one row a block
    meets in one place for the sums before it.
    """
    e = events.withColumn("_b", F.expr(f"seq div {block}"))
    per = e.groupBy("_b").agg(F.count("*").alias("rows"), F.sum(F.expr("case when status = 'done' then 1 else 0 end")).alias("done"))
    before = per.select("_b", (F.sum("done").over(Window.orderBy("_b")) - F.col("done")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    run = Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = e.withColumn("_own", F.sum(F.expr("case when status = 'done' then 1 else 0 end")).over(run)).join(before, "_b")
    return own.select("seq", (F.col("_own") + F.col("before")).alias("processed"), F.expr("case when total > 0 then (_own+before)/cast(total as double)*100e0 else 0e0 end").alias("pct"))
