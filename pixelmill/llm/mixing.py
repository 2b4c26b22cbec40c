"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives every document the same number of copies,
a whole part and a fraction. Documents are dealt into buckets by a hash of their
id; inside a bucket fractions are paired, and mass (words) moves at random from
one of the pair to the other until one of them is whole, so that the words taken
stay the same. Each bucket leaves at most one fraction, and those residuals meet
bucket by bucket in a tree until a source has one left, which is rounded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import WORD_BREAK, cut

WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target is at most so many times its size.
MOST = 3.0
#: Documents in a bucket on average, and residuals that meet at a node of the tree.
BUCKET, FAN_IN = 2_000, 500


def word_count(column: str = "text") -> Column:
    parts = F.split(F.coalesce(F.col(column), F.lit("")), WORD_BREAK)
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n, target: shares of all sizes by weight, capped, the excess dealt on by weight.

    One row a source goes through one sort (level at which the targets fill up to
    the total); rows of documents never do.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    upto, after = by_fill.rowsBetween(Window.unboundedPreceding, 0), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("open", F.sum("weight").over(after))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
    # The level is set by the first source, in order of filling, that doesn't fill.
    per = per.withColumn("set", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"])
    target = F.when(F.col("set").isNull() | (F.col("weight") * F.col("set") >= F.col("cap")), F.col("cap")).otherwise(F.col("weight") * F.col("set"))
    return per.select("source", F.col("source_size").cast("bigint"), "n", target.cast("double").alias("target"))


def _chance(seed: str) -> float:
    return xxhash.xxh64_intdigest(seed) / 2.0**64


def pivot(sizes: np.ndarray, parts: np.ndarray, seeds: list[str]) -> tuple[np.ndarray, int]:
    """Round the fractions in order, keeping sum(size * part); returns 0/1 parts and the place of the residual or -1."""
    x = parts.astype(float).copy()
    held = -1
    for j in range(len(x)):
        if not 0 < x[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, sizes[held], sizes[j]
        up = min((1 - x[i]) * a, x[j] * b)  # words that i can gain from j
        down = min(x[i] * a, (1 - x[j]) * b)
        if _chance(seeds[j]) < down / (up + down):
            x[i], x[j] = x[i] + up / a, x[j] - up / b
        else:
            x[i], x[j] = x[i] - down / a, x[j] + down / b
        for k in (i, j):
            x[k] = round(x[k]) if abs(x[k] - round(x[k])) < 1e-9 else x[k]
        held = i if 0 < x[i] < 1 else j if 0 < x[j] < 1 else -1
    return x, held


def _level(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "key"], ascending=[False, True], kind="mergesort").reset_index(drop=True)
        x, held = pivot(g["size"].to_numpy(float), g["part"].to_numpy(), [f"{seed}:{k}" for k in g["key"]])
        g["part"] = x
        g["open"] = [i == held for i in range(len(g))]
        return g

    return run


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17, row: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the columns ``row`` for each row of ``docs``.

    Null text has size 0 and takes nothing; null sources form one source, the last
    by order; repeated rows are separate documents, told apart by their number
    among rows of the same id and size, so that reruns agree; ``row`` names columns
    that tell rows apart further and come out with them. Empty tables give an
    empty result; extra columns are ignored.
    """
    sizes = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), *row))
    aims = cut(targets(sizes, weights, most))
    # One row a source: joined by sort-merge where it's large, since its size follows the data.
    rows = sizes.join(aims.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim"))).drop("aim")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(share + 1e-12)).withColumn("part", F.greatest(share - F.col("whole"), F.lit(0.0)))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("bigint")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), *[F.col(c).cast("string") for c in row])
    rows = rows.withColumn("key", name).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), buckets)).drop("n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", open boolean"
    largest = aims.agg(F.max("n").alias("n")).first()["n"] or 0
    width = max(1, math.ceil(largest / BUCKET))
    fixed = (F.col("part") <= 1e-9) | (F.col("size") == 0)
    done = [rows.filter(fixed).withColumn("part", F.lit(0.0)).withColumn("open", F.lit(False))]
    live = rows.filter(~fixed)
    while True:
        step = cut(live.groupBy("source", "bucket").applyInPandas(_level(seed), schema))
        done.append(step.filter("not open"))
        live = step.filter("open").drop("open")
        if width == 1:
            break
        width = math.ceil(width / FAN_IN)
        live = live.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    last = live.withColumn("part", F.when(F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003 < F.col("part"), 1.0).otherwise(0.0))
    done.append(last.withColumn("open", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("part")).cast("bigint").alias("copies"), *row)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The op's report: doc_id, size, source_size, target, taken (words, repeats counted)."""
    c = copies(docs, **options)
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
