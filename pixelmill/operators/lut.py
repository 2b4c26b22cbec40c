"""1-D and 3-D look-up tables. A table is folded into one array literal of the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Lut3D:
    table: np.ndarray  # size x size x size x 3, indexed [r, g, b]
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def size(self) -> int:
        return self.table.shape[0]


@dataclass
class Lut1D:
    table: np.ndarray  # size x 3
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (1.0, 1.0, 1.0)


def array_literal(values) -> Column:
    """Doubles as one foldable literal."""
    return F.from_json(F.lit(json.dumps([float(v) for v in np.ravel(values)])), "array<double>")


def tetra_places(size: int, low, high) -> dict[str, str]:
    """Expressions for deltas d1 >= d2 >= d3 and the four nodes k0..k3 of the tetrahedron that holds (r, g, b)."""
    top = size - 1
    out: dict[str, str] = {}
    for c, lo, hi in zip("rgb", low, high, strict=True):
        out[f"i{c}"] = f"least(greatest(({c}-({float(lo)}e0))*{top}e0/{float(hi) - float(lo)}e0, 0e0), {top}e0)"
    for c, s in zip("rgb", (size * size, size, 1), strict=True):
        out[f"n{c}"] = f"cast(floor(i{c}) as int)"
        out[f"s{c}"] = f"case when floor(i{c}) < {top} then {s} else 0 end"
        out[f"d{c}"] = f"i{c}-floor(i{c})"
    out["d1"] = "greatest(dr, dg, db)"
    out["d3"] = "least(dr, dg, db)"
    out["d2"] = "greatest(least(dr, dg), least(greatest(dr, dg), db))"
    out["k0"] = f"(nr*{size}+ng)*{size}+nb"
    out["k3"] = "k0+sr+sg+sb"
    out["k1"] = "k0+case when dr >= dg and dr >= db then sr when dg >= db then sg else sb end"
    out["k2"] = "k3-case when db <= dr and db <= dg then sb when dg <= dr then sg else sr end"
    return out


def levels(places: dict[str, str]) -> list[list[str]]:
    """The names of places in steps in which each needs only earlier ones."""
    return [["ir", "ig", "ib"], [f"{k}{c}" for c in "rgb" for k in "nsd"], ["d1", "d2", "d3", "k0"], ["k3", "k1"], ["k2"]]


WEIGHTS = ("(1e0-d1)", "(d1-d2)", "(d2-d3)", "d3")


def apply_3d(df: DataFrame, lut: Lut3D) -> DataFrame:
    """Tetrahedral interpolation in one projection chain, no join."""
    places = tetra_places(lut.size, lut.low, lut.high)
    keep = df.columns
    for step in levels(places):
        df = df.withColumns({n: F.expr(places[n]) for n in step})
    out = {}
    for c, name in enumerate("rgb"):
        table = array_literal(lut.table[..., c])
        out[name] = sum((F.expr(w) * F.get(table, F.col(f"k{i}")) for i, w in enumerate(WEIGHTS)), F.lit(0.0))
    return df.withColumns(out).select(*keep)


def apply_1d(df: DataFrame, lut: Lut1D) -> DataFrame:
    """Linear interpolation a channel, clamped to the domain."""
    n = len(lut.table)
    out = {}
    for c, name in enumerate("rgb"):
        span = float(lut.high[c]) - float(lut.low[c])
        at = F.expr(f"least(greatest(({name}-({float(lut.low[c])}e0))*{n - 1}e0/{span}e0, 0e0), {n - 1}e0)")
        i = F.least(F.floor(at).cast("int"), F.lit(n - 2)) if n > 1 else F.lit(0)
        table = array_literal(lut.table[:, c])
        a, b = F.get(table, i), F.get(table, F.least(i + 1, F.lit(n - 1)))
        out[name] = a + (b - a) * (at - i)
    return df.withColumns(out)


def apply_lut(df: DataFrame, lut: Lut3D | Lut1D | None) -> DataFrame:
    return df if lut is None else apply_3d(df, lut) if isinstance(lut, Lut3D) else apply_1d(df, lut)
