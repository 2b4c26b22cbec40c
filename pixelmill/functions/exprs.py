"""Pixel expressions as SQL text that Spark and other engines read alike; F.expr() makes columns of them."""

from __future__ import annotations

from pixelmill.functions.spaces import gamut_matrix, luminance_row


def num(v: float) -> str:
    """A double literal."""
    s = repr(float(v))
    return f"({s})" if "e" in s else f"({s}e0)"


def rounded(x: str) -> str:
    return f"floor(({x})*1e6+0.5e0)/1e6"


def clip01(v: str) -> str:
    return f"least(greatest({v}, 0e0), 1e0)"


def luminance(r: str = "r", g: str = "g", b: str = "b") -> str:
    cr, cg, cb = map(num, luminance_row())
    return f"({cr}*{r}+{cg}*{g}+{cb}*{b})"


def saturated(v: str, lum: str, amount: float = 1.25) -> str:
    return f"({lum}+({v}-{lum})*{num(amount)})"


def contrasted(v: str, amount: float = 1.1, pivot: float = 0.18) -> str:
    return f"greatest(({v}-{num(pivot)})*{num(amount)}+{num(pivot)}, 0e0)"


def gamut(target: str) -> list[str]:
    return ["(" + "+".join(f"{num(m)}*{c}" for m, c in zip(row, "rgb", strict=True)) + ")" for row in gamut_matrix(target)]


#: Each curve as published by its vendor, for linear v of 1e-6 or more.
CURVES = {
    "F-Log": "case when {v} < 0.00089e0 then 8.735631e0*{v}+0.092864e0 else 0.344676e0*log10(0.555556e0*{v}+0.009468e0)+0.790453e0 end",
    "F-Log2": "case when {v} < 0.000889e0 then 8.799461e0*{v}+0.092864e0 else 0.245281e0*log10(5.555556e0*{v}+0.064829e0)+0.384316e0 end",
    "V-Log": "case when {v} < 0.01e0 then 5.6e0*{v}+0.125e0 else 0.241514e0*log10({v}+0.00873e0)+0.598206e0 end",
    "N-Log": "case when {v} < 0.328e0 then (650e0/1023e0)*cbrt({v}+0.0075e0) else (150e0/1023e0)*ln({v})+619e0/1023e0 end",
    "L-Log": "case when {v} < 0.006e0 then 8e0*{v}+0.09e0 else 0.27e0*log10(1.3e0*{v}+0.0115e0)+0.6e0 end",
    "Canon Log 2": "0.24136077e0*log10(87.09937546e0*{v}/0.9e0+1e0)+0.092864125e0",
    "Canon Log 3": "case when {v}/0.9e0 < 0.014e0 then 1.9754798e0*({v}/0.9e0)+0.12512219e0 else 0.36726845e0*log10(14.98325e0*({v}/0.9e0)+1e0)+0.12240537e0 end",
    "S-Log3": "case when {v} < 0.01125e0 then ({v}*(171.2102946929e0-95e0)/0.01125e0+95e0)/1023e0 else (420e0+261.5e0*log10(({v}+0.01e0)/0.19e0))/1023e0 end",
    "Arri LogC3": "case when {v} < 0.010591e0 then 5.367655e0*{v}+0.092809e0 else 0.247190e0*log10(5.555556e0*{v}+0.052272e0)+0.385537e0 end",
    "Arri LogC4": "(log2((262128e0/117.45e0)*{v}+64e0)-6e0)/14e0*(928e0/1023e0)+95e0/1023e0",
    "Log3G10": "0.224282e0*log10(155.975327e0*({v}+0.01e0)+1e0)",
    "D-Log": "case when {v} < 0.0078e0 then 6.025e0*{v}+0.0929e0 else 0.256663e0*log10(0.9892e0*{v}+0.0108e0)+0.584555e0 end",
}


def log_curve(curve: str, v: str) -> str:
    return CURVES[curve].format(v=f"greatest({v}, 1e-6)")


def bt709_decode(v: str) -> str:
    return f"case when {v} < 0.081e0 then {v}/4.5e0 else pow(({v}+0.099e0)/1.099e0, 1e0/0.45e0) end"


def srgb_encode(v: str) -> str:
    return f"case when {v} <= 0.0031308e0 then 12.92e0*{v} else 1.055e0*pow({v}, 1e0/2.4e0)-0.055e0 end"


def quantized(v: str, top: int) -> str:
    """Truncated integer code of a clipped value."""
    return f"cast(floor({clip01(v)}*{top}e0) as int)"
