"""The registered queries over pixels, each with the SQL of its own definition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import exprs as X
from pixelmill.functions.spaces import LOG_SPACES
from pixelmill.operators import geometry, metering, stats
from pixelmill.operators import lut as L
from pixelmill.operators import pixels as P
from pixelmill.plans.develop import Params, develop
from pixelmill.sources import sinks, tables
from pixelmill.sources.images import EXTENSIONS, has_suffix
from pixelmill.streaming import events as E

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PX_KEYS = ["image_id", "y", "x"]

LINE = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice/105000e0 AS r, l_quantity/50e0 AS g, l_discount*10e0 AS b FROM lineitem)"
EVENTS = (
    "(SELECT event_id // 2500 AS image_id, CAST((event_id % 2500) // 50 AS INT) AS y, CAST(event_id % 50 AS INT) AS x, value/500e0 AS r, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE)/100 AS g, (user_id % 100)/100e0 AS b FROM events)"
)
EMBEDDINGS = (
    "(SELECT CAST(label AS BIGINT) AS image_id, y, CAST(x AS INT) AS x, CAST(abs(embedding[3*x+1]) AS DOUBLE) AS r, CAST(abs(embedding[3*x+2]) AS DOUBLE) AS g, CAST(abs(embedding[3*x+3]) AS DOUBLE) AS b "
    "FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y FROM embeddings), range(21) t(x))"
)

LUT_SIZE = 17


def lut17() -> L.Lut3D:
    i = np.arange(LUT_SIZE, dtype=float)
    t = np.zeros((LUT_SIZE,) * 3 + (3,))
    t[..., 0] = ((i / 16) ** 2)[:, None, None]
    t[..., 1] = (0.9 * i / 16)[None, :, None] + (i / 160)[None, None, :]
    t[..., 2] = np.sqrt(i / 16)[None, None, :]
    return L.Lut3D(t)


LUT17 = "(SELECT CAST((ix*17+iy)*17+iz AS INT) AS k, (ix/16e0)*(ix/16e0) AS lr, 0.9e0*iy/16e0+iz/160e0 AS lg, sqrt(iz/16e0) AS lb FROM range(17) a(ix), range(17) b(iy), range(17) c(iz))"


def lut32() -> L.Lut1D:
    return L.Lut1D(np.repeat(np.sqrt(np.arange(32) / 31.0)[:, None], 3, axis=1))


def _round(df: DataFrame, cols="rgb") -> DataFrame:
    return df.withColumns({c: F.expr(X.rounded(c)) for c in cols})


def _sql(keys: list[str], source: str, r: str, g: str, b: str, round_: bool = False) -> str:
    values = [X.rounded(v) if round_ else v for v in (r, g, b)]
    return f"SELECT {', '.join(keys)}, {values[0]} AS r, {values[1]} AS g, {values[2]} AS b FROM {source}"


def _each(source: str, make, round_: bool = False, keys=None) -> str:
    return _sql(keys or LINE_KEYS, source, make("r"), make("g"), make("b"), round_)


_CON = ", ".join(f"{X.contrasted(v)} AS {v}" for v in "rgb")
_SAT = ", ".join(f"{X.saturated(v, '_l')} AS {v}" for v in "rgb")
BOOSTED = f"(SELECT * REPLACE ({_CON}) FROM (SELECT * REPLACE ({_SAT}) FROM (SELECT *, {X.luminance()} AS _l FROM {{source}})))"


def _lut_sql(keys: list[str], source: str) -> str:
    """Four joins with the table, the plain form of the definition."""
    places = L.tetra_places(LUT_SIZE, (0, 0, 0), (1, 1, 1))
    q = source
    for step in L.levels(places):
        q = f"(SELECT *, {', '.join(f'{places[n]} AS {n}' for n in step)} FROM {q})"
    sums = [" + ".join(f"{w}*t{i}.l{c}" for i, w in enumerate(L.WEIGHTS)) for c in "rgb"]
    joins = " ".join(f"JOIN lut t{i} ON p.k{i} = t{i}.k" for i in range(4))
    return f"WITH lut AS {LUT17} SELECT {', '.join('p.' + k for k in keys)}, {', '.join(f'{X.rounded(s)} AS {c}' for s, c in zip(sums, 'rgb', strict=True))} FROM {q} p {joins}"


def _meter_sql(mode: str, source: str = EVENTS) -> str:
    """image_id, gain as a query over the sampled pixels with their dimensions."""
    dims = f"SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM {source} GROUP BY image_id"
    px = f"px AS (SELECT p.image_id, CAST(y // s AS INT) AS y, CAST(x // s AS INT) AS x, r, g, b, CAST(ceil(h/s) AS INT) AS h, CAST(ceil(w/s) AS INT) AS w FROM {source} p JOIN (SELECT *, greatest(1, greatest(h, w) // 1024) AS s FROM ({dims})) d ON p.image_id = d.image_id WHERE y % s = 0 AND x % s = 0)"
    lum, p99 = X.luminance(), "quantile_cont(greatest(r, g, b), 0.99)"
    geo = f"exp(avg(ln(greatest({lum}, 1e-10)+1e-6)))"
    limited = "least(greatest(CASE WHEN p99*g > 6e0 THEN 6e0/p99 ELSE g END, 0.1e0), 100e0)"
    if mode == "average":
        return f"WITH {px} SELECT image_id, CASE WHEN a < 1e-4 THEN 1e0 ELSE least(greatest(0.18e0/a, 1e0), 50e0) END AS gain FROM (SELECT image_id, {geo} AS a FROM px GROUP BY image_id)"
    if mode == "center-weighted":
        wt = "exp(-(pow(x-w/2e0, 2)+pow(y-h/2e0, 2))/(2e0*pow(least(h, w)/2e0, 2)))"
        return f"WITH {px} SELECT image_id, CASE WHEN a < 1e-6 THEN 1e0 ELSE least(greatest(0.18e0/a, 0.1e0), 100e0) END AS gain FROM (SELECT image_id, sum({lum}*{wt})/sum({wt}) AS a FROM px GROUP BY image_id)"
    if mode == "highlight-safe":
        return f"WITH {px} SELECT image_id, CASE WHEN p99 < 1e-6 THEN 1e0 ELSE 0.9e0/p99 END AS gain FROM (SELECT image_id, {p99} AS p99 FROM px GROUP BY image_id)"
    if mode == "hybrid":
        return f"WITH {px} SELECT image_id, {limited} AS gain FROM (SELECT image_id, p99, 0.18e0/(a+1e-6) AS g FROM (SELECT image_id, {geo} AS a, {p99} AS p99 FROM px GROUP BY image_id))"
    cells = f"cells AS (SELECT image_id, y // (h // 7) AS i, x // (w // 7) AS j, avg({lum}) AS c FROM px WHERE h >= 7 AND w >= 7 AND y < 7*(h // 7) AND x < 7*(w // 7) GROUP BY ALL)"
    weight = "(1e0+1.5e0*exp(-(pow(j-3, 2)+pow(i-3, 2))/(2e0*pow(2.8e0, 2))))*(CASE WHEN c > hi THEN 0.2e0 ELSE 1e0 END)*(CASE WHEN c < lo THEN 1.2e0 ELSE 1e0 END)"
    mean = f"mean AS (SELECT image_id, sum(c*wt)/sum(wt) AS a FROM (SELECT c.image_id, c, {weight} AS wt FROM cells c JOIN (SELECT image_id, quantile_cont(c, 0.9) AS hi, quantile_cont(c, 0.1) AS lo FROM cells GROUP BY image_id) e ON c.image_id = e.image_id) GROUP BY image_id)"
    return f"WITH {px}, {cells}, {mean} SELECT image_id, {limited} AS gain FROM (SELECT p.image_id, p99, CASE WHEN a IS NULL OR a < 1e-6 THEN 1e0 ELSE 0.18e0/a END AS g FROM (SELECT image_id, {p99} AS p99 FROM px GROUP BY image_id) p LEFT JOIN mean ON p.image_id = mean.image_id)"


def _slug(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name.lower()).replace("__", "_")


GAMUTS = {"f_gamut": "F-Gamut", "f_gamut_c": "F-Gamut C", "v_gamut": "V-Gamut", "n_gamut": "N-Gamut", "bt2020": "ITU-R BT.2020", "cinema": "Cinema Gamut", "s_gamut3": "S-Gamut3", "s_gamut3_cine": "S-Gamut3.Cine", "awg3": "ARRI Wide Gamut 3", "awg4": "ARRI Wide Gamut 4", "redwide": "REDWideGamutRGB", "d_gamut": "DJI D-Gamut"}
CURVES = {"flog": "F-Log", "flog2": "F-Log2", "vlog": "V-Log", "nlog": "N-Log", "llog": "L-Log", "clog2": "Canon Log 2", "clog3": "Canon Log 3", "slog3": "S-Log3", "logc3": "Arri LogC3", "logc4": "Arri LogC4", "log3g10": "Log3G10", "dlog": "D-Log"}
K = (-0.3, 0.12, -0.02)
WARP = (0.01, -0.02, 0.03)


def catalogue() -> dict:
    """name -> (query of (spark, sf_dir), SQL or None)."""
    out: dict = {}

    def line(name, op, sql, round_=False):
        out[name] = (lambda s, d: (_round if round_ else lambda x: x)(op(tables.px_lineitem(s, d))), sql)

    def image(name, op, sql):
        out[name] = (lambda s, d: op(tables.px_events(s, d)), sql)

    out["px_lineitem"] = (tables.px_lineitem, f"SELECT * FROM {LINE}")
    out["px_events"] = (tables.px_events, f"SELECT * FROM {EVENTS}")
    out["px_embeddings"] = (tables.px_embeddings, f"SELECT * FROM {EMBEDDINGS}")
    codes = lambda df: df.selectExpr(*LINE_KEYS, *[f"cast(floor({X.clip01(c)}*65535e0) as int) {c}" for c in "rgb"])
    line("normalize_u16", lambda p: P.normalize_u16(codes(p)), _each(f"(SELECT {', '.join(LINE_KEYS)}, {', '.join(f'CAST(floor({X.clip01(c)}*65535e0) AS INT) AS {c}' for c in 'rgb')} FROM {LINE})", lambda v: f"{v}/65535e0"))
    line("exposure_manual", lambda p: P.manual_exposure(p, 1.5), _each(LINE, lambda v: f"{v}*pow(2e0, 1.5e0)", True), True)
    line("gain_apply", lambda p: P.apply_gain(p, "1.7e0"), _each(LINE, lambda v: f"{v}*1.7e0"))
    out["luminance"] = (lambda s, d: tables.px_lineitem(s, d).selectExpr(*LINE_KEYS, f"{X.luminance()} as lum"), f"SELECT {', '.join(LINE_KEYS)}, {X.luminance()} AS lum FROM {LINE}")
    line("saturation", P.saturation, _each(LINE, lambda v: X.saturated(v, X.luminance())))
    line("contrast", P.contrast, _each(LINE, X.contrasted))
    line("boost", P.boost, f"SELECT {', '.join(LINE_KEYS)}, r, g, b FROM {BOOSTED.replace('{source}', LINE)}")
    line("clip01", lambda p: P.clip01(P.apply_gain(p, "1.3e0")), _each(LINE, lambda v: X.clip01(f"({v}*1.3e0)")))
    line("quantize_u16", P.quantize, _each(LINE, lambda v: X.quantized(v, 65535)))
    line("quantize_u8", lambda p: P.quantize(p, 255), _each(LINE, lambda v: X.quantized(v, 255)))
    for slug, gamut in GAMUTS.items():
        line(f"gamut_{slug}", lambda p, g=gamut: P.to_gamut(p, g), _sql(LINE_KEYS, LINE, *X.gamut(gamut)))
    for slug, curve in CURVES.items():
        line(f"log_{slug}", lambda p, c=curve: P.log_encode(p, c), _each(LINE, lambda v, c=curve: X.log_curve(c, v), True), True)
    line("bt709_decode", lambda p: P.each(p, X.bt709_decode), _each(LINE, X.bt709_decode, True), True)
    line("srgb_encode", lambda p: P.each(p, X.srgb_encode), _each(LINE, X.srgb_encode, True), True)
    dec = f"(SELECT * REPLACE ({', '.join(f'{X.bt709_decode(v)} AS {v}' for v in 'rgb')}) FROM {LINE})"
    line("bt709_to_srgb", P.display_srgb, _each(dec, X.srgb_encode, True), True)
    at = lambda v: f"least(greatest({v}*31e0, 0e0), 31e0)"
    lo = lambda v: f"least(floor({at(v)}), 30e0)"
    line("lut1d", lambda p: L.apply_1d(p, lut32()), _each(LINE, lambda v: f"sqrt({lo(v)}/31e0)+(sqrt(({lo(v)}+1e0)/31e0)-sqrt({lo(v)}/31e0))*({at(v)}-{lo(v)})", True), True)
    line("lut3d_tetra", lambda p: L.apply_3d(p, lut17()), _lut_sql(LINE_KEYS, LINE), True)
    image("subsample", lambda p: P.subsample(p, long_edge=25).select(*PX_KEYS, "r", "g", "b"), f"SELECT p.image_id, CAST(y // s AS INT) AS y, CAST(x // s AS INT) AS x, r, g, b FROM {EVENTS} p JOIN (SELECT image_id, greatest(1, greatest(max(y)+1, max(x)+1) // 25) AS s FROM {EVENTS} GROUP BY image_id) d ON p.image_id = d.image_id WHERE y % s = 0 AND x % s = 0")
    for mode in metering.STRATEGIES:
        slug = mode.replace("-", "_")
        image(f"meter_{slug}", lambda p, m=mode: _round(metering.meter(p, m), ["gain"]), f"SELECT image_id, {X.rounded('gain')} AS gain FROM ({_meter_sql(mode)})")
        image(f"auto_expose_{slug}", lambda p, m=mode: _round(metering.auto_expose(p, m).select(*PX_KEYS, "r", "g", "b")), f"SELECT p.image_id, y, x, {', '.join(f'{X.rounded(f'{c}*gain')} AS {c}' for c in 'rgb')} FROM {EVENTS} p JOIN ({_meter_sql(mode)}) m ON p.image_id = m.image_id")
    hist = f"SELECT g.image_id, g.channel, CAST(g.bin AS INT) AS bin, count(v) AS n FROM (SELECT * FROM (SELECT DISTINCT image_id FROM {EVENTS}), (VALUES ('r'), ('g'), ('b')) c(channel), range(128) t(bin)) g LEFT JOIN (UNPIVOT (SELECT image_id, r, g, b FROM {EVENTS}) ON r, g, b INTO NAME channel VALUE v) p ON p.image_id = g.image_id AND p.channel = g.channel AND v BETWEEN 0 AND 1 AND least(CAST(floor(v*128) AS INT), 127) = g.bin GROUP BY ALL"
    image("histogram", stats.histogram, hist)
    image("histogram_ylim", lambda p: _round(stats.histogram_limit(stats.histogram(p)), ["ylim"]), f"SELECT image_id, {X.rounded('CASE WHEN im > 0 THEN greatest(1.5e0*p98, 0.1e0*top) WHEN top > 0 THEN CAST(top AS DOUBLE) ELSE 1e0 END')} AS ylim FROM (SELECT image_id, quantile_cont(CASE WHEN bin BETWEEN 1 AND 126 THEN n END, 0.98) AS p98, max(CASE WHEN bin BETWEEN 1 AND 126 THEN n END) AS im, max(n) AS top FROM ({hist}) GROUP BY image_id)")
    out["progress_running"] = (
        lambda s, d: _round(stats.progress(tables.read(s, d, "events").selectExpr("event_id seq", "case when event_type = 'view' then 'done' end status")), ["pct"]),
        f"SELECT seq, processed, {X.rounded('processed/CAST(total AS DOUBLE)*100e0')} AS pct FROM (SELECT event_id AS seq, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS processed, count(*) OVER () AS total FROM events)",
    )
    out["debounce_events"] = (
        lambda s, d: E.debounce(tables.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))),
        "SELECT user_id, count(*) AS n_events, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(CASE WHEN pt IS NULL OR ts >= pt + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events)) GROUP BY user_id, s",
    )
    names = lambda s, d: tables.read(s, d, "part").selectExpr("p_partkey", "concat('/in/', p_name, element_at(array('.DNG', '.cr3', '.jpg', '.Nef', ''), cast(p_partkey % 5 + 1 as int))) as path")
    names_sql = "(SELECT p_partkey, '/in/' || p_name || (['.DNG', '.cr3', '.jpg', '.Nef', ''])[CAST(p_partkey % 5 + 1 AS INT)] AS path FROM part)"
    out["filter_extension"] = (lambda s, d: names(s, d).filter(has_suffix("path")), f"SELECT * FROM {names_sql} WHERE {' OR '.join(f'''lower(path) LIKE '%{e}' ''' for e in EXTENSIONS)}")
    out["output_name"] = (lambda s, d: names(s, d).select("p_partkey", sinks.output_name("path", "tif").alias("out")), f"SELECT p_partkey, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.tif' AS out FROM {names_sql}")
    sized = f"(SELECT p.*, h, w, {geometry.RADIUS2} AS q FROM {EVENTS} p JOIN (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM {EVENTS} GROUP BY image_id) d ON p.image_id = d.image_id)"
    fall = f"(1e0+{X.num(K[0])}*q+{X.num(K[1])}*q*q+{X.num(K[2])}*q*q*q)"
    image("vignetting", lambda p: _round(geometry.devignette(p, *K)), _sql(PX_KEYS, sized, *[f"{c}/{fall}" for c in "rgb"], round_=True))
    a, b, c = WARP[:3]
    s = f"({X.num(a)}*q*sqrt(q)+{X.num(b)}*q+{X.num(c)}*sqrt(q)+{X.num(1 - a - b - c)})"
    place = f"(SELECT image_id, y, x, (h-1)/2e0+(y-(h-1)/2e0)*({s}) AS sy, (w-1)/2e0+(x-(w-1)/2e0)*({s}) AS sx FROM {sized})"
    taps = " UNION ALL ".join(f"SELECT image_id, y, x, CAST(floor(sy) AS INT)+{a} AS ty, CAST(floor(sx) AS INT)+{b} AS tx, {'(sy-floor(sy))' if a else '(1e0-(sy-floor(sy)))'}*{'(sx-floor(sx))' if b else '(1e0-(sx-floor(sx)))'} AS k FROM {place}" for a in (0, 1) for b in (0, 1))
    image("remap_bilinear", lambda p: _round(geometry.remap_bilinear(p, *WARP)), f"SELECT t.image_id, t.y, t.x, {', '.join(f'{X.rounded(f'sum(coalesce(p.{c}, 0e0)*k)')} AS {c}' for c in 'rgb')} FROM ({taps}) t LEFT JOIN {EVENTS} p ON p.image_id = t.image_id AND p.y = t.ty AND p.x = t.tx GROUP BY t.image_id, t.y, t.x")
    image("remap_cubic", lambda p: geometry.remap_cubic(p, *WARP), None)
    exposed = f"(SELECT p.image_id, y, x, {', '.join(f'{c}*gain AS {c}' for c in 'rgb')} FROM {EVENTS} p JOIN ({_meter_sql('hybrid')}) m ON p.image_id = m.image_id)"
    for name, (gamut, curve) in LOG_SPACES.items():
        mapped = f"(SELECT {', '.join(PX_KEYS)}, {', '.join(f'{e} AS {c}' for e, c in zip(X.gamut(gamut), 'rgb', strict=True))} FROM {BOOSTED.replace('{source}', exposed)})"
        coded = f"(SELECT {', '.join(PX_KEYS)}, {', '.join(f'{X.log_curve(curve, c)} AS {c}' for c in 'rgb')} FROM {mapped})"
        image(f"develop_{_slug(name)}", lambda p, n=name: _round(develop(p, Params(n))), _each(coded, lambda v: v, True, PX_KEYS))
        if name == "V-Log":
            image("develop_vlog_lut", lambda p: _round(develop(p, Params("V-Log", lut=lut17()))), _lut_sql(PX_KEYS, coded))
    return out


def queries() -> dict:
    return {k: q for k, (q, _) in catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in catalogue().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue()["develop_vlog_lut"][0](spark, sf_dir)
