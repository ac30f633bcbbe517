"""Registered queries of colour spaces, differences and tables, with SQL oracles of the values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import colormaps as CM
from ..functions import photometry as PH
from . import series as R
from .registry import query

#: Linear colours, and XYZ of each, in SQL.
BASE = f"{R.COLORS}, x0 AS (SELECT o, l, r, g, b, 0.4124 * r + 0.3576 * g + 0.1805 * b AS x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, 0.0193 * r + 0.1192 * g + 0.9505 * b AS z FROM c)"


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def _cols(names: str):
    return tuple(F.col(c) for c in names.split())


def _named(c, names: str):
    return [x.alias(n) for x, n in zip(c, names.split(), strict=True)]


def _lab(white: str, source: str = "x0", tail: str = "lab") -> str:
    w = K.WHITE[white]
    f = [f"CASE WHEN {c} / {v} > (6.0 / 29) ^ 3 THEN cbrt({c} / {v}) ELSE {c} / {v} * ((29.0 / 6) ^ 2 / 3) + 4.0 / 29 END AS f{c}" for c, v in zip("xyz", w, strict=True)]
    return f"{tail}_f AS (SELECT o, l, {', '.join(f)} FROM {source}), {tail} AS (SELECT o, l, 116 * fy - 16 AS lum, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM {tail}_f)"


def _luv(white: str) -> str:
    x, y, z = K.WHITE[white]
    u0, v0 = 4 * x / (x + 15 * y + 3 * z), 9 * y / (x + 15 * y + 3 * z)
    return f"luv_d AS (SELECT o, l, y, x + 15 * y + 3 * z AS d, x FROM x0), luv_l AS (SELECT o, l, CASE WHEN y / {y} > (6.0 / 29) ^ 3 THEN 116 * cbrt(y / {y}) - 16 ELSE y / {y} * (29.0 / 3) ^ 3 END AS lum, CASE WHEN d = 0 THEN {u0!r} ELSE 4 * x / d END - {u0!r} AS u, CASE WHEN d = 0 THEN {v0!r} ELSE 9 * y / d END - {v0!r} AS v FROM luv_d), luv AS (SELECT o, l, lum, 13 * lum * u AS u, 13 * lum * v AS v FROM luv_l)"


for _white in K.WHITE:

    def _to_lab(spark, d, white=_white):
        return R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "cielab", white), "lum a b"))

    query(f"color_lab_{_white}", f"WITH {BASE}, {_lab(_white)} SELECT o, l, lum, a, b FROM lab")(_to_lab)


@query("color_luv", f"WITH {BASE}, {_luv('d65')} SELECT o, l, lum, u, v FROM luv")
def color_luv(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "cieluv"), "lum u v"))


# Hues are compared by their points on the circle, scaled by the chroma: those of gray are noise.
_POLAR = "sqrt(p ^ 2 + q ^ 2) AS chroma, p AS across, q AS along, CASE WHEN lum = 0 THEN 0 ELSE sqrt(p ^ 2 + q ^ 2) / lum END AS saturation"
for _name, _polar, _sat, _source in (("color_polar", "cielch", "lshab", f"{_lab('d65')}, s AS (SELECT o, l, lum, a AS p, b AS q FROM lab)"), ("color_polar_uv", "cielchuv", "lshuv", f"{_luv('d65')}, s AS (SELECT o, l, lum, u AS p, v AS q FROM luv)")):

    def _to_polar(spark, d, polar=_polar, sat=_sat):
        base = R.colors(spark, d)
        out = base.select("o", "l", *_named(K.convert(_rgb(), "linearrgb", polar), "lum chroma h"), K.convert(_rgb(), "linearrgb", sat)[1].alias("saturation"))
        return out.select("o", "l", "chroma", (F.col("chroma") * F.cos("h")).alias("across"), (F.col("chroma") * F.sin("h")).alias("along"), "saturation")

    query(_name, f"WITH {BASE}, {_source} SELECT o, l, {_POLAR} FROM s")(_to_polar)


@query("color_lms", f"WITH {R.COLORS} SELECT o, l, ln(1 + 0.313899 * r + 0.639496 * g + 0.046612 * b) AS lo, ln(1 + 0.151644 * r + 0.748242 * g + 0.100047 * b) AS me, ln(1 + 0.017725 * r + 0.109473 * g + 0.872939 * b) AS sh FROM c")
def color_lms(spark, d):
    """Logarithms, as the sums themselves end in few digits and would be compared at a half of the last."""
    return R.colors(spark, d).select("o", "l", *_named([F.log1p(x) for x in K.convert(_rgb(), "linearrgb", "lms")], "lo me sh"))


_SRGB = ", ".join(f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END AS s{c}, CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4::DOUBLE) END AS n{c}" for c in "rgb")


@query("color_srgb", f"WITH {R.COLORS} SELECT o, l, {_SRGB} FROM c")
def color_srgb(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.linear_to_srgb(_rgb()), "sr sg sb"), *_named(K.srgb_to_linear(_rgb()), "nr ng nb"))


def _back(name: str, space: str, sql: str):
    """From a space to linear RGB; the oracle has made the space's values itself, so they come back as the colours they were made of."""

    @query(name, f"WITH {R.COLORS} SELECT o, l, r, g, b FROM c WHERE r + g + b > 0")
    def run(spark, d):
        base = R.colors(spark, d).where("r + g + b > 0")
        there = base.select("o", "l", F.expr(sql).alias("s")).select("o", "l", *_named((F.col("s.p0"), F.col("s.p1"), F.col("s.p2")), "p0 p1 p2"))
        xyz = there.select("o", "l", *_named(K.convert(_cols("p0 p1 p2"), space, "ciexyz"), "x y z"))
        return xyz.select("o", "l", *_named(K.convert(_cols("x y z"), "ciexyz", "linearrgb"), "r g b")).select("o", "l", *[F.round(c, 9).alias(c) for c in "rgb"])

    return run


_X, _Y, _Z = "(0.4124D * r + 0.3576D * g + 0.1805D * b)", "(0.2126D * r + 0.7152D * g + 0.0722D * b)", "(0.0193D * r + 0.1192D * g + 0.9505D * b)"
_FX, _FY, _FZ = (f"(CASE WHEN {c} / {w}D > power(6D / 29, 3) THEN cbrt({c} / {w}D) ELSE {c} / {w}D * (power(29D / 6, 2) / 3) + 4D / 29 END)" for c, w in zip((_X, _Y, _Z), K.WHITE["d65"], strict=True))
_L, _A, _B = f"(116 * {_FY} - 16)", f"(500 * ({_FX} - {_FY}))", f"(200 * ({_FY} - {_FZ}))"
_WX, _WY, _WZ = K.WHITE["d65"]
_U0, _V0 = 4 * _WX / (_WX + 15 * _WY + 3 * _WZ), 9 * _WY / (_WX + 15 * _WY + 3 * _WZ)
_LU = f"(CASE WHEN {_Y} > power(6D / 29, 3) THEN 116 * cbrt({_Y}) - 16 ELSE {_Y} * power(29D / 3, 3) END)"
_UU, _VV = f"(13 * {_LU} * (4 * {_X} / ({_X} + 15 * {_Y} + 3 * {_Z}) - {_U0!r}D))", f"(13 * {_LU} * (9 * {_Y} / ({_X} + 15 * {_Y} + 3 * {_Z}) - {_V0!r}D))"
_struct = "named_struct('p0', {}, 'p1', {}, 'p2', {})".format
_back("color_from_lab", "cielab", _struct(_L, _A, _B))
_back("color_from_lch", "cielch", _struct(_L, f"hypot({_A}, {_B})", f"atan2({_B}, {_A})"))
_back("color_from_luv", "cieluv", _struct(_LU, _UU, _VV))
_back("color_from_lshuv", "lshuv", _struct(_LU, f"(hypot({_UU}, {_VV}) / {_LU})", f"atan2({_VV}, {_UU})"))
_back("color_from_lms", "lms", _struct("(0.313899D * r + 0.639496D * g + 0.046612D * b)", "(0.151644D * r + 0.748242D * g + 0.100047D * b)", "(0.017725D * r + 0.109473D * g + 0.872939D * b)"))

_HCL = """h AS (SELECT o, l, r - g AS rg, g - b AS gb, b - r AS br, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c), q AS (SELECT *, exp(CASE WHEN hi = 0 THEN 0 ELSE lo / hi / 10 END) AS q, CASE WHEN rg = 0 THEN sign(gb) * pi() / 2 ELSE atan(gb / rg) END AS t FROM h)"""


@query("color_hcl", f"WITH {R.COLORS}, {_HCL} SELECT o, l, CASE WHEN rg >= 0 AND gb >= 0 THEN t * 2 / 3 WHEN rg >= 0 THEN t * 4 / 3 WHEN gb >= 0 THEN t * 4 / 3 + pi() ELSE t * 2 / 3 - pi() END AS hue, q / 3 * (abs(rg) + abs(gb) + abs(br)) AS chroma, (q * hi + (q - 1) * lo) / 2 AS light FROM q")
def color_hcl(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.linear_to_hcl(_rgb()), "hue chroma light"))


# Where a part stood between the least and the largest it stands again; those two follow from chroma and lightness.
@query(
    "color_from_hcl",
    f"""WITH {R.COLORS}, {_HCL.replace("SELECT o, l, r - g", "SELECT o, l, r, g, b, r - g")}, e AS (SELECT *, q / 3 * (abs(rg) + abs(gb) + abs(br)) AS ch, (q * hi + (q - 1) * lo) / 2 AS li FROM q),
    p AS (SELECT *, exp((1 - CASE WHEN li = 0 THEN 1 ELSE 3 * ch / (4 * li) END) / 10) AS q2 FROM e), m AS (SELECT *, (4 * li - 3 * ch) / (4 * q2 - 2) AS low, 3 * ch / (2 * q2) AS span FROM p)
    SELECT o, l, """ + ", ".join(f"round(low + CASE WHEN hi = lo THEN 0 ELSE span * ({c} - lo) / (hi - lo) END, 9) AS {c}" for c in "rgb") + " FROM m",
)
def color_from_hcl(spark, d):
    there = R.colors(spark, d).select("o", "l", *_named(K.linear_to_hcl(_rgb()), "p0 p1 p2"))
    return there.select("o", "l", *_named(K.hcl_to_linear(_cols("p0 p1 p2")), "r g b")).select("o", "l", *[F.round(c, 9).alias(c) for c in "rgb"])


_PAIR = f"WITH {BASE}, {_lab('d65')}, p AS (SELECT a.o, a.l, a.lum AS l1, a.a AS a1, a.b AS b1, b.lum AS l2, b.a AS a2, b.b AS b2 FROM lab a JOIN lab b ON b.o = a.o AND b.l = a.l + 1)"


def _pairs(spark, d):
    """Colours of consecutive lines of an order."""
    lab = R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "cielab"), "l1 a1 b1"))
    return lab.join(lab.select("o", (F.col("l") - 1).alias("l"), *_named(_cols("l1 a1 b1"), "l2 a2 b2")), ["o", "l"])


@query(
    "color_lab_distance",
    _PAIR + """, cc AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cb FROM p), s AS (SELECT *, 1 + (1 - sqrt(cb ^ 7 / (cb ^ 7 + 6103515625))) / 2 AS st FROM cc),
    q AS (SELECT *, sqrt((a1 * st) ^ 2 + b1 * b1) AS c1, sqrt((a2 * st) ^ 2 + b2 * b2) AS c2, atan2(b1, a1 * st) AS t1, atan2(b2, a2 * st) AS t2 FROM s),
    h AS (SELECT *, t1 + CASE WHEN t1 < 0 THEN 2 * pi() ELSE 0 END AS h1, t2 + CASE WHEN t2 < 0 THEN 2 * pi() ELSE 0 END AS h2, (c1 + c2) / 2 AS cm, (l1 + l2) / 2 AS lm FROM q),
    g AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h1 - h2) <= pi() THEN h2 - h1 WHEN h2 <= h1 THEN h2 - h1 + 2 * pi() ELSE h2 - h1 - 2 * pi() END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) > pi() THEN (h1 + h2) / 2 + pi() ELSE (h1 + h2) / 2 END AS hm FROM h),
    t AS (SELECT *, 1 - 0.17 * cos(hm - radians(30)) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + radians(6)) - 0.2 * cos(4 * hm - radians(63)) AS t FROM g),
    e AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) ^ 2 / sqrt(20 + (lm - 50) ^ 2)) AS x, (c2 - c1) / (1 + 0.045 * cm) AS y, 2 * sqrt(c1 * c2) * sin(dh / 2) / (1 + 0.015 * cm * t) AS z, -2 * sqrt(cm ^ 7 / (cm ^ 7 + 6103515625)) * sin(radians(60) * exp(-1 * ((hm - radians(275)) / radians(25)) ^ 2)) AS rt FROM t)
    SELECT o, l, sqrt(x * x + y * y + z * z + rt * y * z) AS distance FROM e""",
)
def color_lab_distance(spark, d):
    return _pairs(spark, d).select("o", "l", K.lab_distance(_cols("l1 a1 b1"), _cols("l2 a2 b2")).alias("distance"))


@query(
    "color_lch_distance",
    _PAIR + """, q AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, degrees(atan2(b1, a1)) AS t FROM p), h AS (SELECT *, t + CASE WHEN t < 0 THEN 360 ELSE 0 END AS h, 0.0638 * c1 / (1 + 0.0131 * c1) + 0.638 AS sc, sqrt(c1 ^ 4 / (c1 ^ 4 + 1900)) AS f FROM q),
    s AS (SELECT *, CASE WHEN l1 < 16 THEN 0.511 ELSE 0.040975 * l1 / (1 + 0.01765 * l1) END AS sl, CASE WHEN h BETWEEN 164 AND 345 THEN 0.56 + abs(0.2 * cos(radians(h + 168))) ELSE 0.36 + abs(0.4 * cos(radians(h + 35))) END AS t2 FROM h)
    SELECT o, l, sqrt(((l2 - l1) / (2 * sl)) ^ 2 + ((c2 - c1) / sc) ^ 2 + greatest(0, (a1 - a2) ^ 2 + (b1 - b2) ^ 2 - (c1 - c2) ^ 2) / (sc * (f * t2 + 1 - f)) ^ 2) AS distance FROM s""",
)
def color_lch_distance(spark, d):
    one, two = (K.to_polar(_cols(c)) for c in ("l1 a1 b1", "l2 a2 b2"))
    return _pairs(spark, d).select("o", "l", K.lch_distance(one, two, 2.0).alias("distance"))


@query("color_turned", f"WITH {R.COLORS}, t AS (SELECT *, cos(radians(40)) AS u, sin(radians(40)) AS w FROM c) SELECT o, l, (0.299 + 0.701 * u + 0.168 * w) * r + (0.587 - 0.587 * u + 0.33 * w) * g + (0.114 - 0.114 * u - 0.497 * w) * b AS tr, (0.299 - 0.299 * u - 0.328 * w) * r + (0.587 + 0.413 * u + 0.035 * w) * g + (0.114 - 0.114 * u + 0.292 * w) * b AS tg, (0.299 - 0.3 * u + 1.25 * w) * r + (0.587 - 0.588 * u - 1.05 * w) * g + (0.114 + 0.886 * u - 0.203 * w) * b AS tb FROM t")
def color_turned(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.rotate_hue(_rgb(), 40), "tr tg tb"))


@query("color_alpha", f"WITH {R.COLORS}, a AS (SELECT *, CASE WHEN l % 3 = 0 THEN 0 ELSE b / 2 END AS o1, CASE WHEN l % 2 = 0 THEN 0 ELSE g / 2 END AS o2 FROM c), s AS (SELECT *, o1 + (1 - o1) * o2 AS oa FROM a) SELECT o, l, CASE WHEN oa = 0 THEN 0 ELSE (o1 * r + (1 - o1) * o2 * g) / (oa + 1e-20) END AS red, oa AS alpha, o1 * r + (1 - o1) * g AS solid, r * b AS applied FROM s")
def color_alpha(spark, d):
    r, g, b = _rgb()
    over, under = F.when(F.col("l") % 3 == 0, 0.0).otherwise(b / 2), F.when(F.col("l") % 2 == 0, 0.0).otherwise(g / 2)
    both = K.blend_alpha((g, g, g, under), (r, r, r, over))
    return R.colors(spark, d).select("o", "l", both[0].alias("red"), both[3].alias("alpha"), K.blend_alpha((g, g, g), (r, r, r, over))[0].alias("solid"), K.apply_alpha((r, g, b))[0].alias("applied"))


@query("color_lut", f"WITH {R.COLORS}, e AS (SELECT min(b) AS lo, max(b) AS hi FROM c), i AS (SELECT o, l, CASE WHEN l = 3 THEN 0 ELSE greatest(0, least(31, floor((b - lo) / (hi - lo) * 32))) END AS i FROM c CROSS JOIN e) SELECT o, l, exp(-0.5 * ((i / 31.0::DOUBLE - 0.8) / 0.2) ^ 4) AS r, exp(-0.5 * ((i / 31.0::DOUBLE - 0.5) / 0.25) ^ 4) AS g, exp(-0.5 * ((i / 31.0::DOUBLE - 0.2) / 0.2) ^ 4) AS b FROM i")
def color_lut(spark, d):
    """Limits are those of the data; every third line has no value."""
    low = R.colors(spark, d).agg(F.min("b"), F.max("b")).first()
    rows = R.colors(spark, d).select("o", "l", F.when(F.col("l") == 3, F.lit(float("nan"))).otherwise(F.col("b")).alias("v"))
    return K.apply_lut(rows, "v", CM.jet(spark, 32), 32, *low).select("o", "l", "r", "g", "b")


@query("color_lut_own_limits", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS v FROM part), e AS (SELECT min(v) AS lo, max(v) AS hi FROM p) SELECT p_partkey, CASE WHEN v IS NULL THEN 0 ELSE greatest(0, least(15, floor((v - lo) / (hi - lo) * 16))) END / 15.0::DOUBLE AS r FROM p CROSS JOIN e")
def color_lut_own_limits(spark, d):
    table = spark.range(16).select(F.col("id").cast("int").alias("i"), (F.col("id") / 15.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    rows = R.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("v"))
    return K.apply_lut(rows, "v", table, 16).select("p_partkey", "r")


# Tables

_JET = "j AS (SELECT i, exp(-0.5 * ((i / {0}.0::DOUBLE - 0.8) / 0.2) ^ 4) AS r, exp(-0.5 * ((i / {0}.0::DOUBLE - 0.5) / 0.25) ^ 4) AS g, exp(-0.5 * ((i / {0}.0::DOUBLE - 0.2) / 0.2) ^ 4) AS b FROM range({1}) t(i))".format


@query("color_map_dark_jet", f"WITH {_JET(63, 64)}, k AS (SELECT *, tanh(0.6 / ((2 * r + 3 * g + b) / 6)) AS k, (r + g + b) / 3 AS m FROM j) SELECT CAST(i AS INTEGER) AS i, greatest(0, least(1, k * (2 * r - m))) AS r, greatest(0, least(1, k * (2 * g - m))) AS g, greatest(0, least(1, k * (2 * b - m))) AS b FROM k")
def color_map_dark_jet(spark, d):
    return CM.dark_jet(spark, 64)


@query("color_map_gray_red", "SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 75 THEN 1 - i / 74.0::DOUBLE ELSE 1 END AS r, CASE WHEN i < 75 THEN 1 - i / 74.0::DOUBLE ELSE 1 - (i - 75) / 24.0::DOUBLE END AS g, CASE WHEN i < 75 THEN 1 - i / 74.0::DOUBLE ELSE 0 END AS b FROM range(100) t(i)")
def color_map_gray_red(spark, d):
    return CM.gray_red(spark)


@query("color_map_blue_gray_red", "SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 25 THEN 0 WHEN i < 75 THEN 1 - (i - 25) / 49.0::DOUBLE ELSE 1 END AS r, CASE WHEN i < 25 THEN 1 - i / 24.0::DOUBLE WHEN i < 75 THEN 1 - (i - 25) / 49.0::DOUBLE ELSE 1 - (i - 75) / 24.0::DOUBLE END AS g, CASE WHEN i < 25 THEN 1 WHEN i < 75 THEN 1 - (i - 25) / 49.0::DOUBLE ELSE 0 END AS b FROM range(100) t(i)")
def color_map_blue_gray_red(spark, d):
    return CM.blue_gray_red(spark)


@query("color_map_blue_red", "SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 4 THEN 0 WHEN i < 14 THEN (i - 4) / 9.0::DOUBLE WHEN i < 24 THEN 1 ELSE (9 - (i - 24)) / 9.0::DOUBLE END AS r, CASE WHEN i < 4 OR i >= 24 THEN 0 WHEN i < 14 THEN (i - 4) / 9.0::DOUBLE ELSE (23 - i) / 9.0::DOUBLE END AS g, CASE WHEN i < 4 THEN (i + 6) / 9.0::DOUBLE WHEN i < 14 THEN 1 WHEN i < 24 THEN (23 - i) / 9.0::DOUBLE ELSE 0 END AS b FROM range(28) t(i)")
def color_map_blue_red(spark, d):
    """With the darkest four tenths before and after."""
    return CM.blue_red(spark, 10, 0.4)


@query("color_map_dark_hsv", "WITH h AS (SELECT i, cos(i * 2 * pi() / 24) / 2 + 0.5 AS r, cos(i * 2 * pi() / 24 + 2 * pi() / 3) / 2 + 0.5 AS g, cos(i * 2 * pi() / 24 + 4 * pi() / 3) / 2 + 0.5 AS b FROM range(24) t(i)), k AS (SELECT *, 0.3 / ((2 * r + 3 * g + b) / 6) AS k, (r + g + b) / 3 AS m FROM h) SELECT CAST(i AS INTEGER) AS i, least(1, r * k * sqrt(greatest(0, r / m))) AS r, least(1, g * k * sqrt(greatest(0, g / m))) AS g, least(1, b * k * sqrt(greatest(0, b / m))) AS b FROM k")
def color_map_dark_hsv(spark, d):
    return CM.dark_hsv(spark, 24)


@query("color_map_resistor", "SELECT CAST(i AS INTEGER) AS i, c[1] AS r, c[2] AS g, c[3] AS b FROM (SELECT unnest(range(10)) AS i, unnest([[0, 0, 0], [0.7, 0.1, 0.1], [1, 0.1, 0], [0.9, 0.6, 0], [0.8, 0.8, 0], [0, 0.8, 0], [0, 0, 1], [0.7, 0, 1], [0.5, 0.5, 0.5], [1, 1, 1]]::DOUBLE[][]) AS c)")
def color_map_resistor(spark, d):
    return CM.resistor(spark, True)


@query("color_letters", "SELECT s, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM (VALUES ('c', 0.0, 1.0, 1.0), ('k', 0.0, 0.0, 0.0), ('m', 1.0, 0.0, 1.0), ('w', 1.0, 1.0, 1.0), ('y', 1.0, 1.0, 0.0)) t(s, r, g, b)")
def color_letters(spark, d):
    return spark.createDataFrame([(s, *CM.letter(s)) for s in "ckmwy"], "s string, r double, g double, b double")


@query("color_map_even_hsv")
def color_map_even_hsv(spark, d):
    return CM.even_hsv(spark)


@query("color_map_distinct")
def color_map_distinct(spark, d):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CM.distinct(12))], "i int, r double, g double, b double")


@query("color_table_gray_centre")
def color_table_gray_centre(spark, d):
    return CM.cycle_table(spark, 1)


# What a table looks like from outside: its cells, that white is in its middle, and that every value is a colour.
@query("color_table_white_centre", "SELECT 360 AS hues, CAST(36000 AS BIGINT) AS cells, CAST(360 AS BIGINT) AS white, true AS held")
def color_table_white_centre(spark, d):
    t = CM.cycle_table(spark, 2)
    near = F.abs(F.col("r") - 0.99) + F.abs(F.col("g") - 0.99) + F.abs(F.col("b") - 0.99) < 1e-9
    held = F.min((F.least("r", "g", "b") >= 0) & (F.greatest("r", "g", "b") <= 1))
    return t.agg(F.count_distinct("h").cast("int").alias("hues"), F.count("*").alias("cells"), F.count_if((F.col("c") == 0) & near).alias("white"), held.alias("held"))


@query("color_looked_up", f"WITH {R.SPECTRA}, z AS (SELECT k, max(CASE WHEN i = 0 THEN x END) AS re, max(CASE WHEN i = 1 THEN x END) AS im FROM s GROUP BY k) SELECT k, CAST((CAST(trunc(atan2(im, re) * 360 / (2 * pi())) AS INTEGER) + 360) % 360 AS DOUBLE) AS r, CAST(least(99, trunc(sqrt(re * re + im * im) * 100)) AS DOUBLE) AS g FROM z")
def color_looked_up(spark, d):
    """The table holds its own numbers, so that the cells that values fall on show."""
    z = R.spectra(spark, d).groupBy("k").agg(F.max(F.when(F.col("i") == 0, F.col("x"))).alias("re"), F.max(F.when(F.col("i") == 1, F.col("x"))).alias("im"))
    cells = spark.range(36000).select(F.floor(F.col("id") / 100).cast("int").alias("h"), (F.col("id") % 100).cast("int").alias("c"))
    table = cells.select("h", "c", F.col("h").cast("double").alias("r"), F.col("c").cast("double").alias("g"), F.lit(0.0).alias("b"))
    return CM.look_up(z, "re", "im", table).select("k", "r", "g")


@query("complex_colors")
def complex_colors(spark, d):
    z = R.spectra(spark, d).groupBy("k").agg((F.max(F.when(F.col("i") == 0, F.col("x"))) / 2).alias("re"), (F.max(F.when(F.col("i") == 1, F.col("x"))) / 2).alias("im"))
    return CM.complex_colors(z, "re", "im")


# Light

_V = ", ".join(f"({PH.FIRST_NM + PH.STEP_NM * i}, {v!r})" for i, v in enumerate(PH.EFFICIENCY))
_EFF = f"v(w, e) AS (VALUES {_V}), p AS (SELECT p_partkey AS k, p_retailprice AS lm, CAST(300 + p_partkey * 7 % 600 AS DOUBLE) AS nm FROM part), h AS (SELECT *, greatest(360, least(830, nm)) AS pos FROM p), f AS (SELECT h.k, h.lm, h.pos, any_value(a.e) AS e0, any_value(b.e) AS e1, floor(h.pos / 5) * 5 AS w0 FROM h JOIN v a ON a.w = floor(h.pos / 5) * 5 JOIN v b ON b.w = least(830, floor(h.pos / 5) * 5 + 5) GROUP BY h.k, h.lm, h.pos)"


@query("lumen_to_watt", f"WITH {_EFF} SELECT k, lm / (683 * (e0 + (pos - w0) / 5 * (e1 - e0))) AS watt FROM f")
def lumen_to_watt(spark, d):
    nm = (300 + F.col("p_partkey") * 7 % 600).cast("double")
    return R.table(spark, d, "part").select(F.col("p_partkey").alias("k"), PH.lumen_to_watt(F.col("p_retailprice"), nm).alias("watt"))


@query("candela_to_watt", f"WITH r AS (SELECT radians(0.1 * (i + 0.5::DOUBLE)) AS t FROM range(900) x(i)), s AS (SELECT s_suppkey AS k, s_acctbal AS cd, 5.0::DOUBLE + s_nationkey AS deg FROM supplier), b AS (SELECT s.k, s.cd, sum(radians(0.1) * 2 * pi() * sin(t) * exp(-ln(2) / pow(radians(deg / 2), 4) * pow(t, 4))) AS g FROM s CROSS JOIN r GROUP BY s.k, s.cd) SELECT k, cd * g / {PH.EFFICIENCY[39]!r} / 683 AS watt FROM b")
def candela_to_watt(spark, d):
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), PH.candela_to_watt(F.col("s_acctbal"), 5.0 + F.col("s_nationkey")).alias("watt"))


assert math.isclose(PH.EFFICIENCY[39], 1.0, rel_tol=0.01)  # 555 nm
