"""Colour spaces as Column expressions: a colour is a tuple of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Color = tuple[Column, Column, Column]

#: Linear sRGB to XYZ, linear sRGB to LMS, and white points.
RGB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
RGB_LMS = ((0.313899, 0.639496, 0.046612), (0.151644, 0.748242, 0.100047), (0.017725, 0.109473, 0.872939))
WHITE = {
    "d50": (0.9642, 1.0, 0.8251),
    "d55": (0.9568, 1.0, 0.9214),
    "d65": (0.9504, 1.0, 1.0889),
    "a": (1.0985, 1.0, 0.3558),
    "c": (0.9807, 1.0, 1.1823),
}


def _inverse(m):
    import numpy as np

    return tuple(map(tuple, np.linalg.inv(np.array(m)).tolist()))


def _apply(m, c: Color) -> Color:
    return tuple(c[0] * F.lit(r[0]) + c[1] * F.lit(r[1]) + c[2] * F.lit(r[2]) for r in m)


def _held(x: Column, inner: Column) -> Column:
    """inner, but x where it is null or NaN."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(inner)


def clip_color(c: Color, mode: int) -> Color:
    """0 none; 1 within [0, 1]; 2 no less than black, and scaled if over white; 3 null where any part is outside [0, 1]. Null and NaN stay."""
    if mode == 0:
        return c
    low = tuple(_held(x, F.greatest(x, F.lit(0.0))) for x in c)
    if mode == 1:
        return tuple(_held(x, F.least(x, F.lit(1.0))) for x in low)
    if mode == 2:
        top = F.greatest(F.lit(1.0), *[F.when(~F.isnan(x), x) for x in low])
        return tuple(_held(x, x / top) for x in low)
    if mode == 3:
        inside = (c[0] >= 0) & (c[0] <= 1) & (c[1] >= 0) & (c[1] <= 1) & (c[2] >= 0) & (c[2] <= 1)
        return tuple(F.when(inside, x) for x in c)
    raise ValueError(f"no clip mode {mode}")


def srgb_to_linear(c: Color) -> Color:
    return tuple(F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))) for x in c)


def linear_to_srgb(c: Color) -> Color:
    return tuple(_held(x, F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)) for x in c)


def linear_to_xyz(c: Color) -> Color:
    return _apply(RGB_XYZ, c)


def xyz_to_linear(c: Color, clip: int = 1) -> Color:
    return clip_color(_apply(_inverse(RGB_XYZ), c), clip)


def xyz_to_lms(c: Color) -> Color:
    return _apply(RGB_LMS, _apply(_inverse(RGB_XYZ), c))


def lms_to_xyz(c: Color) -> Color:
    return _apply(RGB_XYZ, _apply(_inverse(RGB_LMS), c))


def xyz_to_lab(c: Color, white: str = "d65") -> Color:
    f = [F.when(x / w > (6 / 29) ** 3, F.cbrt(x / w)).otherwise(x / w * ((29 / 6) ** 2 / 3) + 4 / 29) for x, w in zip(c, WHITE[white], strict=True)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lab_to_xyz(c: Color, white: str = "d65") -> Color:
    y = (c[0] + 16) / 116
    return tuple(F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * (3 * (6 / 29) ** 2)) * F.lit(w) for t, w in zip((y + c[1] / 500, y, y - c[2] / 200), WHITE[white], strict=True))


def to_polar(c: Color) -> Color:
    """(L, a, b) to (L, chroma, hue in radians, from -pi)."""
    return c[0], F.sqrt(c[1] * c[1] + c[2] * c[2]), F.atan2(c[2], c[1])


def from_polar(c: Color) -> Color:
    return c[0], c[1] * F.cos(c[2]), c[1] * F.sin(c[2])


def _uv(white: str) -> tuple[float, float]:
    x, y, z = WHITE[white]
    d = x + 15 * y + 3 * z
    return 4 * x / d, 9 * y / d


def xyz_to_luv(c: Color, white: str = "d65") -> Color:
    u0, v0 = _uv(white)
    y = c[1] / WHITE[white][1]
    lum = F.when(y > (6 / 29) ** 3, 116 * F.cbrt(y) - 16).otherwise(y * (29 / 3) ** 3)
    d = c[0] + 15 * c[1] + 3 * c[2]
    u, v = F.coalesce(F.try_divide(4 * c[0], d), F.lit(u0)), F.coalesce(F.try_divide(9 * c[1], d), F.lit(v0))
    return lum, 13 * lum * (u - u0), 13 * lum * (v - v0)


def luv_to_xyz(c: Color, white: str = "d65") -> Color:
    u0, v0 = _uv(white)
    y = F.when(c[0] > 8, F.pow((c[0] + 16) / 116, F.lit(3.0))).otherwise(c[0] * (3 / 29) ** 3) * WHITE[white][1]
    u, v = F.coalesce(F.try_divide(c[1], 13 * c[0]), F.lit(0.0)) + u0, F.coalesce(F.try_divide(c[2], 13 * c[0]), F.lit(0.0)) + v0
    return y * 9 * u / (4 * v), y, y * (12 - 3 * u - 20 * v) / (4 * v)


def to_saturation(c: Color) -> Color:
    """(L, u, v) to (L, chroma / L, hue)."""
    _, chroma, hue = to_polar(c)
    return c[0], F.coalesce(F.try_divide(chroma, c[0]), F.lit(0.0)), hue


def from_saturation(c: Color) -> Color:
    return from_polar((c[0], c[1] * c[0], c[2]))


#: Fixed value: the share of full lightness that scales the contrast of the HCL space.
HCL_REFERENCE = 100


def linear_to_hcl(c: Color, gamma: float = 10.0) -> Color:
    """Hue (radians), chroma, lightness after Sarifuddin and Missaoui. Gray, which has no hue, gets 0."""
    top, low = F.greatest(*c), F.least(*c)
    q = F.exp(gamma / HCL_REFERENCE * F.coalesce(F.try_divide(low, top), F.lit(0.0)))
    red_green, green_blue = c[0] - c[1], c[1] - c[2]
    ratio = F.atan(F.try_divide(green_blue, red_green))
    angle = F.when(red_green == 0, F.signum(green_blue) * (math.pi / 2)).otherwise(ratio)
    hue = (
        F.when((red_green >= 0) & (green_blue >= 0), angle * (2 / 3))
        .when(red_green >= 0, angle * (4 / 3))
        .when(green_blue >= 0, angle * (4 / 3) + math.pi)
        .otherwise(angle * (2 / 3) - math.pi)
    )
    chroma = q / 3 * (F.abs(red_green) + F.abs(green_blue) + F.abs(c[2] - c[0]))
    known = c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull()
    return tuple(F.when(known, x) for x in (hue, chroma, (q * top + (q - 1) * low) / 2))


def hcl_to_linear(c: Color, gamma: float = 10.0) -> Color:
    """The colour that linear_to_hcl() comes from: its largest and smallest parts from chroma and lightness, the middle one from the hue."""
    hue, chroma, light = c
    q = F.exp(gamma / HCL_REFERENCE * (1 - F.coalesce(F.try_divide(3 * chroma, 4 * light), F.lit(1.0))))
    low = (4 * light - 3 * chroma) / (4 * q - 2)
    top = low + 3 * chroma / (2 * q)
    h = F.pmod(hue + math.pi, F.lit(2 * math.pi)) - math.pi
    third = math.pi / 3
    # Tangents of what the forward way stretched: (G - B) / (R - G), by the sector's stretch.
    near, wide = F.tan(1.5 * h), F.tan(0.75 * h)
    back, far = F.tan(0.75 * (h - math.pi)), F.tan(1.5 * (h + math.pi))
    pick = lambda *six: F.when(h < -2 * third, six[0]).when(h < -third, six[1]).when(h < 0, six[2]).when(h <= third, six[3]).when(h <= 2 * third, six[4]).otherwise(six[5])
    red = pick(low, (low * (1 + wide) - top) / wide, top, top, (top * (1 + back) - low) / back, low)
    green = pick((low * far + top) / (1 + far), low, low, (top * near + low) / (1 + near), top, top)
    blue = pick(top, top, low * (1 + wide) - top * wide, low, low, top * (1 + back) - low * back)
    return red, green, blue


IN = {
    "ciexyz": lambda c, w: c,
    "linearrgb": lambda c, w: linear_to_xyz(c),
    "srgb": lambda c, w: linear_to_xyz(srgb_to_linear(c)),
    "cielab": lab_to_xyz,
    "cielch": lambda c, w: lab_to_xyz(from_polar(c), w),
    "lshab": lambda c, w: lab_to_xyz(from_saturation(c), w),
    "cieluv": luv_to_xyz,
    "cielchuv": lambda c, w: luv_to_xyz(from_polar(c), w),
    "lshuv": lambda c, w: luv_to_xyz(from_saturation(c), w),
    "lms": lambda c, w: lms_to_xyz(c),
    "hcl": lambda c, w: linear_to_xyz(hcl_to_linear(c)),
}
OUT = {
    "ciexyz": lambda c, w, k: clip_color(c, k),
    "linearrgb": lambda c, w, k: xyz_to_linear(c, k),
    "srgb": lambda c, w, k: linear_to_srgb(xyz_to_linear(c, k)),
    "cielab": lambda c, w, k: xyz_to_lab(c, w),
    "cielch": lambda c, w, k: to_polar(xyz_to_lab(c, w)),
    "lshab": lambda c, w, k: to_saturation(xyz_to_lab(c, w)),
    "cieluv": lambda c, w, k: xyz_to_luv(c, w),
    "cielchuv": lambda c, w, k: to_polar(xyz_to_luv(c, w)),
    "lshuv": lambda c, w, k: to_saturation(xyz_to_luv(c, w)),
    "lms": lambda c, w, k: xyz_to_lms(c),
    "hcl": lambda c, w, k: linear_to_hcl(xyz_to_linear(c, k)),
}


def convert(c: Color, source: str, target: str, white: str = "d65", clip: int = 0) -> Color:
    """Between any two spaces, through XYZ; one expression, no shuffle."""
    return c if source == target else OUT[target](IN[source](c, white), white, clip)


def gray(c: Color) -> Column:
    return (2 * c[0] + 3 * c[1] + c[2]) / 6


#: How much of each part of a colour (columns) goes to each part (rows) of the turned one: constant, by the cosine, by the sine.
TURN = (
    ((0.299, 0.701, 0.168), (0.587, -0.587, 0.330), (0.114, -0.114, -0.497)),
    ((0.299, -0.299, -0.328), (0.587, 0.413, 0.035), (0.114, -0.114, 0.292)),
    ((0.299, -0.300, 1.250), (0.587, -0.588, -1.050), (0.114, 0.886, -0.203)),
)


def rotate_hue(c: Color, degrees: float) -> Color:
    """RGB with its hue turned about gray, luma kept."""
    u, w = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return _apply(tuple(tuple(k + a * u + b * w for k, a, b in row) for row in TURN), c)


def blend(base: Color, above: Color, alpha: Column) -> Color:
    """above over base."""
    return tuple(a * alpha + b * (1 - alpha) for a, b in zip(above, base, strict=True))


def blend_alpha(base: tuple[Column, ...], above: tuple[Column, ...]) -> tuple[Column, ...]:
    """Colours with alpha last, above over base, with the alpha of both; a base without alpha is solid. Where both are clear all is 0."""
    n = len(above) - 1
    under = base[n] if len(base) > n else F.lit(1.0)
    over = above[n]
    alpha = over + (1 - over) * under
    parts = [F.when(alpha == 0, F.lit(0.0)).otherwise((over * above[k] + (1 - over) * under * base[k]) / (alpha + 1e-20)) for k in range(n)]
    return (*parts, alpha)


def apply_alpha(c: tuple[Column, ...]) -> tuple[Column, ...]:
    """Every part of a colour times its alpha, which is last and goes."""
    return tuple(x * c[-1] for x in c[:-1])


def lut_index(x: Column, low, high, size: int) -> Column:
    """Bin of a colour table of ``size`` entries between the limits; outside, the nearest; NaN gives null."""
    bin_ = F.floor((x - low) / (high - low) * size)
    return F.when(F.isnan(x) | x.isNull(), None).otherwise(F.greatest(F.lit(0), F.least(F.lit(size - 1), bin_)).cast("int"))


def apply_lut(df: DataFrame, x: str, lut: DataFrame, size: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """df and the r, g, b of the entry of ``lut`` (i, r, g, b; ``size`` entries) that x falls on. Limits not given are those of x; NaN and null get the first entry.

    The table has a fixed number of entries, so it is sent to the rows.
    """
    v = F.when(~F.isnan(x), F.col(x))
    if low is None or high is None:
        ends = df.agg(F.min(v).cast("double").alias("_low"), F.max(v).cast("double").alias("_high"))
        df = df.crossJoin(F.broadcast(ends))  # one row
    at = lut_index(F.col(x), F.col("_low") if low is None else F.lit(float(low)), F.col("_high") if high is None else F.lit(float(high)), size)
    out = df.withColumn("_i", F.coalesce(at, F.lit(0))).join(F.broadcast(lut.withColumnRenamed("i", "_i")), "_i", "left")
    return out.drop("_i", "_low", "_high")


def lab_distance(a: Color, b: Color) -> Column:
    """CIEDE2000 of two Lab colours, with unit weights."""
    chroma = lambda x, y: F.sqrt(x * x + y * y)
    share = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    stretch = 1 + (1 - share((chroma(a[1], a[2]) + chroma(b[1], b[2])) / 2)) / 2
    a1, a2 = a[1] * stretch, b[1] * stretch
    c1, c2 = chroma(a1, a[2]), chroma(a2, b[2])
    turn = F.lit(2 * math.pi)
    h1, h2 = F.pmod(F.atan2(a[2], a1), turn), F.pmod(F.atan2(b[2], a2), turn)
    gray, apart = (c1 == 0) | (c2 == 0), F.abs(h1 - h2) > math.pi
    dh = F.when(gray, F.lit(0.0)).when(~apart, h2 - h1).when(h2 <= h1, h2 - h1 + turn).otherwise(h2 - h1 - turn)
    h = F.when(gray, h1 + h2).when(apart, (h1 + h2 + turn) / 2).otherwise((h1 + h2) / 2)
    light, c = (a[0] + b[0]) / 2, (c1 + c2) / 2
    rad = math.radians
    t = 1 - 0.17 * F.cos(h - rad(30)) + 0.24 * F.cos(2 * h) + 0.32 * F.cos(3 * h + rad(6)) - 0.20 * F.cos(4 * h - rad(63))
    s_l = 1 + 0.015 * (light - 50) ** 2 / F.sqrt(20 + (light - 50) ** 2)
    x, y, z = (b[0] - a[0]) / s_l, (c2 - c1) / (1 + 0.045 * c), 2 * F.sqrt(c1 * c2) * F.sin(dh / 2) / (1 + 0.015 * c * t)
    twist = -2 * share(c) * F.sin(rad(60) * F.exp(-(((h - rad(275)) / rad(25)) ** 2)))
    return F.sqrt(x * x + y * y + z * z + twist * y * z)


def lch_distance(a: Color, b: Color, lightness: float = 1.0, chroma: float = 1.0) -> Column:
    """CMC l:c of two LCh colours (hue in radians); the first is the standard."""
    rad = math.radians
    s_l = F.when(a[0] < 16, F.lit(0.511)).otherwise(0.040975 * a[0] / (1 + 0.01765 * a[0]))
    s_c = 0.0638 * a[1] / (1 + 0.0131 * a[1]) + 0.638
    f = F.sqrt(F.pow(a[1], F.lit(4.0)) / (F.pow(a[1], F.lit(4.0)) + 1900))
    h = F.pmod(a[2], F.lit(2 * math.pi))
    t = F.when((h >= rad(164)) & (h <= rad(345)), 0.56 + F.abs(0.2 * F.cos(h + rad(168)))).otherwise(0.36 + F.abs(0.4 * F.cos(h + rad(35))))
    dc = a[1] - b[1]
    dh2 = (a[1] * F.cos(a[2]) - b[1] * F.cos(b[2])) ** 2 + (a[1] * F.sin(a[2]) - b[1] * F.sin(b[2])) ** 2 - dc * dc
    s_h = s_c * (f * t + 1 - f)
    return F.sqrt(((b[0] - a[0]) / (lightness * s_l)) ** 2 + (dc / (chroma * s_c)) ** 2 + F.greatest(dh2, F.lit(0.0)) / s_h**2)
