"""Colour tables as small relations (i, r, g, b), each entry a function of its number."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The colours of the resistor code, and those that may be added.
RESISTOR = [(0, 0, 0), (0.7, 0.1, 0.1), (1, 0.1, 0), (0.9, 0.6, 0), (0.8, 0.8, 0), (0, 0.8, 0), (0, 0, 1), (0.7, 0, 1), (0.5, 0.5, 0.5)]
LETTERS = {"r": (1, 0, 0), "g": (0, 1, 0), "b": (0, 0, 1), "c": (0, 1, 1), "m": (1, 0, 1), "y": (1, 1, 0), "k": (0, 0, 0), "w": (1, 1, 1)}


def _table(spark: SparkSession, n: int, r: Column, g: Column, b: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def _rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rows)], "i int, r double, g double, b double")


#: Centres and widths of the bumps of blue, green and red.
JET = {"r": (0.8, 0.2), "g": (0.5, 0.25), "b": (0.2, 0.2)}


def jet(spark: SparkSession, n: int = 256) -> DataFrame:
    """Bumps of the fourth power for blue, green and red."""
    phi = F.col("id") / F.lit(float(max(n - 1, 1)))
    bump = lambda at, width: F.exp(-0.5 * F.pow((phi - at) / width, F.lit(4.0)))
    return _table(spark, n, bump(*JET["r"]), bump(*JET["g"]), bump(*JET["b"]))


def dark_jet(spark: SparkSession, n: int, d: float = 0.6) -> DataFrame:
    """jet, darkened by its gray and spread about its mean."""
    t = jet(spark, n)
    gray = (2 * F.col("r") + 3 * F.col("g") + F.col("b")) / 6
    k = F.tanh(F.lit(d) / gray)
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), k * (2 * F.col(c) - mean)))
    return t.select("i", held("r").alias("r"), held("g").alias("g"), held("b").alias("b"))


def gray_red(spark: SparkSession, n: int = 100, f: float = 0.25) -> DataFrame:
    """White to black, then yellow through red: the last share f of the entries."""
    n1 = int(f * n)
    gray = 1 - F.col("id") / float(max(n - n1 - 1, 1))
    warm = 1 - (F.col("id") - (n - n1)) / float(max(n1 - 1, 1))
    low = F.col("id") < n - n1
    back = F.col("id") >= n - n1
    return _table(spark, n, F.when(back, 1.0).otherwise(gray), F.when(low, gray).otherwise(warm), F.when(low, gray).otherwise(0.0))


def _ramp(first: int, count: int, down: bool = False) -> Column:
    """0 to 1 over ``count`` entries from ``first`` on."""
    at = (F.col("id") - first) / float(max(count - 1, 1))
    return 1 - at if down else at


def blue_gray_red(spark: SparkSession, n: int = 100, f: float = 0.25) -> DataFrame:
    """Cyan to blue, white to black, yellow to red; a share f for each of the ends."""
    ends = math.ceil(f * n)
    middle = n - 2 * ends
    cold, warm = F.col("id") < ends, F.col("id") >= ends + middle
    gray = _ramp(ends, middle, True)
    part = lambda blue, red: F.when(cold, blue).when(warm, red).otherwise(gray)
    return _table(spark, n, part(F.lit(0.0), F.lit(1.0)), part(_ramp(0, ends, True), _ramp(ends + middle, ends, True)), part(F.lit(1.0), F.lit(0.0)))


def blue_red(spark: SparkSession, n: int = 100, darken: float = 0.0, red_turn: float = 0.0, blue_turn: float = 0.0, turn: float = 0.0) -> DataFrame:
    """Blue over white to red, n entries each way; a share ``darken`` of dark ends before and after; the halves' hues may be turned by degrees."""
    from .color import rotate_hue

    up, down = _ramp(0, n), _ramp(n, n, True)
    extra = n - max(0, int(n * (1 - darken))) if darken > 0 else 0
    first = n - extra
    dark, at = F.col("id") < extra, F.col("id") - extra
    up, down = (at / float(max(n - 1, 1))), 1 - (at - n) / float(max(n - 1, 1))
    edge = lambda k: (first + k) / float(max(n - 1, 1))
    last, blue = F.col("id") >= extra + 2 * n, at < n
    end = edge(extra - 1 - (at - 2 * n))
    zero = F.lit(0.0)
    r = F.when(dark, zero).when(last, end).when(blue, up).otherwise(F.lit(1.0))
    g = F.when(dark | last, zero).when(blue, up).otherwise(down)
    b = F.when(dark, edge(F.col("id"))).when(last, zero).when(blue, F.lit(1.0)).otherwise(down)
    table = _table(spark, 2 * (n + extra), r, g, b)
    if not (red_turn + turn or blue_turn + turn):
        return table
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    cold, warm = rotate_hue(rgb, blue_turn + turn), rotate_hue(rgb, red_turn + turn)
    return table.select("i", *[F.when(F.col("i") < n + extra, x).otherwise(y).alias(c) for x, y, c in zip(cold, warm, "rgb", strict=True)])


def dark_hsv(spark: SparkSession, n: int, d: float = 0.3) -> DataFrame:
    """A cycle of hues with the same gray d, its parts drawn from their mean."""
    phi = F.col("id") * (2 * math.pi / n)
    t = _table(spark, n, *[F.cos(phi + k * 2 * math.pi / 3) / 2 + 0.5 for k in range(3)])
    gray = (2 * F.col("r") + 3 * F.col("g") + F.col("b")) / 6
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * d / gray * F.sqrt(F.col(c) / mean)))
    return t.select("i", *[held(c).alias(c) for c in "rgb"])


def srgb_of_lshuv(light: np.ndarray, saturation: np.ndarray, hue: np.ndarray) -> np.ndarray:
    """sRGB within [0, 1] of arrays of lightness, saturation and hue (color.convert() for whole tables)."""
    from . import color as K

    u0, v0 = K._uv("d65")
    chroma = saturation * light
    safe = np.where(light == 0, 1, 13 * light)
    u, v = chroma * np.cos(hue) / safe + u0, chroma * np.sin(hue) / safe + v0
    y = np.where(light > 8, ((light + 16) / 116) ** 3, light * (3 / 29) ** 3) * K.WHITE["d65"][1]
    xyz = np.stack([y * 9 * u / (4 * v), y, y * (12 - 3 * u - 20 * v) / (4 * v)], -1)
    linear = np.clip(xyz @ np.linalg.inv(np.array(K.RGB_XYZ)).T, 0, 1)
    return np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)


def von_mises(x, k):
    """A bump of height 1 at 0 around the circle, the narrower the larger k."""
    return np.exp(k * (np.cos(x) - 1))


def expo(x, centre_deg: float, width_deg: float):
    return von_mises(x - np.radians(centre_deg), 1 / np.radians(width_deg))


def shifted(x: np.ndarray, centre_deg: float, a: float, width_deg: float) -> np.ndarray:
    """A bump scaled so that its steepest rise along x is a."""
    y = expo(x, centre_deg, width_deg)
    return y * a / np.abs(np.max(np.diff(y) / np.diff(x)))


def gauss(x, centre: float, a: float, width: float):
    return a * np.exp(-0.5 * (x - centre) ** 2 / width**2)


def adjust_hue(hue: np.ndarray, centre: float, width: float, share: float) -> np.ndarray:
    """Hues in degrees, evenly spaced, crowded or spread around a centre that stays; from running sums of their steps."""
    bump = sum(np.exp(-(((hue + turn - centre) / width) ** 2)) for turn in (-360, 0, 360))
    at = np.cumsum(1 - share * bump)
    at *= 360 / at[-1]
    return np.mod(at - at[np.argmax(at >= centre)] + centre, 360)


def lerp(x: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of a table, linear between its places x."""
    return np.stack([np.interp(at, x, table[:, c]) for c in range(table.shape[1])], 1)


#: Centre, width and share of the four warps of the even cycle; the third counts hues from 180 on.
WARPS = ((320, 30, -0.8), (240, 60, 0.45), (245, 25, 0.35), (180, 30, 0.65))


def even_hsv(spark: SparkSession, n: int = 64) -> DataFrame:
    """A cycle of hues that look evenly spaced: six ramps, warped four times, at n places. A table of fixed size, made on the driver."""
    t = (np.arange(n) + 0.5) / n
    up = (1 - np.cos(np.pi * t)) / 4 + t / 2
    on, off, down = np.ones(n), np.zeros(n), up[::-1]
    ramps = [(on, up, off), (down, on, off), (off, on, up), (off, down, on), (up, off, on), (on, off, down)]
    table = np.concatenate([np.stack(c, 1) for c in ramps])
    place = np.arange(6 * n) * 360 / (6 * n)
    hue = place
    for k, (centre, width, share) in enumerate(WARPS):
        hue = adjust_hue(np.mod(hue - 180, 360) if k == 3 else hue, centre, width, share)
        table = lerp(place, table, hue)
    linear = np.clip(lerp(place, table, (np.arange(n) + 0.5) * 360 / n), 0, 1)
    return _rows(spark, np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055).tolist())


def _bump(hue: np.ndarray, centre: float, width: float) -> np.ndarray:
    return von_mises(hue - centre, 1 / width)


def gray_centre(hue: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """sRGB of complex values (angle, radius up to 1), gray at 0. The numbers are fixed values."""
    light = 65 + 10 * radius * _bump(hue, 1.3, 0.25) - 10 * radius * _bump(hue, 4.5, 0.25)
    power = 1 - 0.3 * _bump(hue, 4.4, 0.7) - 0.4 * _bump(hue, 1.3, 0.7) + 0.2 * _bump(hue, 5.5, 0.5) + 0.2 * _bump(hue, 0.2, 0.7)
    sat = radius**power * 1.5 * (1 - 0.3 * _bump(hue, 3.3, 0.7) - 0.2 * _bump(hue, 5.5, 0.5))
    for share, centre, width in ((0.6, 3.7, 0.7), (-0.6, 5.3, 0.9), (0.6, 0.5, 0.8)):
        hue = hue + share * _bump(hue, centre, width)
    sat = (sat * (1 + 0.9 * _bump(hue, 4.45, 0.35))) ** (1 - 0.2 * _bump(hue, 4.45, 0.35))
    for share, centre, width in ((-0.2, 5.3, 0.4), (0.3, 3.5, 0.7)):
        hue = hue + share * _bump(hue, centre, width)
    sat = sat ** (1 - 0.35 * _bump(hue, 3.3, 0.7))
    sat = (sat * (1 - 0.15 * _bump(hue, 5.4, 0.5))) ** (1 - 0.1 * _bump(hue, 5.4, 0.5))
    return srgb_of_lshuv(light, sat, hue)


def white_centre(angle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """sRGB of complex values before they are lifted so that 0 is 0.99. The numbers are fixed values."""
    light = 99 - 40 * radius**1.5 + 20 * radius**1.5 * np.cos(angle - np.radians(80))
    hue = angle + (1 - radius) * 0.6 * (expo(angle, 120, 30) - expo(angle, 250, 30))
    return srgb_of_lshuv(light, (radius**1.9 * 1.6) ** (1 - 0.15 * expo(angle, 80, 30)), hue)


def complex_colors(df: DataFrame, re: str, im: str) -> DataFrame:
    """df and r, g, b of each complex value, lifted so that the smallest magnitude of all is 0.99 bright (the first in order of re and im if equal)."""
    names = [f"_{c}" for c in "rgb"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames):
        for pdf in frames:
            z = pdf[re].to_numpy(float) + 1j * pdf[im].to_numpy(float)
            yield pdf.assign(**dict(zip(names, white_centre(np.angle(z), np.abs(z)).T, strict=True)))

    raw = df.mapInPandas(run, kind + ", " + ", ".join(f"{n} double" for n in names))
    size = F.struct(F.hypot(re, im), F.col(re), F.col(im))
    least = raw.agg(*[F.min_by(n, size).alias(n + "0") for n in names])
    both = raw.crossJoin(F.broadcast(least))  # one row
    lifted = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n) + 0.99 - F.col(n + "0")))
    return both.select(*df.columns, *[lifted(n).alias(n[1:]) for n in names])


def cycle_table(spark: SparkSession, style: int = 2, hues: int = 360, radii: int = 100, origin: int = 1) -> DataFrame:
    """h, c, r, g, b: colours of angles and radii below 1; style 1 is gray at 0, 2 white. Origin 1 runs backwards from a fixed share of the circle, 2 forwards."""
    if style not in (1, 2):
        raise ValueError(f"no style {style}")

    def run(frames):
        for pdf in frames:
            h, c = (pdf.id // radii).to_numpy(), (pdf.id % radii).to_numpy()
            if style == 1:
                rgb = gray_centre(np.radians(h), c / radii)
            else:
                z = c / radii * np.exp(2j * np.pi * h / hues)
                lift = 0.99 - white_centre(np.zeros(1), np.zeros(1))
                rgb = np.clip(white_centre(np.angle(z), np.abs(z)) + lift, 0, 1)
            place = h
            if origin == 1:
                place = (hues - 1 - h - int(hues * 0.15)) % hues
            elif origin == 2:
                place = (h - int(hues * 0.2)) % hues
            yield pd.DataFrame({"h": place.astype("int32"), "c": c.astype("int32"), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return spark.range(hues * radii).mapInPandas(run, "h int, c int, r double, g double, b double")


def look_up(df: DataFrame, re: str, im: str, table: DataFrame, hues: int = 360, radii: int = 100, gamma: float = 1.0) -> DataFrame:
    """df and r, g, b of complex values from a cycle_table(), which has a fixed size and is sent to the rows."""
    size = F.hypot(re, im)
    held = F.pow(size, F.lit(float(gamma)))
    h = F.pmod((F.atan2(im, re) * (hues / (2 * math.pi))).cast("int"), F.lit(hues))
    c = F.least((held * radii).cast("int"), F.lit(radii - 1))
    return df.withColumn("h", h).withColumn("c", c).join(F.broadcast(table), ["h", "c"], "left").drop("h", "c")


def resistor(spark: SparkSession, white: bool = False, extra: int = 0) -> DataFrame:
    rows = list(RESISTOR)
    if extra:
        rows = [*rows[:6], (0, 1, 1), *rows[6:8], (1, 0.3, 1), *rows[8:]]
    if extra > 1:
        rows += [(0.45, 0.45, 1), (0, 0.6, 0)]
    return _rows(spark, rows + [(1, 1, 1)] * white)


def letter(s: str) -> tuple[float, float, float]:
    return tuple(map(float, LETTERS[s]))


def daylight(kelvin: Column) -> tuple[Column, Column, Column]:
    """XYZ of daylight of a colour temperature, Y = 1; the published cubic changes at 7000 K."""
    cubic = lambda a, b, c, d: a + b / kelvin + c / kelvin**2 + d / kelvin**3
    x = F.when(kelvin > 7000, cubic(0.237040, 0.24748e3, 1.9018e6, -2.0064e9)).otherwise(cubic(0.244063, 0.09911e3, 2.9678e6, -4.6070e9))
    y = -3.0 * x * x + 2.870 * x - 0.275
    return x / y, F.lit(1.0), (1 - x - y) / y


def distinct(n: int, background: tuple[float, float, float] = (1, 1, 1), steps: int = 30) -> list[tuple[float, float, float]]:
    """n colours, each the farthest in Lab from those before and the background; a fixed grid, so plain arithmetic."""
    import numpy as np

    from . import color

    g = np.linspace(0, 1, steps)
    rgb = np.stack(np.meshgrid(g, g, g, indexing="ij"), -1).reshape(-1, 3)

    def lab(c):
        lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
        t = lin @ np.array(color.RGB_XYZ).T / np.array(color.WHITE["d65"])
        f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * ((29 / 6) ** 2 / 3) + 4 / 29)
        return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)

    points, out = lab(rgb), []
    near = ((points - lab(np.array([background], float))) ** 2).sum(1)
    for _ in range(n):
        k = int(near.argmax())
        out.append(tuple(rgb[k].tolist()))
        near = np.minimum(near, ((points - points[k]) ** 2).sum(1))
    return out
