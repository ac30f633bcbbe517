"""Column expressions: predicates, dates and times as digit strings, geometry, filter design, photometry, array shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held within [low, high]; null and NaN stay."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def in_range(x: Column, low, high, strict: bool = False) -> Column:
    return (x > low) & (x < high) if strict else (x >= low) & (x <= high)


def in_rect(x: Column, y: Column, x0, y0, w, h) -> Column:
    """Half open: the left and top edges are inside."""
    return (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)


def equal(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return F.abs(a - b) < F.lit(eps) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def arrays_equal(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Element by element, with one threshold for all: eps times the largest magnitude of either array, or eps if that is under one."""
    most = lambda x: F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))
    limit = F.lit(eps) * F.greatest(F.lit(1.0), most(a), most(b))
    return F.zip_with(a, b, lambda x, y: F.abs(x - y) < limit)


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


def _day(s: Column) -> Column:
    """The day of six digits, of 20yy; null for other text and for days that no calendar has."""
    return F.when(s.rlike("^[0-9]{6}$"), F.try_to_timestamp(F.concat(F.lit("20"), s), F.lit("yyyyMMdd")).cast("date"))


def date_add(yymmdd: Column, days: Column) -> Column:
    """Years are 20yy; null for what is no day."""
    return F.date_format(F.date_add(_day(yymmdd), days.cast("int")), "yyMMdd")


def date_sub(a: Column, b: Column) -> Column:
    """Days from b to a; null where either is no day."""
    return F.datediff(_day(a), _day(b))


def _seconds(t: Column) -> Column:
    part = lambda k: F.substring(t, k, 2).cast("int")
    return part(1) * 3600 + part(3) * 60 + F.when(F.length(t) >= 6, part(5)).otherwise(F.lit(0))


def time_add(hhmmss: Column, seconds: Column) -> Column:
    """HHMM or HHMMSS plus seconds, around the clock."""
    s = F.pmod(_seconds(hhmmss) + seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(two(s / 3600), two(F.pmod(s, F.lit(3600)) / 60), two(F.pmod(s, F.lit(60))))


def time_sub(a: Column, b: Column) -> Column:
    """Seconds from b to the next a."""
    return F.pmod(_seconds(a) - _seconds(b), F.lit(86400))


def cross(v: tuple[Column, ...], w: tuple[Column, ...]) -> tuple[Column, ...]:
    return (v[1] * w[2] - v[2] * w[1], v[2] * w[0] - v[0] * w[2], v[0] * w[1] - v[1] * w[0])


def circle_from_3(x1, y1, x2, y2, x3, y3) -> tuple[Column, Column, Column]:
    """Centre and radius of the circle through three points; null if they lie on a line."""
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    s1, s2, s3 = (x * x + y * y for x, y in ((x1, y1), (x2, y2), (x3, y3)))
    cx = F.try_divide(s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2), d)
    cy = F.try_divide(s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1), d)
    return cx, cy, F.sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2)


def butterworth(f: float, order: int, high: bool) -> tuple[list[float], list[float]]:
    """(b, a) of a digital filter of order 1 or 2 by the bilinear transform; f in units of the sample rate."""
    c = 1 / math.tan(math.pi * f)
    if order == 1:
        norm = 1 + c
        b = [c / norm, -c / norm] if high else [1 / norm, 1 / norm]
        return b, [1.0, (1 - c) / norm]
    norm = 1 + math.sqrt(2) * c + c * c
    b = [c * c / norm, -2 * c * c / norm, c * c / norm] if high else [1 / norm, 2 / norm, 1 / norm]
    return b, [1.0, 2 * (1 - c * c) / norm, (1 - math.sqrt(2) * c + c * c) / norm]


#: Fixed value: square degrees of full beam angle by which candela become lumens.
DEGREES2_PER_STERADIAN = 4182


def candela_to_lumen(cd: Column, full_angle_deg: Column) -> Column:
    return cd * full_angle_deg**2 / DEGREES2_PER_STERADIAN


def lumen_to_candela(lm: Column, full_angle_deg: Column) -> Column:
    return lm * DEGREES2_PER_STERADIAN / full_angle_deg**2


def logit_coherence(y: Column) -> Column:
    """Logit of the squared magnitude, kept off 0 and 1; null and NaN stay."""
    z = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), y * y))
    return F.when(y.isNull() | F.isnan(y), y).otherwise(-F.log(1 / z - 1))


def coherence_from_logit(x: Column) -> Column:
    return F.sqrt(1 / (1 + F.exp(-x)))


def initial_caps(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def coerce(v: Column) -> Column:
    """A struct of what a setting's text is: a whole number, a number, or text without its quotes."""
    i, f = v.try_cast("long"), v.try_cast("double")
    return F.struct(i.alias("i"), F.when(i.isNull(), f).alias("f"), F.when(f.isNull(), F.regexp_replace(v, r'^"(.*)"$', "$1")).alias("s"))


def inverse_permutation(x: Column) -> Column:
    """y with y[x[i]] = i, for an array of 0 .. n - 1: its places in order of its values."""
    at = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.cast("long").alias("i")))
    return F.transform(F.array_sort(at), lambda p: p["i"])


def lin(x: Column) -> Column:
    """x itself, where a function of x is asked for."""
    return x


def is_scalar(kind: T.DataType, x: Column) -> Column:
    """Whether x is one number: of a numeric type, or an array (of arrays) with one number in all."""
    if isinstance(kind, T.NumericType):
        return F.lit(True)
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    return F.coalesce((F.size(x) == 1) & is_scalar(kind.elementType, F.get(x, F.lit(0))), F.lit(False))


def as_scalar(kind: T.DataType, x: Column) -> Column:
    """The number of what is_scalar() is true for; null for others."""
    value = x
    while isinstance(kind, T.ArrayType):
        value, kind = F.get(value, F.lit(0)), kind.elementType
    return value


def is_vector(kind: T.DataType, x: Column) -> Column:
    """Whether x is a number, or a numeric array in which no more than one dimension has more than one entry. Empty arrays are."""
    if isinstance(kind, T.NumericType):
        return F.lit(True)
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    if isinstance(kind.elementType, T.NumericType):
        return F.lit(True)
    flat = F.size(x) == F.aggregate(x, F.lit(0), lambda n, v: n + F.when(is_scalar(kind.elementType, v), 1).otherwise(0))
    return (F.size(x) == 0) | flat | ((F.size(x) == 1) & is_vector(kind.elementType, F.get(x, F.lit(0))))


def tile_to(x: Column, rows: int, columns: int | None = None) -> Column:
    """An array repeated to ``rows`` entries, or an array of arrays to rows by columns; null where the sizes do not divide."""
    if columns is not None:
        inner = F.transform(x, lambda r: tile_to(r, columns))
        whole = F.forall(inner, lambda r: r.isNotNull())
        return F.when(whole, tile_to(inner, rows))
    fits = (F.size(x) > 0) & (F.pmod(F.lit(rows), F.when(F.size(x) > 0, F.size(x))) == 0)
    return F.when(fits, F.flatten(F.array_repeat(x, F.floor(F.lit(rows) / F.size(x)).cast("int"))))


def protected_split(text: Column, separators: str = " ", escape: str = "\\") -> Column:
    """Fields of a text split at separator characters outside quotes and brackets; an escape keeps the next character.

    The last field counts. Two adjoining separators hold an empty field; empty text is one.
    """
    pairs = {"'": "'", '"': '"', "(": ")", "[": "]", "{": "}"}
    closing = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit("").alias("end"), F.lit(False).alias("esc"))

    def step(s, c):
        is_sep = (s["end"] == "") & ~s["esc"] & (F.position(c, F.lit(separators)) > 0)
        is_esc = ~s["esc"] & (c == escape)
        opens = (s["end"] == "") & ~s["esc"] & closing[c].isNotNull()
        closes = (s["end"] != "") & ~s["esc"] & (c == s["end"])
        return F.struct(
            F.when(is_sep, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"),
            F.when(is_sep, F.lit("")).when(is_esc | opens | closes, s["cur"]).otherwise(F.concat(s["cur"], c)).alias("cur"),
            F.when(opens, closing[c]).when(closes, F.lit("")).otherwise(s["end"]).alias("end"),
            is_esc.alias("esc"),
        )

    done = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), zero, step)
    return F.concat(done["out"], F.array(done["cur"]))
