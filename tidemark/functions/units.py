"""Unit expressions: parsed once into a factor and exponents, applied to a column as one multiplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("mol", "A", "g", "m", "s")
#: Prefixes as powers of ten, and unit definitions.
PREFIXES = {
    "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15,
    "kilo": 3, "mega": 6, "Mega": 6, "giga": 9, "Giga": 9, "tera": 12, "Tera": 12,
    "d": -1, "c": -2, "m": -3, "u": -6, "μ": -6, "n": -9, "p": -12, "f": -15, "k": 3, "M": 6, "G": 9, "T": 12,
}
DEFINITIONS = {
    "meter meters": "m", "second seconds sec secs": "s", "gram grams gm": "g", "lb lbs pound": "453.59237 g",
    "amp amps ampere amperes Amp Ampere Amperes": "A", "min minute": "60 s", "h hour": "60 min", "day": "24 hour",
    "in inch": "2.54 cm", "l L liter liters": "1e-3 m^3", "Hz Hertz hertz cyc cycles": "s^-1", "C Coulomb coulomb Coulombs coulombs": "A s",
    "N newton Newton newtons Newtons": "kg m s^-2", "lbf": "4.4482216 kg m / s^2", "J joule Joule joules Joules": "N m",
    "W watt Watt watts Watts": "J s^-1", "V Volt volt Volts volts": "W A^-1", "Pa pascal Pascal": "N m^-2", "bar": "1e5 Pa",
    "atm": "101325 Pa", "torr": "133.32239 Pa", "psi": "6894.7573 kg / m s^2", "Ohm Ohms ohm ohms": "V A^-1", "mho Mho": "Ohm^-1",
    "barn": "1e-28 m^2", "M molar": "mol l^-1",
}
NAMES = {name: text for names, text in DEFINITIONS.items() for name in names.split()}


@dataclass(frozen=True)
class Unit:
    """factor times the product of the base units to their exponents."""

    factor: float
    exponents: tuple[float, ...]

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.exponents, other.exponents, strict=True)))

    def __pow__(self, n: float) -> Unit:
        return Unit(self.factor**n, tuple(a * n for a in self.exponents))


ONE = Unit(1.0, (0.0,) * len(BASE))


def parse(text: str) -> Unit:
    """Factors with blanks between them; what follows a stroke divides."""
    above, _, below = text.partition("/")
    out = ONE
    for word in above.split():
        out = out * _factor(word)
    return out * parse(below) ** -1 if below.strip() else out


def _factor(word: str) -> Unit:
    try:
        return Unit(float(word), ONE.exponents)
    except ValueError:
        pass
    name, _, power = word.partition("^")
    top, _, bottom = power.partition("|")
    return _named(name) ** (float(top or 1) / float(bottom or 1))


def _named(name: str) -> Unit:
    if name in BASE:
        return Unit(1.0, tuple(float(b == name) for b in BASE))
    if name in NAMES:
        return parse(NAMES[name])
    for prefix, power in PREFIXES.items():
        rest = name[len(prefix) :]
        if name.startswith(prefix) and (rest in BASE or rest in NAMES):
            return Unit(10.0**power, ONE.exponents) * _named(rest)
    raise ValueError(f"unknown unit: {name}")


def definition(text: str) -> str:
    """In kilograms, metres, seconds, amperes and moles."""
    u = parse(text)
    grams = u.exponents[BASE.index("g")]
    words = [f"{n}^{e:g}" if e != 1 else n for n, e in zip(("mol", "A", "kg", "m", "s"), u.exponents, strict=True) if e]
    return " ".join([f"{u.factor / 1000.0**grams:.8g}", *words])


def factor(source: str, target: str) -> float:
    a, b = parse(source), parse(target)
    if any(abs(x - y) > 1e-12 for x, y in zip(a.exponents, b.exponents, strict=True)):
        raise ValueError(f"{source} is no {target}")
    return a.factor / b.factor


def convert(x: Column, source: str, target: str) -> Column:
    return x * F.lit(factor(source, target))
