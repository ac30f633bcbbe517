"""Words and passages of machining programs. Lengths are given in mm and written in inches, feeds in mm/s and written in inches a minute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mm of an inch, and the words of each passage.
MM_PER_INCH = 25.4
FORMATS = {"X": "X%.4f", "Y": "Y%.4f", "Z": "Z%.4f", "A": "A%.3f", "C": "C%.3f", "F": "F%.3f"}
RETRACT, STOP, END, UNLOCK, LOCK = "G53 G0 Z0.", "M5\nM1", "M30", "M11", "M10 "


def mm_to_machine(x: Column) -> Column:
    return x / MM_PER_INCH


def mm_s_to_machine(v: Column) -> Column:
    return 60 * v / MM_PER_INCH


def deg_to_machine(theta: Column) -> Column:
    return theta


def rpm_to_machine(rpm: Column) -> Column:
    return rpm


def word(letter: str, value: Column) -> Column:
    """X, Y and Z of mm, A and C of degrees, F of mm/s."""
    to = mm_to_machine if letter in "XYZ" else mm_s_to_machine if letter == "F" else deg_to_machine
    return F.format_string(FORMATS[letter], to(value.cast("double")))


def _lines(*parts) -> Column:
    """Lines after a first line break, each ended."""
    return F.concat(F.lit("\n"), *[F.concat(p if isinstance(p, Column) else F.lit(p), F.lit("\n")) for p in parts])


def preamble(tool: Column, system: str = "G54") -> Column:
    """Modes, tool change and the work coordinate system."""
    t = tool.cast("string")
    return _lines("G90 G94 G17", "G20", RETRACT, F.concat(F.lit("T"), t, F.lit(" M6")), "M1", system, F.concat(F.lit("G43 H"), t))


def end() -> Column:
    return _lines(END)


def retract_and_rotate(a: Column, c: Column, system: str = "G54") -> Column:
    turn = F.format_string("G0 A%.2f C%.2f", deg_to_machine(a.cast("double")), deg_to_machine(c.cast("double")))
    return _lines(RETRACT, system, UNLOCK, turn, LOCK)


def start(rpm: Column) -> Column:
    return F.concat(F.lit("S"), rpm_to_machine(rpm).cast("string"), F.lit(" M3\n"))


def stop() -> Column:
    return F.lit(STOP + "\n")


def retract_and_stop() -> Column:
    return _lines(RETRACT, STOP)


def probe_z(dz: Column, system: str = "G54") -> Column:
    """Probe down by dz mm."""
    depth = F.format_string("%.3f", mm_to_machine(-F.abs(dz.cast("double"))))
    return F.concat(F.lit(f"G65 P9995 W{system[1:]}. A20. H"), depth, F.lit("\n    "))


def probe_z_at(x: Column, y: Column, z: Column, safe: float = 100.0, dz: float = 25.0, system: str = "G54") -> Column:
    """Probe tool, safe move over (x, y), guarded move to half of dz over z, then the probe."""
    down = abs(dz)
    go = F.concat(F.lit("G0 "), word("X", x), F.lit(" "), word("Y", y), F.lit("    "))
    over = F.concat(F.lit("G0 "), word("Z", z + safe))
    guarded = F.concat(F.lit("G65 P9810 "), word("Z", z + down / 2), F.lit(" "), word("F", F.lit(20.0)))
    return F.concat(preamble(F.lit(10), system), _lines("G103 P1", "", "    ", go, over, "G65 P9832", guarded, "G103", "", "    "), probe_z(F.lit(down), system))


def renumber(program: Column) -> Column:
    """Lines with N10, N20, ... before them."""
    lines = F.split(program, "\n")
    return F.array_join(F.transform(lines, lambda s, k: F.concat(F.lit("N"), ((k + 1) * 10).cast("string"), F.lit(" "), s)), "\n")
