"""Light as the eye weighs it and in watts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The luminous efficiency of 1924 at 360, 365, ... 830 nm, and lumens of a watt at its peak.
FIRST_NM, STEP_NM = 360, 5
EFFICIENCY = (
    0.000003917000, 0.000006965000, 0.000012390000, 0.000022020000, 0.000039000000,
    0.000064000000, 0.000120000000, 0.000217000000, 0.000396000000, 0.000640000000,
    0.001210000000, 0.002180000000, 0.004000000000, 0.007300000000, 0.011600000000,
    0.016840000000, 0.023000000000, 0.029800000000, 0.038000000000, 0.048000000000,
    0.060000000000, 0.073900000000, 0.090980000000, 0.112600000000, 0.139020000000,
    0.169300000000, 0.208020000000, 0.258600000000, 0.323000000000, 0.407300000000,
    0.503000000000, 0.608200000000, 0.710000000000, 0.793200000000, 0.862000000000,
    0.914850100000, 0.954000000000, 0.980300000000, 0.994950100000, 1.000000000000,
    0.995000000000, 0.978600000000, 0.952000000000, 0.915400000000, 0.870000000000,
    0.816300000000, 0.757000000000, 0.694900000000, 0.631000000000, 0.566800000000,
    0.503000000000, 0.441200000000, 0.381000000000, 0.321000000000, 0.265000000000,
    0.217000000000, 0.175000000000, 0.138200000000, 0.107000000000, 0.081600000000,
    0.061000000000, 0.044580000000, 0.032000000000, 0.023200000000, 0.017000000000,
    0.011920000000, 0.008210000000, 0.005723000000, 0.004102000000, 0.002929000000,
    0.002091000000, 0.001484000000, 0.001047000000, 0.000740000000, 0.000520000000,
    0.000361100000, 0.000249200000, 0.000171900000, 0.000120000000, 0.000084800000,
    0.000060000000, 0.000042400000, 0.000030000000, 0.000021200000, 0.000014990000,
    0.000010600000, 0.000007465700, 0.000005257800, 0.000003702900, 0.000002607800,
    0.000001836600, 0.000001293400, 0.000000910930, 0.000000641530, 0.000000451810,
)
LUMEN_PER_WATT = 683
#: Width in degrees of the rings that a beam is summed over, and the power its fall follows.
RING_DEG, FALL = 0.1, 4


def efficiency(wavelength_nm: Column) -> Column:
    """Linear between the table's wavelengths, its ends beyond them."""
    at = (wavelength_nm.cast("double") - FIRST_NM) / STEP_NM
    held = F.when(at.isNull() | F.isnan(at), at).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(len(EFFICIENCY) - 1.0), at)))
    low = F.least(F.floor(held), F.lit(len(EFFICIENCY) - 2)).cast("int")
    table = F.array(*map(F.lit, EFFICIENCY))
    return F.get(table, low) + (held - low) * (F.get(table, low + 1) - F.get(table, low))


def lumen_to_watt(lumen: Column, wavelength_nm: Column) -> Column:
    return lumen / (LUMEN_PER_WATT * efficiency(wavelength_nm))


def candela_to_watt(candela: Column, beam_deg: Column, wavelength_nm: Column | None = None) -> Column:
    """Power of a beam whose intensity falls as exp(-a theta^4) to a half at half of ``beam_deg``: rings of 0.1 degrees, summed to 90."""
    a = math.log(2) / F.pow(F.radians(beam_deg / 2), F.lit(float(FALL)))
    ring = math.radians(RING_DEG)
    thetas = F.transform(F.sequence(F.lit(0), F.lit(round(90 / RING_DEG) - 1)), lambda k: (k + 0.5) * ring)
    lumen = F.aggregate(thetas, F.lit(0.0), lambda s, t: s + 2 * math.pi * ring * F.sin(t) * F.exp(-a * F.pow(t, F.lit(float(FALL)))))
    return lumen_to_watt(candela * lumen, F.lit(555.0) if wavelength_nm is None else wavelength_nm)
