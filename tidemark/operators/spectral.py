"""Spectra of whole series: one task holds one series, so these are grouped pandas functions."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalar import butterworth
from .smooth import gaussian_weights


@lru_cache(maxsize=64)
def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """k tapers of n samples: eigenvectors of Slepian's tridiagonal matrix, of unit energy, of positive mean or first lobe.

    The matrix reads the same backwards, so its symmetric and its antisymmetric vectors are those of two of
    half the size. A worker computes the tapers of a length once, not for each series.
    """
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2.0
    half = n // 2
    found = []
    for sign in (1, -1):
        size = half + (n % 2 if sign == 1 else 0)
        if not size:
            continue
        a, b = main[:size].copy(), off[: size - 1].copy()
        if n % 2 == 0:
            a[-1] += sign * off[half - 1]
        elif sign == 1 and size > 1:
            b[-1] *= math.sqrt(2)
        value, v = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
        for c in range(max(0, size - k), size):
            x = np.zeros(n)
            x[:half] = v[:half, c] / math.sqrt(2)
            x[n - half :] = sign * x[:half][::-1]
            if n % 2 and sign == 1:
                x[half] = v[half, c]
            found.append((value[c], x))
    out = np.array([x for _, x in sorted(found, key=lambda p: -p[0])[:k]])
    for j, t in enumerate(out):
        if (t.sum() if j % 2 == 0 else t[: n // 2].sum()) < 0:
            out[j] = -t
    return out


def bandwidth(n: int, rate: float, nw: float | None, f_res: float | None) -> float:
    """The standardised half bandwidth, given itself or as a resolution in frequency."""
    if (nw is None) == (f_res is None):
        raise ValueError("give one of nw and f_res")
    return float(nw) if nw is not None else n / rate * f_res


def taper_powers(x: np.ndarray, rate: float, nw: float | None = None, f_res: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and one-sided power by taper, with sum T for white noise of unit variance."""
    n = len(x)
    size = 1 << max(0, (n - 1).bit_length())
    nw = bandwidth(n, rate, nw, f_res)
    p = np.abs(np.fft.fft(dpss(n, nw, max(1, int(2 * nw - 1))) * x, size, axis=1)) ** 2 / size * n
    half = size // 2
    out = p[:, : half + 1].copy()
    out[:, 1:half] += p[:, : half : -1]
    return np.arange(half + 1) * rate / size, out


def psd(x: np.ndarray, rate: float, nw: float | None = None, f_res: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    f, p = taper_powers(x, rate, nw, f_res)
    return f, p.mean(0)


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - np.log(x), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - log_gamma(a)) * (x > 0)
    term = total = 1 / a
    for k in range(1, 400):
        term = term * x / (a + k)
        total = total + term
        if (term < 1e-16 * total)[x < a + 1].all():
            break
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for k in range(1, 400):
        n = -k * (k - a)
        b = b + 2
        d = 1 / np.where(n * d + b == 0, 1e-300, n * d + b)
        c = b + n / c
        step = c * d
        h = h * step
        if (np.abs(step - 1) < 1e-15)[x >= a + 1].all():
            break
    return np.where(x < a + 1, front * total, 1 - front * h)


def gamma_quantile(p: float, a: np.ndarray) -> np.ndarray:
    """x with gamma_cdf(a, x) = p: Newton's steps from the cube of a normal quantile."""
    a = np.asarray(a, float)
    x = a * np.maximum(1 - 1 / (9 * a) + NormalDist().inv_cdf(p) / (3 * np.sqrt(a)), 1e-3) ** 3
    at = log_gamma(a)
    for _ in range(12):
        density = np.exp((a - 1) * np.log(x) - x - at)
        step = (gamma_cdf(a, x) - p) / np.maximum(density, 1e-300)
        x = np.maximum(x / 4, x - step)
        if (np.abs(step) <= 1e-13 * x).all():
            break
    return x


def gamma_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of largest likelihood along the first axis."""
    mean = x.mean(0)
    s = np.log(mean) - np.log(x).mean(0)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * np.maximum(s, 1e-12))
    for _ in range(12):
        h = 1e-5 * a
        slope = 1 / a - (digamma(a + h) - digamma(a - h)) / (2 * h)
        step = (np.log(a) - digamma(a) - s) / slope
        a = np.maximum(a / 2, a - step)
        if (np.abs(step) <= 1e-12 * a).all():
            break
    return a, mean / a


def psd_limits(x: np.ndarray, rate: float, nw: float | None = None, f_res: float | None = None, tails: tuple[float, float] = (0.16, 0.84)):
    """Frequencies, power, and its limits: quantiles of a mean over tapers whose powers follow a fitted gamma distribution."""
    f, p = taper_powers(x, rate, nw, f_res)
    k, ok = len(p), (p > 0).all(0)
    low, high = np.zeros(len(f)), np.zeros(len(f))
    a, scale = gamma_fit(p[:, ok])
    low[ok], high[ok] = (gamma_quantile(t, a * k) * scale / k for t in tails)
    return f, p.mean(0), low, high


def taper_spectra(x: np.ndarray, y: np.ndarray, rate: float = 1.0, nw: float | None = 3.0, f_res: float | None = None, detrend: bool = True):
    """Spectra of x and y by taper over the lower half of the bins."""
    n = len(x)
    if detrend:
        t = np.arange(n)
        x, y = (v - np.polyval(np.polyfit(t, v, 1), t) for v in (x, y))
    size = 1 << max(0, (n - 1).bit_length())
    nw = bandwidth(n, rate, nw, f_res)
    tapers = dpss(n, nw, max(1, int(2 * nw - 1)))
    return tuple(np.fft.fft(tapers * v, size, axis=1)[:, : size // 2] for v in (x, y))


def _coherence(a: np.ndarray, b: np.ndarray, mean) -> np.ndarray:
    return mean(a * b.conj()) / np.sqrt(mean(np.abs(a) ** 2) * mean(np.abs(b) ** 2) + 1e-50)


def coherence(x: np.ndarray, y: np.ndarray, nw: float = 3.0, detrend: bool = True) -> np.ndarray:
    """Complex coherence of x with y over the lower half of the bins."""
    return _coherence(*taper_spectra(x, y, 1.0, nw, None, detrend), lambda v: v.mean(0))


def coherence_limits(a: np.ndarray, b: np.ndarray, alpha: float = 0.05) -> dict[str, np.ndarray]:
    """Magnitude and phase with limits by the jackknife: every taper is left out once; magnitudes are compared as logits."""
    k = len(a)
    logit = lambda m: -np.log(1 / np.clip(m * m, 1e-15, 1 - 1e-15) - 1)
    whole = _coherence(a, b, lambda v: v.mean(0))
    less = _coherence(a, b, lambda v: (v.sum(0) - v) / (k - 1))
    at = logit(np.abs(less))
    spread = np.sqrt((k - 1) / k * ((at - at.mean(0)) ** 2).sum(0))
    turn = np.sqrt(np.maximum(0, 2 * (k - 1) * (1 - np.abs((less / (np.abs(less) + 1e-50)).mean(0)))))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    back = lambda v: 1 / np.sqrt(1 + np.exp(-v))
    middle, phase = logit(np.abs(whole)), np.angle(whole)
    return {
        "mag": np.abs(whole), "mag_lo": back(middle - z * spread), "mag_hi": back(middle + z * spread),
        "phase": phase, "phase_lo": phase - z * turn, "phase_hi": phase + z * turn,
    }


def _series(df: DataFrame, keys: list[str], run, fields: str) -> DataFrame:
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.groupBy(*keys).applyInPandas(run, f"{head}, {fields}")


def multitaper_psd(df: DataFrame, keys: list[str], rate: float = 1.0, nw: float | None = 3.0, x: str = "x", f_res: float | None = None, each: bool = False) -> DataFrame:
    """keys, bin, f, power of each series (keys, i, x); ``f_res`` may be given for nw. With ``each`` the tapers' own powers, by taper."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        f, p = taper_powers(s[x].to_numpy(float), rate, nw, f_res)
        if each:
            k, m = p.shape
            return pd.DataFrame({c: [s[c].iloc[0]] * (k * m) for c in keys} | {"taper": np.repeat(np.arange(k), m), "bin": np.tile(np.arange(m), k), "f": np.tile(f, k), "power": p.ravel()})
        return pd.DataFrame({k: [s[k].iloc[0]] * len(f) for k in keys} | {"bin": np.arange(len(f)), "f": f, "power": p.mean(0)})

    return _series(df, keys, run, ("taper int, " if each else "") + "bin int, f double, power double")


def multitaper_psd_limits(df: DataFrame, keys: list[str], rate: float = 1.0, nw: float | None = 3.0, x: str = "x", f_res: float | None = None, tails: tuple[float, float] | float = (0.16, 0.84)) -> DataFrame:
    """keys, bin, f, power, low, high of each series; one number for ``tails`` is the share outside, or inside if over a half."""
    if not isinstance(tails, tuple):
        outside = 1 - tails if tails > 0.5 else tails
        tails = (outside / 2, 1 - outside / 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        f, p, low, high = psd_limits(s[x].to_numpy(float), rate, nw, f_res, tails)
        return pd.DataFrame({k: [s[k].iloc[0]] * len(f) for k in keys} | {"bin": np.arange(len(f)), "f": f, "power": p, "low": low, "high": high})

    return _series(df, keys, run, "bin int, f double, power double, low double, high double")


def multitaper_coherence(df: DataFrame, keys: list[str], nw: float | None = 3.0, x: str = "x", y: str = "y", rate: float = 1.0, f_res: float | None = None, detrend: bool = True) -> DataFrame:
    """keys, bin, re, im of the two signals of each series (keys, i, x, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        c = _coherence(*taper_spectra(s[x].to_numpy(float), s[y].to_numpy(float), rate, nw, f_res, detrend), lambda v: v.mean(0))
        return pd.DataFrame({k: [s[k].iloc[0]] * len(c) for k in keys} | {"bin": np.arange(len(c)), "re": c.real, "im": c.imag})

    return _series(df, keys, run, "bin int, re double, im double")


def multitaper_coherence_limits(df: DataFrame, keys: list[str], alpha: float = 0.05, nw: float | None = 3.0, x: str = "x", y: str = "y", rate: float = 1.0, f_res: float | None = None, detrend: bool = True) -> DataFrame:
    """keys, bin, f, mag, mag_lo, mag_hi, phase, phase_lo, phase_hi of each series (keys, i, x, y); two tapers or more."""
    fields = ("mag", "mag_lo", "mag_hi", "phase", "phase_lo", "phase_hi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        a, b = taper_spectra(s[x].to_numpy(float), s[y].to_numpy(float), rate, nw, f_res, detrend)
        m = a.shape[1]
        return pd.DataFrame({k: [s[k].iloc[0]] * m for k in keys} | {"bin": np.arange(m), "f": np.arange(m) * rate / (2 * m)} | coherence_limits(a, b, alpha))

    return _series(df, keys, run, "bin int, f double, " + ", ".join(f"{c} double" for c in fields))


def fourier_upsample(df: DataFrame, keys: list[str], n: int, x: str = "x") -> DataFrame:
    """keys, j, t, y: n samples for each, by zeros in the upper half of the spectrum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("i")[x].to_numpy(float)
        y = np.fft.irfft(_wide(np.fft.rfft(v), len(v)), len(v) * n) * n
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(y) for k in keys} | {"j": np.arange(len(y)), "t": np.arange(len(y)) / n, "y": y})

    return _series(df, keys, run, "j long, t double, y double")


def _wide(spectrum: np.ndarray, length: int) -> np.ndarray:
    """The middle bin of an even length is shared by both halves."""
    if length % 2 == 0:
        spectrum = spectrum.copy()
        spectrum[-1] /= 2
    return spectrum


def detrend_polynomial(df: DataFrame, keys: list[str], degree: int, x: str = "x") -> DataFrame:
    """keys, i, x less its least-squares polynomial."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        t = s["i"].to_numpy(float) - len(s) / 2
        return s.assign(**{x: s[x] - np.polyval(np.polyfit(t, s[x].to_numpy(float), degree), t)})[[*keys, "i", x]]

    return _series(df, keys, run, f"i {df.schema['i'].dataType.simpleString()}, `{x}` double")


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A recursive filter along the first axis of (n, columns), from a state for each column.

    Stretches of about root n samples are filtered side by side from nothing; the states they end in, carried
    from one to the next, add what each began with. So the interpreter takes some 2 root n steps, not n.
    """
    n, m, columns = len(x), len(a) - 1, x.shape[1]
    size = max(1, math.isqrt(n))
    count = -(-n // size)
    turn = np.diag(np.ones(m - 1), 1)
    turn[:, 0] -= a[1:]
    gain = b[1:] - a[1:] * b[0]
    part = np.zeros((count * size, columns))
    part[:n] = x
    part = part.reshape(count, size, columns)
    out, inner, rows = np.empty_like(part), np.zeros((count, columns, m)), np.empty((size, m))
    power = np.eye(m)
    for t in range(size):
        out[:, t] = b[0] * part[:, t] + inner[..., 0]
        inner = inner @ turn.T + part[:, t][..., None] * gain
        rows[t] = power[0]
        power = power @ turn
    for k in range(count):
        out[k] += rows @ state.T
        state = state @ power.T + inner[k]
    return out.reshape(-1, columns)[:n]


def filtfilt(b: list[float], a: list[float], x: np.ndarray) -> np.ndarray:
    """Zero-phase filter along the first axis: odd extension, steady-state start, forward and backward."""
    flat = x.ndim == 1
    x = x[:, None] if flat else x
    n = max(len(a), len(b))
    b, a = np.pad(np.array(b, float), (0, n - len(b))) / a[0], np.pad(np.array(a, float), (0, n - len(a))) / a[0]
    pad = min(3 * n, len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    comp = np.zeros((n - 1, n - 1))
    comp[0], comp[1:, :-1] = -a[1:], np.eye(n - 2)
    start = np.linalg.solve(np.eye(n - 1) - comp.T, b[1:] - a[1:] * b[0])
    once = lambda v: recursive(b, a, v, v[0][:, None] * start)
    out = once(once(ext)[::-1])[::-1][pad : pad + len(x)]
    return out[:, 0] if flat else out


def filter_series(df: DataFrame, keys: list[str], b: list[float], a: list[float], x: str = "x") -> DataFrame:
    """keys, i, x after a zero-phase filter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        return s.assign(**{x: filtfilt(b, a, s[x].to_numpy(float))})[[*keys, "i", x]]

    return _series(df, keys, run, f"i {df.schema['i'].dataType.simpleString()}, `{x}` double")


def line_noise(x: np.ndarray, rate: float, line: float, f_max: float | None = 500.0, periods: int = 50) -> np.ndarray:
    """What is nearly periodic in x at the ``line`` frequency: x in rows of one period each, smoothed down and along the rows, less the rows' means.

    x is stretched so that a period is a whole number of samples, and back. Rows are smoothed by a zero-phase
    low pass of ``periods``, or by a Gaussian of -periods if that is negative. The part after the last whole
    period takes the last row.
    """
    period = rate / line
    whole = int(period)
    step = period / whole
    n = len(x)
    z = np.interp(np.arange(0, n, step), np.arange(n), x)
    rows = len(z) // whole
    if not rows:
        return np.zeros(n)
    z = z[: rows * whole].reshape(rows, whole)
    if periods > 0:
        z = filtfilt(*butterworth(1 / periods, 1, False), z)
    else:
        weights = np.array(gaussian_weights(-periods, 2))
        half = len(weights) // 2
        index = np.arange(rows)[:, None] + np.arange(-half, half + 1)
        inside = (index >= 0) & (index < rows)
        share = np.where(inside, weights, 0)
        z = np.einsum("rk,rkc->rc", share / share.sum(1, keepdims=True), z[np.clip(index, 0, rows - 1)])
    if f_max is not None:
        z = filtfilt(*butterworth(f_max / rate, 1, False), z.T).T
    z = np.concatenate([z, z[-1:]])
    z = (z - z.mean(1, keepdims=True)).ravel()
    out = np.interp(np.arange(0, len(z), 1 / step), np.arange(len(z)), z)[:n]
    return np.pad(out, (0, n - len(out)))


def template_filter(df: DataFrame, keys: list[str], rate: float, line: float = 60.0, f_max: float | None = 500.0, periods: int = 50, x: str = "x", reference: str | None = None) -> DataFrame:
    """keys, i, x less its line noise. A column ``reference`` gives the line's frequency by the mean distance of its rises, half a deviation over the mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        v, f = s[x].to_numpy(float), line
        if reference is not None:
            r = s[reference].to_numpy(float)
            up = rises(r, r.mean() + r.std() / 2, r.mean() - r.std() / 2)
            f = rate / np.diff(up).mean() if len(up) > 1 else line
        return s.assign(**{x: v - line_noise(v, rate, f, f_max, periods)})[[*keys, "i", x]]

    return _series(df, keys, run, f"i {df.schema['i'].dataType.simpleString()}, `{x}` double")


def rises(x: np.ndarray, on: float, off: float) -> np.ndarray:
    """Places where x comes to ``on`` for the first time since it was at ``off`` or below."""
    mark = np.where(x >= on, 1, np.where(x <= off, 0, -1))
    at = np.flatnonzero(mark >= 0)
    state = mark[at]
    return at[(state == 1) & (np.concatenate([[0], state[:-1]]) == 0)]
