"""Least squares of forms with errors in y, in x, or in both; a task holds one series."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Curve = Callable[..., np.ndarray]


@dataclass(frozen=True)
class Form:
    """A curve f(x, p), its slope in x, and a first guess of p from the data; ``basis``: it is a sum of p times these columns."""

    text: str
    f: Curve
    slope: Curve | None
    guess: Curve | None
    basis: Curve | None = None


def _line_guess(u, v) -> np.ndarray:
    return np.polyfit(u, v, 1)


def _exponential_guess(x, y) -> np.ndarray:
    """Amplitude, rate and level: the level is put one step beyond the flattest value, the rest is a line through logarithms."""
    bend = np.sign(np.polyfit(x, y, 2)[0]) or 1.0
    steps = np.unique(y)[:: int(bend)]
    level = steps[0] - (steps[1] - steps[0] if len(steps) > 1 else 0)
    rate, log_a = np.polyfit(x, np.log(np.maximum((y - level) * bend, 1e-300)), 1)
    return np.array([bend * math.exp(log_a), rate, level])


def _cosine_guess(x, y) -> np.ndarray:
    """The best of a range of frequencies, each fitted linearly."""
    best = None
    span = x.max() - x.min()
    for w in np.linspace(0.25, max(1, len(x) / 2), 8 * max(1, len(x))) * math.pi / (span or 1):
        m = np.stack([np.cos(w * x), -np.sin(w * x)], 1)
        c = np.linalg.lstsq(m, y, rcond=None)[0]
        cost = ((y - m @ c) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, np.array([math.hypot(*c), w, math.atan2(c[1], c[0])])
    return best[1]


FORMS = {
    "slope": Form("A*x", lambda x, p: p[0] * x, lambda x, p: p[0] + 0 * x, lambda x, y: np.array([(x * y).sum() / (x * x).sum()]), lambda x: x[:, None]),
    "power": Form("A*x**B", lambda x, p: p[0] * x ** p[1], lambda x, p: p[0] * p[1] * x ** (p[1] - 1), lambda x, y: np.array([1, 0]) + 0 if (x <= 0).any() or (y <= 0).any() else (lambda q: np.array([math.exp(q[1]), q[0]]))(_line_guess(np.log(x), np.log(y)))),
    "log": Form("A*log(x) + B", lambda x, p: p[0] * np.log(x) + p[1], lambda x, p: p[0] / x, lambda x, y: _line_guess(np.log(x), y), lambda x: np.stack([np.log(x), np.ones(len(x))], 1)),
    "exp": Form("A*exp(B*x)", lambda x, p: p[0] * np.exp(p[1] * x), lambda x, p: p[0] * p[1] * np.exp(p[1] * x), lambda x, y: (lambda q: np.array([math.exp(q[1]), q[0]]))(_line_guess(x, np.log(np.maximum(y, 1e-300))))),
    "expc": Form("A*exp(B*x) + C", lambda x, p: p[0] * np.exp(p[1] * x) + p[2], lambda x, p: p[0] * p[1] * np.exp(p[1] * x), _exponential_guess),
    "cos": Form("A*cos(B*x + C)", lambda x, p: p[0] * np.cos(p[1] * x + p[2]), lambda x, p: -p[0] * p[1] * np.sin(p[1] * x + p[2]), _cosine_guess),
}


def polynomial(n: int) -> Form:
    if not 0 < n <= 20:
        raise ValueError(f"no polynomial of degree {n}")
    text = " + ".join(f"{chr(65 + k)}*x**{n - k}" for k in range(n + 1))
    return Form(text, lambda x, p: np.polyval(p, x), lambda x, p: np.polyval(np.polyder(p), x), lambda x, y: np.polyfit(x, y, n), lambda x: np.vander(x, n + 1))


def form_of(form: str | Curve) -> Form:
    """A form by name (slope, linear, quadratic, poly-N, power, exp, expc, log, cos), or of a function f(x, p)."""
    if callable(form):
        return Form("<anon>", form, None, None)
    degree = {"linear": 1, "quadratic": 2}.get(form) or (int(form[5:]) if form.startswith("poly-") else None)
    if degree is not None:
        return polynomial(degree)
    if form not in FORMS:
        raise ValueError(f"no form {form}")
    return FORMS[form]


def least_squares(form: Form, x: np.ndarray, y: np.ndarray, start: np.ndarray, sigma: np.ndarray | None = None, rounds: int = 200):
    """p that makes the sum of ((y - f(x, p)) / sigma) ** 2 least, and the inverse of its curvature. Sums of columns are solved outright, others by Levenberg and Marquardt's method."""
    w = 1 / sigma if sigma is not None else np.ones_like(y)
    if form.basis is not None:
        m = form.basis(x) * w[:, None]
        scale = np.linalg.norm(m, axis=0)
        scale[scale == 0] = 1
        p = np.linalg.lstsq(m / scale, y * w, rcond=None)[0] / scale
        return p, np.linalg.pinv((m / scale).T @ (m / scale)) / np.outer(scale, scale)
    p, damp = np.array(start, float), 1e-3

    def jacobian(p):
        out = []
        for k in range(len(p)):
            h = np.zeros_like(p)
            h[k] = 1e-6 * max(1.0, abs(p[k]))
            out.append((form.f(x, p + h) - form.f(x, p - h)) / (2 * h[k]))
        return np.stack(out, 1) * w[:, None]

    with np.errstate(all="ignore"):
        r = (y - form.f(x, p)) * w
        cost = r @ r
        for _ in range(rounds):
            j = jacobian(p)
            a, g = j.T @ j, j.T @ r
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
            trial = (y - form.f(x, p + step)) * w
            new = trial @ trial
            if np.isfinite(new) and new <= cost:
                done = cost - new <= 1e-15 * max(cost, 1e-300)
                p, r, cost, damp = p + step, trial, new, damp / 5
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
        j = jacobian(p)
        return p, np.linalg.pinv(j.T @ j)


def fits_of(form: Form, x: np.ndarray, y: np.ndarray, sy=None, sx=None, sxy=None, start=None, passes: int = 5) -> list[dict]:
    """One fit without errors, one with errors in y if there are any, one with errors in both.

    ``p``, ``s`` (standard errors), ``cov``, ``sumsquares``, ``chi2`` (for each degree of freedom; with errors
    only), ``r2`` (without errors only), ``dof``. With errors in x the errors in y are widened by the slope, in a
    few passes: sy**2 + slope**2 sx**2 + slope sxy. Covariances with errors are over chi2.
    """
    start = np.asarray(start, float) if start is not None else form.guess(x, y)
    out = []

    def add(name, sigma, p0):
        p, cov = least_squares(form, x, y, p0, sigma)
        dof = len(x) - len(p)
        rest = y - form.f(x, p)
        squares = float(((rest / sigma) ** 2).sum() if sigma is not None else (rest**2).sum())
        chi2 = squares / dof if dof > 0 else float("nan")  # as many rows as parameters: no errors can be told
        with np.errstate(all="ignore"):
            cov = cov / chi2 if sigma is not None else cov * chi2
            s = np.sqrt(np.abs(np.diag(cov)))
        total = float(((y - y.mean()) ** 2).sum())
        return {
            "errors": name, "form": form.text, "p": p.tolist(), "s": s.tolist(), "cov": cov.tolist(), "sumsquares": squares,
            "chi2": chi2 if sigma is not None else None, "r2": (1 - squares / total if total else None) if sigma is None else None, "dof": dof,
        }

    out.append(add("none", None, start))
    if sy is not None and sy.max() > 0:
        out.append(add("y", sy, start))
        if sx is not None and sx.max() > 0:
            p = np.array(out[0]["p"])
            for _ in range(passes):
                slope = form.slope(x, p) if form.slope is not None else np.nan_to_num((form.f(x + 1e-7, p) - form.f(x - 1e-7, p)) / 2e-7)
                last = add("xy", np.sqrt(sy**2 + slope**2 * sx**2 + slope * (sxy if sxy is not None else 0)), p)
                p = np.array(last["p"])
            out.append(last)
    return out


SCHEMA = "errors string, form string, p array<double>, s array<double>, cov array<array<double>>, sumsquares double, chi2 double, r2 double, dof int"


def fit(df: DataFrame, keys: list[str], x: str, y: str, form: str | Curve, sy: str | None = None, sx: str | None = None, sxy: str | None = None, start: list[float] | None = None) -> DataFrame:
    """keys and the columns of SCHEMA: a row for each of fits_of() of every series. Rows with a null or NaN do not count; series with fewer rows than parameters give none."""
    shape = form_of(form)
    if shape.guess is None and start is None:
        raise ValueError("a function needs first values of its parameters")
    n = len(start) if start is not None else len(shape.guess(np.arange(1.0, 30.0), np.arange(1.0, 30.0) ** 1.5))
    named = {"x": x, "y": y, "sy": sy, "sx": sx, "sxy": sxy}
    cols = [F.col(c).cast("double").alias(f"_{k}") for k, c in named.items() if c is not None]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna(subset=[c for c in pdf.columns if c not in keys]).sort_values(["_x", "_y"])
        if len(rows) < n:
            return pd.DataFrame([], columns=[*keys, *[c.split()[0] for c in SCHEMA.split(", ")]])
        part = {k: rows[f"_{k}"].to_numpy() if c is not None else None for k, c in named.items()}
        got = pd.DataFrame(fits_of(shape, part["x"], part["y"], part["sy"], part["sx"], part["sxy"], start))
        for k in keys:
            got[k] = pdf[k].iloc[0]
        return got[[*keys, *[c.split()[0] for c in SCHEMA.split(", ")]]]

    return df.select(*keys, *cols).groupBy(*keys).applyInPandas(run, (head + ", " if head else "") + SCHEMA)


def apply_fit(x, p: list[float], form: str | Curve) -> np.ndarray:
    """The fitted curve at x."""
    return form_of(form).f(np.asarray(x, float), np.asarray(p, float))
