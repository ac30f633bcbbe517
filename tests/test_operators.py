"""Small hand-made cases and invariants of operators that SQL has no form for, or only for usual input."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import color, colormaps, machining, scalar, units
from tidemark.operators import events, fits, grids, match, smooth, spectral, stats
from tidemark.sources import bags, instruments, matfile, pictures


def series(spark, *values):
    return spark.createDataFrame([(k, i, float(x)) for k, v in enumerate(values) for i, x in enumerate(v)], "k int, i long, x double")


def test_schmitt_with_nan_and_open_ends(spark):
    nan = float("nan")
    s = series(spark, [5, 9, 1, nan, 7, 8, nan, 6], [0, 0], [9, 9])
    got = sorted(tuple(r) for r in events.schmitt(s, ["k"], 6, 2).collect())
    assert got == [(0, 1, 1, 2, 1, 9.0), (0, 2, 4, 8, 5, 8.0), (2, 1, 0, 2, 0, 9.0)]
    assert {r["down"] for r in events.schmitt(s, ["k"], 6, 2, end_type=1).collect()} == {2, None}
    assert [r["up"] for r in events.schmitt(s, ["k"], 6, 2, end_type=0, start_type=0).collect()] == [1]


def test_schmitt_equals_a_state_machine(spark):
    rng = random.Random(0)
    signals = [[rng.choice([0, 1, 2, 3, 4, float("nan")]) for _ in range(40)] for _ in range(30)]
    got = {}
    for r in events.schmitt(series(spark, *signals), ["k"], 4, 1).collect():
        got.setdefault(r["k"], set()).add((r["up"], r["down"]))
    for k, v in enumerate(signals):
        want, up = set(), None
        for i, x in enumerate(v):
            if up is None and x >= 4:
                up = i
            elif up is not None and x <= 1:
                want.add((up, i))
                up = None
        if up is not None:
            want.add((up, len(v)))
        assert got.get(k, set()) == want


def test_spikes_keep_the_stronger_of_two_close_ones(spark):
    v = [0.0] * 60
    v[10], v[14], v[40], v[50] = 5, 9, 7, -8
    got = sorted((r["i"], r["x"]) for r in events.detect_spikes(series(spark, v), ["k"], 4, dead=6).collect())
    assert got == [(14, 9.0), (40, 7.0), (50, -8.0)]
    assert [r["i"] for r in events.detect_spikes(series(spark, v), ["k"], 4, polarity=-1, dead=6).collect()] == [50]
    assert events.detect_spikes(series(spark, [0.0] * 5), ["k"], 4).count() == 0


def test_clean_context(spark):
    v = [0.0] * 120
    v[30], v[60], v[75] = 9, 9, 8
    found = events.detect_spikes(series(spark, v), ["k"], 4, dead=3)
    assert [r["i"] for r in events.clean_context(found, series(spark, v), ["k"]).collect()] == [30]


def test_nearest_breaks_ties_by_index(spark):
    rng = random.Random(1)
    a = [(k, i, rng.randint(0, 30)) for k in range(3) for i in range(20)]
    b = [(k, i, rng.randint(0, 30)) for k in range(2) for i in range(15)]
    mk = lambda rows: spark.createDataFrame(rows, "k int, i long, t long")
    for limit in (float("inf"), 3):
        got = {(r["k"], r["i"]): r["j"] for r in match.nearest(mk(a), mk(b), ["k"], limit).collect()}
        for k, i, t in a:
            best = min(((abs(t - u), j) for q, j, u in b if q == k), default=None)
            assert got[k, i] == (best[1] if best and best[0] < limit else None)


def test_tapers_and_spectra_keep_power():
    t = spectral.dpss(64, 3, 5)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-8)
    rng = np.random.default_rng(0)
    total = np.mean([spectral.psd(rng.normal(size=64), 1, 3)[1].sum() for _ in range(300)])
    assert abs(total - 64) < 3
    x = rng.normal(size=128)
    assert np.allclose(np.abs(spectral.coherence(x, 2 * x, 3)), 1)


def test_zero_phase_filter_and_upsampling(spark):
    x = np.sin(np.arange(200) * 0.05)
    b, a = scalar.butterworth(0.1, 2, False)
    assert np.abs(spectral.filtfilt(b, a, x) - x).max() < 0.02
    assert np.allclose(spectral.filtfilt(b, a, np.ones(50)), 1)
    up = spectral.fourier_upsample(series(spark, np.cos(np.arange(16) * 2 * np.pi / 16)), ["k"], 4).orderBy("j").collect()
    assert np.allclose([r["y"] for r in up], np.cos(np.arange(64) * 2 * np.pi / 64), atol=1e-9)


def test_fits_recover_parameters(spark):
    x = np.linspace(0, 3, 40)
    df = spark.createDataFrame([(1, float(a), float(2 * np.exp(-1.5 * a) + 0.5)) for a in x], "k int, x double, y double")
    for start in ([1.0, -1.0, 0.0], None):
        p = fits.fit(df, ["k"], "x", "y", "expc", start=start).first()
        assert np.allclose(p["p"], [2, -1.5, 0.5], atol=1e-4) and p["r2"] > 0.999 and p["dof"] == 37
    assert np.allclose(fits.apply_fit([0, 1], [2, -1.5, 0.5], "expc"), [2.5, 2 * np.exp(-1.5) + 0.5])
    own = fits.fit(df, ["k"], "x", "y", lambda x, q: q[0] * np.exp(-x * 1.5) + q[1], start=[1.0, 0.0]).first()
    assert np.allclose(own["p"], [2, 0.5], atol=1e-6) and own["form"] == "<anon>"
    with pytest.raises(ValueError):
        fits.fit(df, ["k"], "x", "y", "poly-21")
    assert fits.fit(df.limit(2), ["k"], "x", "y", "expc").count() == 0


def test_errors_in_both_change_the_line(spark):
    """Where only the errors in x differ, rows count by the slope times them."""
    rng = np.random.default_rng(0)
    x, sx = np.arange(30.0), np.where(np.arange(30) % 3 == 0, 4.0, 0.1)
    y = 2 * x + 1 + rng.normal(0, 0.2, 30) + np.where(sx > 1, 5.0, 0.0)
    rows = [(1, float(a), float(b), 0.2, float(c)) for a, b, c in zip(x, y, sx, strict=True)]
    got = {r["errors"]: r for r in fits.fit(spark.createDataFrame(rows, "k int, x double, y double, sy double, sx double"), ["k"], "x", "y", "linear", "sy", "sx").collect()}
    w = 1 / (0.04 + got["xy"]["p"][0] ** 2 * sx**2)
    want = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert set(got) == {"none", "y", "xy"} and np.allclose(got["xy"]["p"], want, atol=1e-4) and abs(got["xy"]["p"][1] - 1) < abs(got["none"]["p"][1] - 1)


def test_range_tail_and_letters():
    # Tabled upper 5 % points of the studentized range.
    for q, groups, dof in ((3.877, 3, 10), (3.399, 3, 60), (4.327, 4, 10), (3.314, 3, 1e6), (2.772, 2, 1e6), (3.151, 2, 10)):
        assert abs(stats.studentized_range_sf(q, groups, dof) - 0.05) < 0.0006, (q, groups, dof)
    assert stats.studentized_range_sf(0, 3, 10) == 1 and abs(stats.studentized_range_sf(3.0, 3, 4999) - stats.studentized_range_sf(3.0, 3, 5001)) < 1e-5
    p = {("a", "b"): 0.5, ("a", "c"): 0.01, ("b", "c"): 0.2}
    got = stats.letters(p, {"a": 1.0, "b": 2.0, "c": 3.0})
    assert set(got["a"]) & set(got["b"]) and set(got["b"]) & set(got["c"]) and not set(got["a"]) & set(got["c"])


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(-4, 1, 500), rng.normal(5, 2, 500)])
    got = sorted(stats.mixture(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", 2, rounds=15), key=lambda s: s[1])
    assert abs(got[0][1] + 4) < 0.3 and abs(got[1][1] - 5) < 0.5


def test_bootstrap_is_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    a, b = (sorted(tuple(r) for r in stats.bootstrap_means(df, "id", "v", 5).collect()) for _ in range(2))
    assert a == b and all(abs(m - 4.5) < 0.3 for _, m in a) and len({m for _, m in a}) == 5
    drawn = stats.resample(df, "id", 2).groupBy("rep").agg(F.sum("times"), F.count("*")).collect()
    assert all(r[1] == 2000 and abs(r[2] - 2000 * (1 - math.exp(-1))) < 80 for r in drawn)


def test_moves_find_the_number_of_groups(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(-40, 1, 400), rng.normal(0, 2, 400), rng.normal(50, 1, 200)]).round(1)
    found = stats.split_merge_mixture(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", 5, candidates=2)
    near = lambda c: sum(w for w, m, _ in found.state if abs(m - c) < 10)
    assert found.scores == sorted(found.scores) and len(found.state) < 5
    assert abs(near(-40) - 0.4) < 0.05 and abs(near(0) - 0.4) < 0.05 and abs(near(50) - 0.2) < 0.05
    assert stats.split_merge_mixture(spark.createDataFrame([], "x double"), "x", 2).state == []


def test_power_limits_hold_their_share():
    """Limits at 10 and 90 % of the mean of gamma-distributed powers, against draws."""
    rng = np.random.default_rng(0)
    for shape in (0.7, 3.0):
        draws = rng.gamma(shape * 40, 1 / 40, 200000)
        low, high = (spectral.gamma_quantile(p, np.array([shape * 40])) / 40 for p in (0.1, 0.9))
        assert abs((draws < low).mean() - 0.1) < 0.01 and abs((draws > high).mean() - 0.1) < 0.01
        a, scale = spectral.gamma_fit(rng.gamma(shape, 2.0, (100000, 1)))
        assert abs(a[0] - shape) < 0.03 * shape and abs(a[0] * scale[0] - 2 * shape) < 0.03 * shape
    f, p, low, high = spectral.psd_limits(rng.normal(size=128), 1.0, 4.0)
    assert (low < p).all() and (p < high).all() and len(f) == 65
    assert np.allclose(spectral.psd_limits(np.zeros(16), 1.0, 2.0)[2], 0)
    with pytest.raises(ValueError):
        spectral.psd(np.ones(8), 1.0)


def test_tapers_equal_those_of_the_whole_matrix():
    for n in (5, 8, 64, 65):
        i = np.arange(n)
        main, off = ((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * 2 / n), i[1:] * (n - i[1:]) / 2.0
        v = np.linalg.eigh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1))[1][:, ::-1][:, :3].T
        assert np.allclose(np.abs(spectral.dpss(n, 2.0, 3)), np.abs(v), atol=1e-9)


def test_block_filter_equals_a_loop():
    rng = np.random.default_rng(0)
    for order in (1, 2):
        b, a = (np.array(c + [0.0] * (3 - len(c))) for c in scalar.butterworth(0.07, order, order == 1))
        for n in (1, 2, 17, 100, 1000):
            x, state, want = rng.normal(size=n), rng.normal(size=2), []
            s = state.copy()
            for v in x:
                y = b[0] * v + s[0]
                s = np.array([s[1] + b[1] * v - a[1] * y, b[2] * v - a[2] * y])
                want.append(y)
            assert np.allclose(spectral.recursive(b, a, x[:, None], state[None])[:, 0], want)


def test_line_noise_goes_and_the_signal_stays(spark):
    rng = np.random.default_rng(0)
    t, signal = np.arange(4000) / 1000, rng.normal(size=4000)
    line = 3 * np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 100 * t + 1)
    for periods in (50, -20):
        rest = spectral.line_noise(signal + line, 1000.0, 50.0, None, periods) - line
        assert rest.std() < 0.25 * line.std()
    rows = [(1, i, float(v), float(r)) for i, (v, r) in enumerate(zip(signal + line, np.sin(2 * np.pi * 50 * t + 0.3), strict=True))]
    df = spark.createDataFrame(rows, "k int, i long, x double, r double")
    got = np.array([r["x"] for r in spectral.template_filter(df, ["k"], 1000.0, 60.0, None, -20, reference="r").orderBy("i").collect()])
    assert np.std(got - signal) < 0.5 and spectral.line_noise(np.ones(5), 1000.0, 50.0).tolist() == [0] * 5


def test_coherence_limits_enclose_it():
    rng = np.random.default_rng(0)
    x = rng.normal(size=256)
    got = spectral.coherence_limits(*spectral.taper_spectra(x, x + 0.5 * rng.normal(size=256), nw=5.0))
    assert (got["mag_lo"] <= got["mag"] + 1e-9).all() and (got["mag"] <= got["mag_hi"] + 1e-9).all() and (got["phase_lo"] <= got["phase"]).all()
    assert got["mag"].mean() > 0.7


def test_dynamic_rebin_keeps_the_sum(spark):
    v = [0, 0, 3, 0, 9, 0, 0, 1, 0, 2]
    got = [r["x"] for r in grids.dynamic_rebin(series(spark, v), ["k"], 4).orderBy("i").collect()]
    reach = [next((k for k in range(10) if sum(v[max(0, t - k) : t + k + 1]) > 4), 0) for t in range(10)]
    want = np.zeros(10)
    for t in range(10):
        w = np.exp(-0.5 * (np.arange(10) - t) ** 2 / (reach[t] ** 2 + 1))
        want += w / w.sum() * v[t]
    assert np.allclose(got, want) and abs(sum(got) - 15) < 1e-9


def test_thinning_leaves_a_line():
    p = np.zeros((9, 15), int)
    p[2:7, 2:13] = 1
    for _ in range(6):
        p = grids.thin_once(p)
    assert 0 < p.sum() < 15 and p[4, 7] == 1


def test_thinning_steps_equal_a_plain_loop(spark):
    """Zhang and Suen's two passes, pixel by pixel."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = (rng.random((8, 9)) < 0.7).astype(int)
        want = p.copy()
        for first in (True, False):
            gone = []
            for y in range(8):
                for x in range(9):
                    at = lambda dy, dx: int(0 <= y + dy < 8 and 0 <= x + dx < 9 and want[y + dy, x + dx])  # noqa: B023, E731
                    n = [at(-1, 0), at(-1, 1), at(0, 1), at(1, 1), at(1, 0), at(1, -1), at(0, -1), at(-1, -1)]
                    turns = sum(a == 0 and b == 1 for a, b in zip(n, n[1:] + n[:1], strict=True))
                    ends = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if first else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
                    if want[y, x] and 2 <= sum(n) <= 6 and turns == 1 and ends == (0, 0):
                        gone.append((y, x))
            for y, x in gone:
                want[y, x] = 0
        assert (grids.thin_once(p) == want).all()


def test_units():
    assert abs(units.factor("psi", "kg m^-1 s^-2") / 6.8947573e3 - 1) < 1e-9
    assert units.definition("4 lbs").startswith("1.8143695")
    assert abs(units.factor("3 V / 200 mA", "Ohm") - 15) < 1e-9 and abs(units.factor("2 inch", "cm") - 5.08) < 1e-9
    assert units.parse("m^1|2").exponents[3] == 0.5
    with pytest.raises(ValueError):
        units.factor("m", "s")
    with pytest.raises(ValueError):
        units.parse("blorp")


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.date_add(F.lit("991231"), F.lit(1)).alias("a"), scalar.date_add(F.lit("9912"), F.lit(1)).alias("b"), scalar.time_add(F.lit("2359"), F.lit(90)).alias("c"),
        scalar.protected_split(F.lit("a 'b c' (d e) f\\ g")).alias("d"), scalar.clip(F.lit(float("nan"))).alias("e"), machining.renumber(F.lit("G0\nG1")).alias("f"), scalar.initial_caps(F.lit("hELLO")).alias("g"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["f"], row["g"]) == ("000101", None, "000030", "N10 G0\nN20 G1", "Hello") and row["d"] == ["a", "b c", "d e", "f g"] and math.isnan(row["e"])
    lab = spark.range(1).select(*color.convert((F.lit(0.0), F.lit(0.0), F.lit(0.0)), "srgb", "cieluv")).first()
    assert abs(lab[0]) < 1e-9


def test_color_tables(spark):
    assert colormaps.resistor(spark, True, 2).count() == 14 and colormaps.jet(spark, 16).count() == 16
    assert colormaps.gray_red(spark, 10).count() == 10 and colormaps.dark_jet(spark, 8).agg(F.max("r")).first()[0] <= 1
    assert len(set(colormaps.distinct(5))) == 5


def test_tables_without_a_formula(spark):
    even = even_rows = np.array([[r["r"], r["g"], r["b"]] for r in colormaps.even_hsv(spark, 48).orderBy("i").collect()])
    assert even.min() >= 0 and even.max() <= 1 and len(even_rows) == 48
    step = np.abs(np.diff(np.concatenate([even, even[:1]]), axis=0)).sum(1)
    assert step.max() < 0.6  # a cycle without jumps
    gray = colormaps.cycle_table(spark, 1, 36, 10, 2)
    assert gray.count() == 360 and gray.where("c = 0").select(F.max(F.greatest("r", "g", "b") - F.least("r", "g", "b"))).first()[0] < 1e-3
    with pytest.raises(ValueError):
        colormaps.cycle_table(spark, 3)
    # The numpy form of the colour space equals the columns' form.
    rng = np.random.default_rng(0)
    lsh = np.stack([rng.uniform(20, 90, 50), rng.uniform(0, 0.8, 50), rng.uniform(-3, 3, 50)], 1)
    rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(lsh)], "i int, a double, b double, c double")
    want = rows.select("i", *[x.alias(n) for x, n in zip(color.convert((F.col("a"), F.col("b"), F.col("c")), "lshuv", "srgb", clip=1), "rgb", strict=True)]).orderBy("i").collect()
    assert np.allclose(colormaps.srgb_of_lshuv(*lsh.T), [[r["r"], r["g"], r["b"]] for r in want], atol=1e-9)
    z = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.1), (2, -0.3, 0.9)], "k int, re double, im double")
    got = {r["k"]: (r["r"], r["g"], r["b"]) for r in colormaps.complex_colors(z, "re", "im").collect()}
    assert np.allclose(got[0], 0.99) and len(set(got.values())) == 3
    assert np.allclose(colormaps.shifted(np.linspace(0, 6, 400), 90, 2.0, 30).max(), 2 * 1 / np.abs(np.diff(colormaps.expo(np.linspace(0, 6, 400), 90, 30)) / np.diff(np.linspace(0, 6, 400))).max(), rtol=0.2)
    assert abs(colormaps.gauss(3.0, 3.0, 2.0, 1.0) - 2) < 1e-12


def test_pictures_and_arrays_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 3), (4, 3, 4), (2, 9, 2)):
        p = rng.integers(0, 256, shape).astype(np.uint8)
        assert (pictures.decode(pictures.encode(p)) == p.reshape(*shape[:2], -1)).all()
    # Every filter type, by lines made with it.
    import struct
    import zlib

    p = rng.integers(0, 256, (5, 6 * 3)).astype(int)
    lines = b""
    for y in range(5):
        up = p[y - 1] if y else np.zeros(18, int)
        left, corner = (np.concatenate([np.zeros(3, int), v[:-3]]) for v in (p[y], up))
        guess = left + up - corner
        near = [np.abs(guess - v) for v in (left, up, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        lines += bytes([y]) + ((p[y] - [np.zeros(18, int), left, up, (left + up) // 2, paeth][y]) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (pictures.decode(raw).reshape(5, 18) == p).all()
    path = f"file://{tmp_path}/v.mat"
    matfile.write_mat(spark, path, {"a": [1.5, -2.0], "n": [1, 2, 3], "t": "é x", "c": [["one"], [2.5]], "s": {"p": 1.0, "q": {"r": "in"}}})
    got = {(r["path"], r["i"]): r["number"] if r["number"] == r["number"] and r["number"] is not None else r["text"] for r in matfile.read_mat(spark, path).collect()}
    assert got == {("a", 0): 1.5, ("a", 1): -2.0, ("n", 0): 1, ("n", 1): 2, ("n", 2): 3, ("t", 0): "é x", ("c{0}", 0): "one", ("c{1}", 0): 2.5, ("s.p", 0): 1.0, ("s.q.r", 0): "in"}


def test_medians_at_edges(spark):
    got = series(spark, [5, 1, 9, 2]).select("i", smooth.median3(["k"]).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [5, 5, 2, 2]


def test_instrument_files(spark, tmp_path):
    raw = b":WFMP:XIN 0.5;XZE 1;YOF 2;YMU 0.25;YZE 10;:CURV #14" + bytes([1, 2, 255, 4])
    (tmp_path / "a.isf").write_bytes(raw)
    got = instruments.read_waveforms(spark, str(tmp_path / "a.isf")).orderBy("i").collect()
    assert [(r["t"], r["x"]) for r in got] == [(1.0, 9.75), (1.5, 10.0), (2.0, 9.25), (2.5, 10.5)]
    (tmp_path / "b.set").write_text(':CH1:SCALE 2.5\n:CH1:LABEL "top"\n:MATH:LIST 1,2\n')
    rows = {(tuple(r["path"]), r["part"]): tuple(r["value"]) for r in instruments.read_settings(spark, str(tmp_path / "b.set")).collect()}
    assert rows[("Ch1", "Scale"), 0] == (None, 2.5, None) and rows[("Ch1", "Label"), 0] == (None, None, "top") and rows[("Math", "List"), 1] == (2, None, None)
    (tmp_path / "F0001CH2.CSV").write_text("Record,1,,0.0,1.5\nUnits,s,,0.1,2.5\n")
    got = instruments.read_scope_csv(spark, str(tmp_path / "*.CSV")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 0, 0.0, 1.5), (2, 1, 0.1, 2.5)] and got[0]["file"].endswith("F0001CH2.CSV")
    found = {r["key"]: tuple(r["value"]) for r in instruments.read_scope_settings(spark, str(tmp_path / "*.CSV")).collect()}
    assert found == {"Record": (1, None, None), "Units": (None, None, "s")}


def test_octave_text(spark, tmp_path):
    text = "# Created\n# name: c\n# type: complex scalar\n(4,5)\n\n\n# name: cc\n# type: cell\n# rows: 1\n# columns: 2\n# name: <cell-element>\n# type: sq_string\n# elements: 1\n# length: 3\n1,1\n\n\n# name: <cell-element>\n# type: scalar\n33\n\n\n\n\n# name: s\n# type: scalar struct\n# ndims: 2\n 1 1\n# length: 2\n# name: foo\n# type: scalar\n1\n\n\n# name: bar\n# type: sq_string\n# elements: 1\n# length: 1\nx\n\n\n\n\n# name: xx\n# type: matrix\n# rows: 1\n# columns: 3\n 1 2 3\n\n\n"
    assert dict((p, v) for p, _, v in instruments.octave_text(text)) == {"c": "[4.0, 5.0]", "cc{0,0}": '"1,1"', "cc{0,1}": "33", "s.foo": "1", "s.bar": '"x"', "xx": "[1, 2, 3]"}
    (tmp_path / "t.mat").write_text(text)
    assert instruments.read_octave_text(spark, str(tmp_path / "t.mat")).count() == 6


def test_worksheets(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{r}"><v>{v}</v></c>'
    rows = [("B2", "name"), ("C2", "size"), ("B3", "x"), ("C3", 1.5), ("B4", "y"), ("C4", 2), ("B6", "z"), ("E2", "far")]
    body = "".join(f'<row r="{r[1:]}">{cell(r, v)}</row>' for r, v in rows)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(buf.getvalue())
    cells = instruments.read_cells(spark, str(tmp_path / "w.xlsx"))
    at = instruments.find_cell(cells, "name").first()
    assert (at["r"], at["c"]) == (2, 2)
    got = sorted((r["r"], r["name"], r["s"], r["v"]) for r in instruments.table_at(cells, 2, 2).collect())
    assert got == [(3, "name", "x", None), (3, "size", None, 1.5), (4, "name", "y", None), (4, "size", None, 2.0)]


def test_bags_and_build_steps(spark, tmp_path):
    p = f"file://{tmp_path}"
    bags.save(f"{p}/bag", b=spark.range(3), a=spark.range(2))
    assert [(n, d.count()) for n, d in bags.load(spark, f"{p}/bag").items()] == [("b", 3), ("a", 2)]
    assert bags.load_views(spark, f"{p}/bag") == ["b", "a"] and spark.table("a").count() == 2
    step = lambda: bags.build(spark, f"{p}/out", [f"{p}/bag/a"], lambda d: d.selectExpr("id * 2 AS id"))
    assert step() and not step()
    assert bags.summary(spark.range(5)).first()["high"] == "4"


def test_streaming_hysteresis(spark, tmp_path):
    from pyspark.sql import types as T

    from tidemark.streaming.hysteresis import schmitt_stream

    rows = [(k, f"2024-01-01 00:00:{i:02d}", v) for k in (1, 2) for i, v in enumerate([0.0, 5.0, 9.0, 3.0, 1.0, 7.0, 0.0])]
    spark.createDataFrame(rows, "k int, t string, v double").selectExpr("k", "to_timestamp(t) AS t", "v").write.parquet(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.TimestampType()), T.StructField("v", T.DoubleType())])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = schmitt_stream(stream, "k", "t", "v", 5, 1).writeStream.format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["k"], r["up"].second, r["down"].second, r["peak"]) for r in spark.table("ev").collect())
    assert got == [(1, 1, 4, 9.0), (1, 5, 6, 7.0), (2, 1, 4, 9.0), (2, 5, 6, 7.0)]
