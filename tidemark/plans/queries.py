"""Registered queries of the engine's own operators, each over its whole table, with SQL oracles where SQL has a form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import color as K
from ..functions import colormaps as CM
from ..functions import machining as W
from ..functions import scalar as S
from ..functions import units as U
from ..operators import events as E
from ..operators import fits as FT
from ..operators import grids as D
from ..operators import match as M
from ..operators import smooth as G
from ..operators import spectral as P
from ..operators import stats as T
from . import series as R
from .registry import query

ON, OFF = 300.0, 150.0
_STATE = f"""m AS (SELECT *, CASE WHEN x >= {ON} THEN 1 WHEN x <= {OFF} THEN 0 END AS mk FROM s),
t AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st, max(i) OVER (PARTITION BY k) + 1 AS n FROM m),
u AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY k ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS e FROM t),
v AS (SELECT *, sum(e) OVER (PARTITION BY k ORDER BY i) AS event FROM u),
ev AS (SELECT k, CAST(event AS BIGINT) AS event, min(i) AS up, max(i) + 1 AS down, arg_max(i, (x, -i)) AS peak_i, max(x) AS peak_x, max(n) AS n FROM v WHERE st = 1 GROUP BY k, event)"""


@query("schmitt_events", f"WITH {R.SIGNALS}, {_STATE} SELECT k, event, up, down, peak_i, peak_x FROM ev")
def schmitt_events(spark, d):
    return E.schmitt(R.signals(spark, d), ["k"], ON, OFF)


@query("schmitt_closed", f"WITH {R.SIGNALS}, {_STATE} SELECT k, event, up, down, peak_i, peak_x FROM ev WHERE down < n AND up > 0")
def schmitt_closed(spark, d):
    return E.schmitt(R.signals(spark, d), ["k"], ON, OFF, end_type=0, start_type=0)


@query(
    "schmitt_two_levels",
    f"""WITH {R.SIGNALS}, a AS (SELECT *, CAST(x > {OFF} AS INTEGER) AS ab FROM s),
b AS (SELECT *, CASE WHEN ab = 1 AND coalesce(lag(ab) OVER (PARTITION BY k ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS nw FROM a),
c AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY i) AS run FROM b)
SELECT k, min(CASE WHEN x >= {ON} THEN i END) AS up_a, max(CASE WHEN x >= {ON} THEN i END) + 1 AS down_a, min(i) AS up_b, max(i) + 1 AS down_b
FROM c WHERE ab = 1 GROUP BY k, run HAVING max(x) >= {ON}""",
)
def schmitt_two_levels(spark, d):
    return E.schmitt2(R.signals(spark, d), ["k"], ON, OFF)


_OPS = {"ge": ">=", "gt": ">", "le": "<=", "lt": "<", "eq": "=", "ne": "<>"}
for _op, _sign in _OPS.items():
    for _last in (False, True):
        _name, _agg = ("find_last_" if _last else "find_first_") + _op, "max" if _last else "min"

        def _find(spark, d, op=_op, last=_last):
            return E.find(R.signals(spark, d), ["k"], op, 250.0, last)

        query(_name, f"WITH {R.SIGNALS} SELECT k, {_agg}(CASE WHEN x {_sign} 250.0 THEN i END) AS found FROM s GROUP BY k")(_find)


@query("find_first_true", f"WITH {R.SIGNALS} SELECT k, min(CASE WHEN x <> 0 THEN i END) AS found FROM s GROUP BY k")
def find_first_true(spark, d):
    return E.find(R.signals(spark, d), ["k"], "true")


@query("find_last_true", f"WITH {R.SIGNALS} SELECT k, max(CASE WHEN x <> 0 THEN i END) AS found FROM s GROUP BY k")
def find_last_true(spark, d):
    return E.find(R.signals(spark, d), ["k"], "true", last=True)


@query(
    "noise_estimate",
    f"""WITH {R.SIGNALS}, c AS (SELECT k, i // 8 AS c, stddev_pop(x) AS sd FROM s GROUP BY k, i // 8 HAVING count(*) = 8),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sd, c) AS r, count(*) OVER (PARTITION BY k) AS m FROM c)
SELECT k, sd AS noise FROM r WHERE r = least(floor(0.25 * m + 0.5) + 1, m)""",
)
def noise_estimate(spark, d):
    return E.noise(R.signals(spark, d), ["k"], 8)


def _centred(spark, d):
    s = R.signals(spark, d)
    return s.withColumn("x", G.detrend(["k"], 0))


def _spikes_sql(tail: str) -> str:
    """Peaks of both signs, ranked by strength, each kept if none kept before is near: one step of the recursion a rank."""
    side = []
    for name, sign in (("a", ""), ("b", "-")):
        v = f"{sign}x"
        side.append(f"""m{name} AS (SELECT *, CASE WHEN {v} >= 100 THEN 1 WHEN {v} <= 0 THEN 0 END AS mk FROM z),
t{name} AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m{name}),
u{name} AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY k ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS e FROM t{name}),
v{name} AS (SELECT *, sum(e) OVER (PARTITION BY k ORDER BY i) AS event FROM u{name}),
p{name} AS (SELECT k, '{name}' AS side, arg_max(i, ({v}, -i)) AS i, max({v}) AS h FROM v{name} WHERE st = 1 GROUP BY k, event)""")
    return f"""WITH RECURSIVE {R.SIGNALS}, z AS (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM s), {', '.join(side)},
p AS (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY h DESC, i) AS r FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb)),
g AS (SELECT k, side, r, [i] AS kept FROM p WHERE r = 1
  UNION ALL SELECT p.k, p.side, p.r, CASE WHEN len(list_filter(g.kept, lambda q: abs(q - p.i) < 5)) > 0 THEN g.kept ELSE list_append(g.kept, p.i) END FROM g JOIN p ON p.k = g.k AND p.side = g.side AND p.r = g.r + 1),
found AS (SELECT DISTINCT z.k, z.i, z.x FROM (SELECT k, unnest(arg_max(kept, r)) AS i FROM g GROUP BY k, side) f JOIN z USING (k, i)) {tail}"""


@query("spikes", _spikes_sql("SELECT k, i, x FROM found"))
def spikes(spark, d):
    return E.detect_spikes(_centred(spark, d), ["k"], 100.0, dead=5)


@query(
    "spikes_in_clean_context",
    _spikes_sql("""SELECT f.k, f.i, f.x FROM found f JOIN (SELECT k, max(i) AS n FROM z GROUP BY k) USING (k) WHERE f.i >= 25 AND f.i + 24 <= n
    AND NOT EXISTS (SELECT 1 FROM z WHERE z.k = f.k AND (z.i BETWEEN f.i - 25 AND f.i - 13 OR z.i BETWEEN f.i + 12 AND f.i + 24) AND CASE WHEN f.x > 0 THEN z.x > 0.9 * f.x ELSE z.x < 0.9 * f.x END)
    AND NOT EXISTS (SELECT 1 FROM z WHERE z.k = f.k AND (z.i BETWEEN f.i - 25 AND f.i - 5 OR z.i BETWEEN f.i + 4 AND f.i + 24) AND abs(z.x) > 1.2 * abs(f.x))"""),
)
def spikes_in_clean_context(spark, d):
    return E.clean_spikes(_centred(spark, d), ["k"], 100.0, dead=5, near=0.9, near_abs=1.2)


@query("noise_corrected", f"""WITH {R.SIGNALS}, c AS (SELECT k, i // 8 AS c, stddev_pop(x) AS sd FROM s GROUP BY k, i // 8 HAVING count(*) = 8),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sd, c) AS r, count(*) OVER (PARTITION BY k) AS m FROM c)
SELECT k, sd / {E.noise_factor(8)!r} AS noise FROM r WHERE r = least(floor(0.25 * m + 0.5) + 1, m)""")
def noise_corrected(spark, d):
    return E.noise(R.signals(spark, d), ["k"], 8, None)


@query("points_between_lines", f"WITH {R.SIGNALS} SELECT k, i, x FROM s WHERE x >= CASE WHEN i <= 10 THEN 20 WHEN i <= 40 THEN 20 + (i - 10) * 5.0 ELSE 170 END AND x <= CASE WHEN i <= 5 THEN 400 WHEN i <= 25 THEN 400 - (i - 5) * 10.0 WHEN i <= 50 THEN 200 + (i - 25) * 8.0 ELSE 400 END")
def points_between_lines(spark, d):
    s = R.signals(spark, d)
    return E.between_lines(s, [(5, 400), (25, 200), (50, 400)], [(10, 20), (40, 170)], "i", "x")


@query("schmitt_open", f"WITH {R.SIGNALS}, {_STATE} SELECT k, event, up, CASE WHEN down < n THEN down END AS down, peak_i, peak_x FROM ev")
def schmitt_open(spark, d):
    return E.schmitt(R.signals(spark, d), ["k"], ON, OFF, end_type=1)


@query("boxcar", f"WITH {R.SIGNALS} SELECT k, i, avg(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y FROM s")
def boxcar(spark, d):
    return R.signals(spark, d).select("k", "i", G.boxcar(["k"], 3).alias("y"))


def _gauss_sql(norm: bool) -> str:
    w = G.gaussian_weights(1.5)
    half = len(w) // 2
    rows = ", ".join(f"({k - half}, {v!r})" for k, v in enumerate(w))
    y = "sum(b.x * w.w) / sum(w.w)" if norm else "sum(b.x * w.w)"
    return f"WITH {R.SIGNALS}, w(o, w) AS (VALUES {rows}) SELECT a.k, a.i, {y} AS y FROM s a CROSS JOIN w JOIN s b ON b.k = a.k AND b.i = a.i + w.o GROUP BY a.k, a.i"


@query("gaussian_blur", _gauss_sql(False))
def gaussian_blur(spark, d):
    return R.signals(spark, d).select("k", "i", G.gaussian_blur(["k"], 1.5).alias("y"))


@query("gaussian_blur_edges", _gauss_sql(True))
def gaussian_blur_edges(spark, d):
    return R.signals(spark, d).select("k", "i", G.gaussian_blur(["k"], 1.5, normalise=True).alias("y"))


@query(
    "median_3",
    f"WITH {R.SIGNALS}, n AS (SELECT *, coalesce(lag(x) OVER w, x) AS a, coalesce(lead(x) OVER w, x) AS b FROM s WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, i, list_sort([a, x, b])[2] AS y FROM n",
)
def median_3(spark, d):
    return R.signals(spark, d).select("k", "i", G.median3(["k"]).alias("y"))


@query(
    "median_7",
    f"WITH {R.SIGNALS}, n AS (SELECT *, list(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM s) SELECT k, i, CASE WHEN len(a) = 7 THEN list_sort(a)[4] ELSE x END AS y FROM n",
)
def median_7(spark, d):
    return R.signals(spark, d).select("k", "i", G.median_n(["k"], 3).alias("y"))


@query("detrend_mean", f"WITH {R.SIGNALS} SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS y FROM s")
def detrend_mean(spark, d):
    return R.signals(spark, d).select("k", "i", G.detrend(["k"], 0).alias("y"))


@query("detrend_line", f"WITH {R.SIGNALS} SELECT k, i, x - (regr_intercept(x, i) OVER (PARTITION BY k) + regr_slope(x, i) OVER (PARTITION BY k) * i) AS y FROM s")
def detrend_line(spark, d):
    return R.signals(spark, d).select("k", "i", G.detrend(["k"], 1).alias("y"))


@query("detrend_quadratic", f"WITH {R.SIGNALS}, l AS (SELECT k, regr_slope(i * i, i) AS s, regr_intercept(i * i, i) AS t FROM s GROUP BY k), o AS (SELECT s.k, s.i, s.x, s.i * s.i - l.s * s.i - l.t AS z FROM s JOIN l USING (k)), c AS (SELECT k, covar_pop(z, x) / var_pop(z) AS a, regr_slope(x, i) AS m, regr_intercept(x, i) AS b FROM o GROUP BY k) SELECT o.k, o.i, o.x - c.a * o.z - c.m * o.i - c.b AS x FROM o JOIN c USING (k)")
def detrend_quadratic(spark, d):
    return P.detrend_polynomial(R.signals(spark, d), ["k"], 2)


@query(
    "hermite",
    f"""WITH {R.SIGNALS}, p AS (SELECT k, i, x AS y1, coalesce(lag(x) OVER w, x) AS y0, lead(x) OVER w AS y2, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS y3 FROM s WINDOW w AS (PARTITION BY k ORDER BY i)),
q AS (SELECT *, unnest(CASE WHEN y2 IS NULL THEN [0] ELSE [0, 1, 2] END) AS f FROM p), r AS (SELECT *, f / 3.0::DOUBLE AS m FROM q)
SELECT k, i, CAST(f AS INTEGER) AS f, CASE WHEN y2 IS NULL THEN y1 ELSE (2*m*m*m - 3*m*m + 1) * y1 + (m*m*m - 2*m*m + m) * ((y1 - y0) / 2 + (y2 - y1) / 2) + (m*m*m - m*m) * ((y2 - y1) / 2 + (y3 - y2) / 2) + (3*m*m - 2*m*m*m) * y2 END AS y FROM r""",
)
def hermite(spark, d):
    s = R.signals(spark, d).withColumnRenamed("k", "u")
    return G.hermite(s, ["u"], 3).select(F.col("u").alias("k"), "i", F.col("k").alias("f"), "y")


@query("block_mean", f"WITH {R.SIGNALS} SELECT k, i // 4 AS block, avg(x) AS x FROM s GROUP BY k, i // 4 HAVING count(*) = 4")
def block_mean(spark, d):
    return G.block_mean(R.signals(spark, d), ["k"], 4)


for _op, _agg, _n in (("erode", "min", 4), ("erode", "min", 8), ("dilate", "max", 4), ("dilate", "max", 8)):
    _near = "abs(a.x - b.x) + abs(a.y - b.y) <= 1" if _n == 4 else "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"

    def _morph(spark, d, op=_op, n=_n):
        return G.morphology(R.images(spark, d), "img", op, n)

    query(f"{_op}_{_n}", f"WITH {R.IMAGES} SELECT a.img, a.y, a.x, {_agg}(b.v) AS v FROM im a JOIN im b ON a.img = b.img AND {_near} GROUP BY a.img, a.y, a.x")(_morph)


@query("edge_4", f"WITH {R.IMAGES}, e AS (SELECT a.img, a.y, a.x, max(a.v) AS v, min(b.v) AS m FROM im a JOIN im b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x) SELECT img, y, x, CASE WHEN v <> 0 AND m = 0 THEN v ELSE 0 END AS v FROM e")
def edge_4(spark, d):
    return G.morphology(R.images(spark, d), "img", "edge", 4)


@query("edge_8", f"WITH {R.IMAGES}, e AS (SELECT a.img, a.y, a.x, max(a.v) AS v, min(b.v) AS m FROM im a JOIN im b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x) SELECT img, y, x, CASE WHEN v <> 0 AND m = 0 THEN v ELSE 0 END AS v FROM e")
def edge_8(spark, d):
    return G.morphology(R.images(spark, d), "img", "edge", 8)


_NEAREST = """r AS (SELECT a.k, a.i, b.i AS j, abs(a.t - b.t) AS dt, row_number() OVER (PARTITION BY a.k, a.i ORDER BY abs(a.t - b.t), b.i) AS n FROM a JOIN b USING (k)),
near AS (SELECT a.k, a.i, CASE WHEN r.dt < {m} THEN r.j END AS j FROM a LEFT JOIN r ON r.k = a.k AND r.i = a.i AND r.n = 1)"""
HOUR = 3_600_000_000


@query("match_nearest", f"WITH {R.points_sql('a', 'view')}, {R.points_sql('b', 'click')}, {_NEAREST.format(m=24 * HOUR)} SELECT k, i, j FROM near")
def match_nearest(spark, d):
    return M.nearest(R.points(spark, d, "view"), R.points(spark, d, "click"), ["k"], 24 * HOUR)


@query(
    "match_mutual",
    f"""WITH {R.points_sql('a', 'view')}, {R.points_sql('b', 'click')}, p AS (SELECT a.k, a.i, b.i AS j, abs(a.t - b.t) AS dt FROM a JOIN b USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY dt, j) AS n1, row_number() OVER (PARTITION BY k, j ORDER BY dt, i) AS n2 FROM p)
SELECT k, i, j FROM r WHERE n1 = 1 AND n2 = 1 AND dt < {24 * HOUR}""",
)
def match_mutual(spark, d):
    return M.mutual_nearest(R.points(spark, d, "view"), R.points(spark, d, "click"), ["k"], 24 * HOUR)


@query(
    "correlogram",
    f"""WITH {R.points_sql('a', 'view')}, {R.points_sql('b', 'click')}, p AS (SELECT a.k, CAST(floor(b.t / {24 * HOUR}) - floor(a.t / {24 * HOUR}) AS INTEGER) AS lag FROM a JOIN b USING (k)),
c AS (SELECT k, lag, count(*) AS c FROM p WHERE abs(lag) <= 5 GROUP BY k, lag), g AS (SELECT DISTINCT k, unnest(range(-5, 6)) AS lag FROM a)
SELECT g.k, CAST(g.lag AS INTEGER) AS lag, coalesce(c.c, 0) AS pairs FROM g LEFT JOIN c ON c.k = g.k AND c.lag = g.lag""",
)
def correlogram(spark, d):
    return M.correlogram(R.points(spark, d, "view"), R.points(spark, d, "click"), ["k"], 24 * HOUR, 5, whole=True)


CORNERS = [(0.1, 0.0), (0.9, 0.2), (1.0, 0.8), (0.4, 0.95), (0.0, 0.5)]


def _poly_sql() -> str:
    c = [f"(r - {x0}) * ({y1 - y0!r}) - (g - {y0}) * ({x1 - x0!r})" for (x0, y0), (x1, y1) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)]
    return f"WITH {R.COLORS}, e AS (SELECT o, l, [{', '.join(c)}] AS s FROM c) SELECT o, l, list_min(s) >= 0 OR list_max(s) <= 0 AS inside FROM e"


@query("in_polygon", _poly_sql())
def in_polygon(spark, d):
    return R.colors(spark, d).select("o", "l", M.in_polygon(CORNERS, "r", "g").alias("inside"))


@query("in_polygon_border", "WITH p AS (SELECT x / 2.0::DOUBLE AS x, y / 2.0::DOUBLE AS y FROM range(-2, 5) a(x), range(-2, 5) b(y)) SELECT x, y, x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AS inside FROM p UNION ALL SELECT NULL, 0.5, NULL")
def in_polygon_border(spark, d):
    """A square's own corners, its border, the lines of its edges beyond it, and no point."""
    p = spark.range(49).select((F.floor(F.col("id") / 7) / 2 - 1).alias("x"), (F.col("id") % 7 / 2 - 1).alias("y"))
    p = p.unionByName(spark.createDataFrame([(None, 0.5)], "x double, y double"))
    return p.withColumn("inside", M.in_polygon([(0, 0), (1, 0), (1, 1), (0, 1)]))


@query(
    "polygon_area",
    f"""WITH {R.SPECTRA}, p AS (SELECT k, i // 2 AS i, max(CASE WHEN i % 2 = 0 THEN x END) AS x, max(CASE WHEN i % 2 = 1 THEN x END) AS y FROM s GROUP BY k, i // 2),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, sum(x * ny - nx * y) / 2 AS area FROM n GROUP BY k""",
)
def polygon_area(spark, d):
    s = R.spectra(spark, d)
    pick = lambda r: F.max(F.when(F.col("i") % 2 == r, F.col("x")))
    return M.polygon_area(s.groupBy("k", F.floor(F.col("i") / 2).alias("i")).agg(pick(0).alias("x"), pick(1).alias("y")), ["k"])


_KERNEL = """q AS (SELECT k, i AS row_, CASE WHEN i % 10 = 9 THEN 1000.0 + i ELSE i + 0.5::DOUBLE END AS q FROM s),
e AS (SELECT q.k, q.row_, q.q, s.i, s.x, (q.q - s.i) * (q.q - s.i) / 8.0::DOUBLE AS z FROM q JOIN s ON q.k = s.k),
w AS (SELECT *, exp(min(z) OVER (PARTITION BY k, row_) - z) AS w FROM e)"""


@query("kernel_regression", f"WITH {R.SIGNALS}, {_KERNEL} SELECT k, q, sum(w * x) / sum(w) AS y FROM w GROUP BY k, row_, q")
def kernel_regression(spark, d):
    """Every tenth point lies far beyond the data."""
    s = R.signals(spark, d)
    q = F.when(F.col("i") % 10 == 9, 1000.0 + F.col("i")).otherwise(F.col("i") + 0.5)
    return M.kernel_regression(s.select("k", q.alias("q")), s.select("k", F.col("i").cast("double").alias("x"), F.col("x").alias("y")), ["k"], 2.0)


@query(
    "kernel_regression_error",
    f"""WITH {R.SIGNALS}, e AS (SELECT a.k, a.i AS q, b.i, b.x, exp(-0.5 * ((a.i - b.i) / 2.0::DOUBLE) ^ 2) AS w FROM s a JOIN s b ON a.k = b.k),
m AS (SELECT k, q, sum(w * x) / sum(w) AS y, max(w) / sum(w) AS share FROM e GROUP BY k, q)
SELECT e.k, CAST(e.q AS DOUBLE) AS q, any_value(m.y) AS y, sqrt(sum(e.w * (e.x - r.y) ^ 2) / sum(e.w) * any_value(m.share)) AS sy FROM e JOIN m ON m.k = e.k AND m.q = e.q JOIN m r ON r.k = e.k AND r.q = e.i GROUP BY e.k, e.q""",
)
def kernel_regression_error(spark, d):
    s = R.signals(spark, d).select("k", F.col("i").cast("double").alias("x"), F.col("x").alias("y"))
    return M.kernel_regression(s.select("k", F.col("x").alias("q")), s, ["k"], 2.0, err=True)


@query("primes_below", "SELECT CAST(a.p AS BIGINT) AS p FROM range(2, 5000) a(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 71) b(q) WHERE q < a.p AND a.p % q = 0)")
def primes_below(spark, d):
    return T.primes_below(spark, 5000)


@query("first_primes", "SELECT CAST(a.p AS BIGINT) AS p FROM range(2, 8000) a(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 90) b(q) WHERE q < a.p AND a.p % q = 0) ORDER BY p LIMIT 1000")
def first_primes(spark, d):
    return T.first_primes(spark, 1000)


_G = "m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS vs, var_pop(l_extendedprice) AS vp FROM lineitem GROUP BY 1)"


@query(
    "tukey_q",
    f"WITH {_G}, p AS (SELECT sum((n - 1) * vs) / sum(n - 1) AS mse, CAST(sum(n - 1) AS BIGINT) AS dof FROM m) SELECT a.g AS g1, b.g AS g2, abs(a.m - b.m) / sqrt(p.mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, p.dof, (SELECT count(*) FROM m) AS groups FROM m a JOIN m b ON a.g < b.g CROSS JOIN p",
)
def tukey_q(spark, d):
    return T.tukey_q(R.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("tukey_hsd")
def tukey_hsd(spark, d):
    return T.with_p(T.tukey_q(R.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("games_howell_hsd")
def games_howell_hsd(spark, d):
    return T.with_p(T.games_howell_q(R.table(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


@query("tukey_letters")
def tukey_letters(spark, d):
    c = R.table(spark, d, "customer")
    return T.tukey_letters(T.with_p(T.tukey_q(c, "c_mktsegment", "c_acctbal")), c, "c_mktsegment", "c_acctbal")


@query(
    "games_howell_q",
    f"WITH {_G} SELECT a.g AS g1, b.g AS g2, abs(a.m - b.m) / sqrt((a.vp / a.n + b.vp / b.n) / 2) AS q, (a.vp / a.n + b.vp / b.n) ^ 2 / ((a.vp / a.n) ^ 2 / (a.n - 1) + (b.vp / b.n) ^ 2 / (b.n - 1)) AS dof, (SELECT count(*) FROM m) AS groups FROM m a JOIN m b ON a.g < b.g",
)
def games_howell_q(spark, d):
    return T.games_howell_q(R.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


def _u(key: str, rep: str) -> str:
    """T.congruential() in SQL."""
    h = f"(({key} * 48271 + ({rep} + 1) * 69621 + 1) % {T.PRIME})"
    steps = [f"h0 AS (SELECT *, {h} AS h FROM base)"]
    for i, k in enumerate((16807, 39373, 742938285)):
        steps.append(f"h{i + 1} AS (SELECT * EXCLUDE h, (h * h + h * {k % 65536} + {k}) % {T.PRIME} AS h FROM h{i})")
    return ", ".join(steps)


_TAILS = " + ".join(f"CASE WHEN h / {T.PRIME}.0::DOUBLE >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} THEN 1 ELSE 0 END" for k in range(9))
_BOOT = f"WITH base AS (SELECT c_custkey AS k, c_acctbal AS x, CAST(r AS INTEGER) AS rep FROM customer, range(50) t(r)), {_u('k', 'rep')}, w AS (SELECT rep, x, {_TAILS} AS w FROM h3)"


@query("bootstrap", _BOOT + " SELECT rep, sum(w * x) / sum(w) AS value FROM w GROUP BY rep")
def bootstrap(spark, d):
    return T.bootstrap(R.table(spark, d, "customer"), "c_custkey", 50, T.weighted_mean("c_acctbal"), draw=T.congruential)


@query("bootstrap_deviation", _BOOT + " SELECT rep, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2) AS value FROM w GROUP BY rep")
def bootstrap_deviation(spark, d):
    return T.bootstrap(R.table(spark, d, "customer"), "c_custkey", 50, T.weighted_deviation("c_acctbal"), draw=T.congruential)


@query("exact_resample_size", "SELECT CAST(r AS INTEGER) AS rep, count(*) AS drawn FROM customer, range(3) t(r) GROUP BY r")
def exact_resample_size(spark, d):
    c = T.resample(R.table(spark, d, "customer"), "c_custkey", 3, draw=T.congruential)
    return c.groupBy("rep").agg(F.sum("times").cast("long").alias("drawn"))


for _form, _x, _y in (("linear", "p_size", "p_retailprice"), ("log", "ln(p_size)", "p_retailprice"), ("power", "ln(p_size)", "ln(p_retailprice)"), ("exp", "p_size", "ln(p_retailprice)")):
    _b = f"regr_intercept({_y}, {_x})"

    def _fit(spark, d, form=_form):
        return T.fit_line(R.table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", form)

    query(f"fit_{_form}", f"SELECT p_brand, regr_slope({_y}, {_x}) AS a, {'exp(' + _b + ')' if _form in ('power', 'exp') else _b} AS b, regr_r2({_y}, {_x}) AS r2 FROM part GROUP BY p_brand")(_fit)


@query("fit_slope", "SELECT p_brand, sum(p_size * p_retailprice) / sum(p_size * p_size) AS a, CAST(NULL AS DOUBLE) AS b, 1 - (sum(p_retailprice * p_retailprice) - sum(p_size * p_retailprice) * sum(p_size * p_retailprice) / sum(p_size * p_size)) / (var_pop(p_retailprice) * count(*)) AS r2 FROM part GROUP BY p_brand")
def fit_slope(spark, d):
    return T.fit_line(R.table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "slope")


# The part of the square that no line explains is orthogonal to the line, so its slope stands alone.
_QUADRATIC = """b AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
l AS (SELECT g, regr_slope(x * x, x) AS s, regr_intercept(x * x, x) AS t FROM b GROUP BY g),
o AS (SELECT b.g, b.x, b.y, b.x * b.x - l.s * b.x - l.t AS z, l.s, l.t FROM b JOIN l USING (g)),
c AS (SELECT g, covar_pop(z, y) / var_pop(z) AS a, regr_slope(y, x) AS m, regr_intercept(y, x) AS i, any_value(s) AS s, any_value(t) AS t FROM o GROUP BY g)"""


@query("fit_quadratic", f"WITH {_QUADRATIC}, r AS (SELECT o.g, sum((o.y - c.a * o.x * o.x - (c.m - c.a * c.s) * o.x - (c.i - c.a * c.t)) ^ 2) AS squares, var_pop(o.y) * count(*) AS total, count(*) - 3 AS dof FROM o JOIN c USING (g) GROUP BY o.g) SELECT c.g AS p_brand, c.a AS p0, c.m - c.a * c.s AS p1, c.i - c.a * c.t AS p2, r.squares, 1 - r.squares / r.total AS r2, CAST(r.dof AS INTEGER) AS dof FROM c JOIN r USING (g)")
def fit_quadratic(spark, d):
    got = FT.fit(R.table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "quadratic")
    return got.select("p_brand", *[F.col("p")[k].alias(f"p{k}") for k in range(3)], F.col("sumsquares").alias("squares"), "r2", "dof")


_FIT = "part_ AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, {w} AS w FROM part), z AS (SELECT g, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM part_ GROUP BY g), "
_FIT += "f AS (SELECT p.g, any_value(z.n) AS n, any_value(z.sw) AS sw, any_value(z.mx) AS mx, any_value(z.my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ^ 2) AS a, sum(w * (x - mx) ^ 2) AS sxx FROM part_ p JOIN z USING (g) GROUP BY p.g), "
_FIT += "r AS (SELECT p.g, sum(w * (y - my - a * (x - mx)) ^ 2) AS squares FROM part_ p JOIN f USING (g) GROUP BY p.g) "


@query("fit_line_errors", "WITH " + _FIT.format(w="1.0") + "SELECT g AS p_brand, a, my - a * mx AS b, sqrt(squares / (n - 2) / sxx) AS sa, sqrt(squares / (n - 2) * (1.0 / n + mx * mx / sxx)) AS sb, -squares / (n - 2) * mx / sxx AS cov_ab FROM f JOIN r USING (g)")
def fit_line_errors(spark, d):
    got = FT.fit(R.table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "linear")
    return got.select("p_brand", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("s")[0].alias("sa"), F.col("s")[1].alias("sb"), F.col("cov")[0][1].alias("cov_ab"))


@query("fit_line_weighted", "WITH " + _FIT.format(w="1 / ((1 + p_size % 5) * (1 + p_size % 5))::DOUBLE") + "SELECT g AS p_brand, a, my - a * mx AS b, squares / (n - 2) AS chi2, sqrt(1 / sxx / (squares / (n - 2))) AS sa FROM f JOIN r USING (g)")
def fit_line_weighted(spark, d):
    p = R.table(spark, d, "part").withColumn("sy", 1 + F.col("p_size") % 5)
    got = FT.fit(p, ["p_brand"], "p_size", "p_retailprice", "linear", sy="sy").where("errors = 'y'")
    return got.select("p_brand", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "chi2", F.col("s")[0].alias("sa"))


@query("fit_line_both_errors", "WITH " + _FIT.format(w="1 / (4 + 0.25 * 0)::DOUBLE") + "SELECT g AS p_brand, a, my - a * mx AS b, squares * 4 / (4 + a * a * 0.25) / (n - 2) AS chi2 FROM f JOIN r USING (g)")
def fit_line_both_errors(spark, d):
    """Errors that are the same everywhere only scale the sum, so the line is the plain one; chi squared is not."""
    p = R.table(spark, d, "part").withColumn("sy", F.lit(2.0)).withColumn("sx", F.lit(0.5))
    got = FT.fit(p, ["p_brand"], "p_size", "p_retailprice", "linear", sy="sy", sx="sx").where("errors = 'xy'")
    return got.select("p_brand", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "chi2")


@query("fit_cubic", f"WITH {_QUADRATIC.replace('p_retailprice', 'CAST(p_size AS DOUBLE) ^ 3 - 2.0 * p_size + 1')} SELECT g AS p_brand, [1.0, 0.0, -2.0, 1.0]::DOUBLE[] AS p FROM c")
def fit_cubic(spark, d):
    p = R.table(spark, d, "part").withColumn("y", F.pow("p_size", F.lit(3.0)) - 2 * F.col("p_size") + 1)
    return FT.fit(p, ["p_brand"], "p_size", "y", "poly-3").select("p_brand", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query("fit_curves", "SELECT f AS form, p, true AS fits FROM (VALUES ('power', [3.0, 1.5]), ('exp', [20.0, -0.05]), ('expc', [20.0, -0.05, 4.0]), ('cos', [2.0, 0.4, 0.3])) t(f, p)".replace("p, true", "CAST(p AS DOUBLE[]) AS p, true"))
def fit_curves(spark, d):
    """Each curved form fitted to a curve of its own over the sizes of the parts; parameters to four places, from its own first guess."""
    sizes = R.table(spark, d, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    made = {"power": [3.0, 1.5], "exp": [20.0, -0.05], "expc": [20.0, -0.05, 4.0], "cos": [2.0, 0.4, 0.3]}
    x, out = F.col("x"), None
    curve = {"power": 3 * F.pow(x, F.lit(1.5)), "exp": 20 * F.exp(-0.05 * x), "expc": 20 * F.exp(-0.05 * x) + 4, "cos": 2 * F.cos(0.4 * x + 0.3)}
    for form in made:
        one = FT.fit(sizes.withColumn("y", curve[form]), [], "x", "y", form).select(F.lit(form).alias("form"), F.transform("p", lambda v: F.round(v, 4)).alias("p"), (F.col("r2") > 0.999999).alias("fits"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "mixture_step",
    "WITH v AS (SELECT l_quantity AS x FROM lineitem), p AS (SELECT x, 0.5 / sqrt(2 * pi() * 50) * exp(-((x - 15) ^ 2) / 100) AS a, 0.5 / sqrt(2 * pi() * 50) * exp(-((x - 35) ^ 2) / 100) AS b FROM v), "
    "r AS (SELECT x, a / (a + b) AS a, b / (a + b) AS b, ln(0 + a + b) AS ll FROM p) SELECT 0 AS k, sum(a) / count(*) AS weight, sum(a * x) / sum(a) AS mean, sum(a * x * x) / sum(a) - (sum(a * x) / sum(a)) ^ 2 AS var, CAST(count(*) AS DOUBLE) AS n, sum(ll) AS likelihood FROM r "
    "UNION ALL SELECT 1, sum(b) / count(*), sum(b * x) / sum(b), sum(b * x * x) / sum(b) - (sum(b * x) / sum(b)) ^ 2, count(*), sum(ll) FROM r",
)
def mixture_step(spark, d):
    return T.em_step(R.table(spark, d, "lineitem"), "l_quantity", [0.5, 0.5], [15.0, 35.0], [50.0, 50.0])


def _psd_sql() -> str:
    rows = ", ".join(f"({j}, {i}, {v!r})" for j, t in enumerate(P.dpss(64, 2.0, 3).tolist()) for i, v in enumerate(t))
    return f"""WITH {R.SPECTRA}, w(j, i, w) AS (VALUES {rows}), b AS (SELECT unnest(range(64)) AS b),
f AS (SELECT s.k, w.j, b.b, sum(s.x * w.w * cos(2 * pi() * b.b * s.i / 64)) AS re, sum(s.x * w.w * sin(2 * pi() * b.b * s.i / 64)) AS im FROM s JOIN w USING (i) CROSS JOIN b GROUP BY 1, 2, 3),
p AS (SELECT k, least(b, 64 - b) AS bin, j, sum(re * re + im * im) AS p FROM f GROUP BY 1, 2, 3)
SELECT k, CAST(bin AS INTEGER) AS bin, bin / 64.0::DOUBLE AS f, avg(p) AS power FROM p GROUP BY k, bin"""


@query("multitaper_psd", _psd_sql())
def multitaper_psd(spark, d):
    return P.multitaper_psd(R.spectra(spark, d), ["k"], 1.0, 2.0)


def _taper_rows(nw: float, k: int) -> str:
    return ", ".join(f"({j}, {i}, {v!r})" for j, t in enumerate(P.dpss(64, nw, k).tolist()) for i, v in enumerate(t))


# Tapered sums of the detrended signals and of their reference, by taper and bin.
_COH = f"""WITH {R.SPECTRA}, w(j, i, w) AS (VALUES {_taper_rows(3.0, 5)}), ref AS (SELECT i, avg(x) AS y FROM s GROUP BY i),
l AS (SELECT k, regr_slope(x, i) AS a, regr_intercept(x, i) AS b FROM s GROUP BY k), m AS (SELECT regr_slope(y, i) AS a, regr_intercept(y, i) AS b FROM ref),
dx AS (SELECT s.k, s.i, s.x - l.a * s.i - l.b AS x FROM s JOIN l USING (k)), dy AS (SELECT i, y - m.a * i - m.b AS y FROM ref CROSS JOIN m), b AS (SELECT unnest(range(32)) AS b),
fx AS (SELECT dx.k, w.j, b.b, sum(x * w * cos(2 * pi() * b * i / 64)) AS re, -sum(x * w * sin(2 * pi() * b * i / 64)) AS im FROM dx JOIN w USING (i) CROSS JOIN b GROUP BY 1, 2, 3),
fy AS (SELECT w.j, b.b, sum(y * w * cos(2 * pi() * b * i / 64)) AS re, -sum(y * w * sin(2 * pi() * b * i / 64)) AS im FROM dy JOIN w USING (i) CROSS JOIN b GROUP BY 1, 2),
p AS (SELECT k, b, j, x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im, x.re * x.re + x.im * x.im AS xx, y.re * y.re + y.im * y.im AS yy FROM fx x JOIN fy y USING (j, b)),
c AS (SELECT k, b, sum(re) AS re, sum(im) AS im, sum(xx) AS xx, sum(yy) AS yy FROM p GROUP BY k, b)"""


def _with_reference(spark, d):
    s = R.spectra(spark, d)
    return s.join(s.groupBy("i").agg(F.avg("x").alias("y")), "i")


@query("multitaper_coherence", _COH + " SELECT k, CAST(b AS INTEGER) AS bin, re / sqrt(xx * yy) AS re, im / sqrt(xx * yy) AS im FROM c")
def multitaper_coherence(spark, d):
    return P.multitaper_coherence(_with_reference(spark, d), ["k"])


_LOGIT = "-ln(1 / greatest(1e-15, least(1 - 1e-15, {0} * {0})) - 1)"


@query(
    "multitaper_coherence_limits",
    _COH + f""", t AS (SELECT p.k, p.b, sqrt((c.re - p.re) ^ 2 + (c.im - p.im) ^ 2) / sqrt((c.xx - p.xx) * (c.yy - p.yy)) AS m, (c.re - p.re) / sqrt((c.re - p.re) ^ 2 + (c.im - p.im) ^ 2) AS ur, (c.im - p.im) / sqrt((c.re - p.re) ^ 2 + (c.im - p.im) ^ 2) AS ui FROM p JOIN c USING (k, b)),
    j AS (SELECT k, b, sqrt(0.8 * var_pop({_LOGIT.format('m')}) * 5) AS sd, sqrt(greatest(0, 8 * (1 - sqrt(avg(ur) ^ 2 + avg(ui) ^ 2)))) AS turn FROM t GROUP BY k, b),
    a AS (SELECT k, b, sqrt(re * re + im * im) / sqrt(xx * yy) AS mag, sd, turn FROM c JOIN j USING (k, b))
    SELECT k, CAST(b AS INTEGER) AS bin, b / 64.0::DOUBLE AS f, mag, 1 / sqrt(1 + exp(-({_LOGIT.format('mag')} - 1.959963984540054 * sd))) AS mag_lo, 1 / sqrt(1 + exp(-({_LOGIT.format('mag')} + 1.959963984540054 * sd))) AS mag_hi, round(2 * 1.959963984540054 * turn, 5) AS phase_width FROM a""",
)
def multitaper_coherence_limits(spark, d):
    got = P.multitaper_coherence_limits(_with_reference(spark, d), ["k"])
    return got.select("k", "bin", "f", "mag", "mag_lo", "mag_hi", F.round(F.col("phase_hi") - F.col("phase_lo"), 5).alias("phase_width"))


@query("multitaper_psd_each", _psd_sql().replace("SELECT k, CAST(bin AS INTEGER) AS bin, bin / 64.0::DOUBLE AS f, avg(p) AS power FROM p GROUP BY k, bin", "SELECT k, CAST(j AS INTEGER) AS taper, CAST(bin AS INTEGER) AS bin, bin * 4 / 64.0::DOUBLE AS f, p AS power FROM p"))
def multitaper_psd_each(spark, d):
    """The same half bandwidth, given as a resolution at four samples a second."""
    return P.multitaper_psd(R.spectra(spark, d), ["k"], 4.0, None, f_res=2.0 / 16, each=True)


@query("multitaper_psd_limits")
def multitaper_psd_limits(spark, d):
    return P.multitaper_psd_limits(R.spectra(spark, d), ["k"], 1.0, 3.0)


@query("fourier_upsample", f"WITH {R.SPECTRA}, j AS (SELECT unnest(range(128)) AS j) SELECT s.k, CAST(j.j AS BIGINT) AS j, j.j / 2.0::DOUBLE AS t, sum(s.x * CASE WHEN j.j = 2 * s.i THEN 1 ELSE sin(pi() * (j.j / 2.0 - s.i)) / (64 * tan(pi() * (j.j / 2.0 - s.i) / 64)) END) AS y FROM s CROSS JOIN j GROUP BY s.k, j.j")
def fourier_upsample(spark, d):
    return P.fourier_upsample(R.spectra(spark, d), ["k"], 2)


def _filter_sql(b: list[float], a: list[float]) -> str:
    """Both ways of a recursive filter of second order at most, row by row, over the odd extension, from the steady state of the first value."""
    import numpy as np

    pad = 3 * len(b)
    b, a = [*b, 0.0][:3], [*a, 0.0][:3]
    comp = np.array([[-a[1], -a[2]], [1.0, 0.0]]).T
    z0, z1 = np.linalg.solve(np.eye(2) - comp, np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])).tolist()
    step = "{n} AS (SELECT k, i, {b0!r} * v + {z0!r} * v AS y, {b1!r} * v - {a1!r} * ({b0!r} * v + {z0!r} * v) + {z1!r} * v AS s0, {b2!r} * v - {a2!r} * ({b0!r} * v + {z0!r} * v) AS s1 FROM {e} WHERE i = 0 UNION ALL SELECT f.k, e.i, {b0!r} * e.v + f.s0, {b1!r} * e.v - {a1!r} * ({b0!r} * e.v + f.s0) + f.s1, {b2!r} * e.v - {a2!r} * ({b0!r} * e.v + f.s0) FROM {n} f JOIN {e} e ON e.k = f.k AND e.i = f.i + 1)"
    fill = {"b0": b[0], "b1": b[1], "b2": b[2], "a1": a[1], "a2": a[2], "z0": z0, "z1": z1}
    last = 63 + 2 * pad
    return f"""WITH RECURSIVE {R.SPECTRA}, ends AS (SELECT k, arg_min(x, i) AS x0, arg_max(x, i) AS x1 FROM s GROUP BY k),
    e1 AS (SELECT k, i + {pad} AS i, x AS v FROM s UNION ALL SELECT k, {pad} - i, 2 * x0 - x FROM s JOIN ends USING (k) WHERE i BETWEEN 1 AND {pad} UNION ALL SELECT k, {pad} + 126 - i, 2 * x1 - x FROM s JOIN ends USING (k) WHERE i BETWEEN {63 - pad} AND 62),
    {step.format(n="f1", e="e1", **fill)}, e2 AS (SELECT k, {last} - i AS i, y AS v FROM f1), {step.format(n="f2", e="e2", **fill)}
    SELECT k, {last} - i - {pad} AS i, y AS x FROM f2 WHERE {last} - i - {pad} BETWEEN 0 AND 63"""


for _name, _f, _order, _high in (("low_pass", 0.1, 2, False), ("low_pass_1", 0.1, 1, False), ("high_pass_1", 0.05, 1, True), ("high_pass_2", 0.05, 2, True)):

    def _pass(spark, d, f=_f, order=_order, high=_high):
        return P.filter_series(R.spectra(spark, d), ["k"], *S.butterworth(f, order, high))

    query(_name, _filter_sql(*S.butterworth(_f, _order, _high)))(_pass)


@query("template_filter")
def template_filter(spark, d):
    s = R.signals(spark, d).withColumn("x", F.col("x") + 40 * F.sin(F.col("i") * 2 * 3.141592653589793 / 7.5))
    return P.template_filter(s, ["k"], 7.5, 1.0, None, -3)


@query("dates", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%y%m%d') AS later, date_diff('day', DATE '1995-06-17', CAST('20' || strftime(o_orderdate, '%y-%m-%d') AS DATE)) + date_diff('day', DATE '2095-06-17', DATE '1995-06-17') AS days FROM orders")
def dates(spark, d):
    o = R.table(spark, d, "orders").withColumn("s", F.date_format("o_orderdate", "yyMMdd"))
    return o.select("o_orderkey", S.date_add(F.col("s"), F.lit(45)).alias("later"), S.date_sub(F.col("s"), F.lit("950617")).cast("long").alias("days"))


@query("times", "WITH t AS (SELECT event_id, CAST(epoch(ts) AS BIGINT) % 86400 AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, strftime(TIMESTAMP '2000-01-01' + to_seconds((s + 5000) % 86400), '%H%M%S') AS later, CAST((s - 43200 + 86400) % 86400 AS BIGINT) AS since FROM t")
def times(spark, d):
    e = R.table(spark, d, "events").withColumn("s", F.date_format("ts", "HHmmss"))
    return e.select("event_id", S.time_add(F.col("s"), F.lit(5000)).alias("later"), S.time_sub(F.col("s"), F.lit("1200")).cast("long").alias("since"))


@query("predicates", f"WITH {R.COLORS} SELECT o, l, greatest(0.2, least(0.8, r)) AS clipped, g BETWEEN 0.25 AND 0.75 AS within, g > 0.25 AND g < 0.75 AS strictly, r >= 0.1 AND r < 0.6 AND b >= 0.2 AND b < 0.9 AS in_rect, abs(r - g) < 1e-6 AS same, CASE WHEN r > g THEN r ELSE g END AS larger FROM c")
def predicates(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return R.colors(spark, d).select(
        "o", "l", S.clip(r, 0.2, 0.8).alias("clipped"), S.in_range(g, 0.25, 0.75).alias("within"), S.in_range(g, 0.25, 0.75, True).alias("strictly"),
        S.in_rect(r, b, 0.1, 0.2, 0.5, 0.7).alias("in_rect"), S.equal(r, g, 1e-6).alias("same"), S.if_else(r > g, r, g).alias("larger"),
    )


@query("cross_product", f"WITH {R.COLORS} SELECT o, l, g * 1 - b * 2 AS cx, b * 3 - r * 1 AS cy, r * 2 - g * 3 AS cz FROM c")
def cross_product(spark, d):
    out = S.cross((F.col("r"), F.col("g"), F.col("b")), (F.lit(3), F.lit(2), F.lit(1)))
    return R.colors(spark, d).select("o", "l", *[c.alias(n) for c, n in zip(out, ("cx", "cy", "cz"), strict=True)])


@query("circles", f"WITH {R.COLORS}, k AS (SELECT o, l, r, g, b, 2 * (0 * (1 - g) + 1 * (g - 0) + (r + 2) * (0 - 1)) AS d FROM c), z AS (SELECT o, l, (0 * (1 - g) + 1 * (g - 0) * 1 + ((r + 2) * (r + 2) + g * g) * (0 - 1) + 1 * (g - 0) * 1) / d AS x0, r, g, d, (0 * (r + 2 - 1) + (1 * 1 + 1 * 1) * (0 - (r + 2)) + ((r + 2) * (r + 2) + g * g) * (1 - 0)) / d AS cy FROM k WHERE d <> 0) SELECT o, l, x0 AS cx, cy, sqrt(x0 * x0 + cy * cy) AS radius FROM z")
def circles(spark, d):
    one, zero = F.lit(1.0), F.lit(0.0)
    cx, cy, radius = S.circle_from_3(zero, zero, one, one, F.col("r") + 2, F.col("g"))
    return R.colors(spark, d).select("o", "l", cx.alias("cx"), cy.alias("cy"), radius.alias("radius")).where("cx IS NOT NULL")


@query("photometry", f"WITH {R.COLORS} SELECT o, l, r * (b * 60) ^ 2 / 4182 AS lumen, r * 4182 / (b * 60) ^ 2 AS candela FROM c")
def photometry(spark, d):
    return R.colors(spark, d).select("o", "l", S.candela_to_lumen(F.col("r"), F.col("b") * 60).alias("lumen"), S.lumen_to_candela(F.col("r"), F.col("b") * 60).alias("candela"))


@query(
    "machine_words",
    f"WITH {R.COLORS} SELECT o, l, printf('X%.4f Y%.4f Z%.4f A%.3f C%.3f F%.3f', r / 25.4, g / 25.4, b / 25.4, r * 100, g * 100, b * 60 / 25.4) AS line FROM c",
)
def machine_words(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    parts = [W.word(c, v) for c, v in zip("XYZACF", (r, g, b, r * 100, g * 100, b), strict=True)]
    return R.colors(spark, d).select("o", "l", F.concat_ws(" ", *parts).alias("line"))


_NL = "chr(10)"
_PRE = "chr(10) || 'G90 G94 G17' || chr(10) || 'G20' || chr(10) || 'G53 G0 Z0.' || chr(10) || 'T' || {0} || ' M6' || chr(10) || 'M1' || chr(10) || 'G55' || chr(10) || 'G43 H' || {0} || chr(10)"


@query(
    "machine_passages",
    f"""SELECT s_suppkey, {_PRE.format('s_suppkey')} AS preamble, chr(10) || 'M30' || chr(10) AS ending, chr(10) || 'G53 G0 Z0.' || chr(10) || 'G55' || chr(10) || 'M11' || chr(10) || printf('G0 A%.2f C%.2f', s_acctbal / 97, s_nationkey * 1.0::DOUBLE) || chr(10) || 'M10 ' || chr(10) AS turn,
    'S' || s_nationkey || ' M3' || chr(10) AS spin, 'M5' || chr(10) || 'M1' || chr(10) AS halt, chr(10) || 'G53 G0 Z0.' || chr(10) || 'M5' || chr(10) || 'M1' || chr(10) AS retract,
    {_PRE.format("'10'")} || chr(10) || 'G103 P1' || chr(10) || chr(10) || '    ' || chr(10) || printf('G0 X%.4f Y%.4f    ', s_nationkey / 25.4, s_suppkey / 25.4) || chr(10) || printf('G0 Z%.4f', (1 + 100) / 25.4::DOUBLE) || chr(10) || 'G65 P9832' || chr(10) || printf('G65 P9810 Z%.4f F%.3f', (1 + 12.5) / 25.4::DOUBLE, 20 * 60 / 25.4::DOUBLE) || chr(10) || 'G103' || chr(10) || chr(10) || '    ' || chr(10) || printf('G65 P9995 W55. A20. H%.3f', -25 / 25.4::DOUBLE) || chr(10) || '    ' AS probe,
    'N10 G0' || chr(10) || 'N20 T' || s_suppkey || chr(10) || 'N30 M30' AS numbered FROM supplier""",
)
def machine_passages(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return R.table(spark, d, "supplier").select(
        "s_suppkey", W.preamble(k, "G55").alias("preamble"), W.end().alias("ending"), W.retract_and_rotate(F.col("s_acctbal") / 97, n, "G55").alias("turn"), W.start(n).alias("spin"),
        W.stop().alias("halt"), W.retract_and_stop().alias("retract"), W.probe_z_at(n, k, F.lit(1.0), system="G55").alias("probe"),
        W.renumber(F.concat(F.lit("G0\nT"), k.cast("string"), F.lit("\nM30"))).alias("numbered"),
    )


_XYZ = "x0 AS (SELECT o, l, 0.4124 * r + 0.3576 * g + 0.1805 * b AS x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y, 0.0193 * r + 0.1192 * g + 0.9505 * b AS z FROM c)"


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def _named(c, names):
    return [x.alias(n) for x, n in zip(c, names, strict=True)]


@query("color_xyz", f"WITH {R.COLORS}, {_XYZ} SELECT o, l, x, y, z FROM x0")
def color_xyz(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "ciexyz"), "xyz"))


_F = "f AS (SELECT o, l, {0}, {1}, {2} FROM x0)".format(*[f"CASE WHEN {c} / {w} > (6.0 / 29) ^ 3 THEN cbrt({c} / {w}) ELSE {c} / {w} * ((29.0 / 6) ^ 2 / 3) + 4.0 / 29 END AS f{c}" for c, w in zip("xyz", K.WHITE["d65"], strict=True)])


@query("color_lab", f"WITH {R.COLORS}, {_XYZ}, {_F} SELECT o, l, 116 * fy - 16 AS lum, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM f")
def color_lab(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "cielab"), ("lum", "a", "bb")))


@query("color_lch", f"WITH {R.COLORS}, {_XYZ}, {_F} SELECT o, l, 116 * fy - 16 AS lum, sqrt((500 * (fx - fy)) ^ 2 + (200 * (fy - fz)) ^ 2) AS chroma FROM f")
def color_lch(spark, d):
    return R.colors(spark, d).select("o", "l", *_named(K.convert(_rgb(), "linearrgb", "cielch")[:2], ("lum", "chroma")))


@query("color_gray_and_blend", f"WITH {R.COLORS} SELECT o, l, (2 * r + 3 * g + b) / 6 AS gray, r * 0.25 + 0.75 * g AS blended, CASE WHEN least(63, floor((b - 0.1) / 0.8 * 64)) < 0 THEN 0 ELSE CAST(least(63, floor((b - 0.1) / 0.8 * 64)) AS INTEGER) END AS bin FROM c")
def color_gray_and_blend(spark, d):
    r, g, b = _rgb()
    return R.colors(spark, d).select("o", "l", K.gray(_rgb()).alias("gray"), K.blend((g, g, g), (r, r, r), F.lit(0.25))[0].alias("blended"), K.lut_index(b, 0.1, 0.9, 64).alias("bin"))


@query("inverse_permutation", "WITH p AS (SELECT c_custkey, [(c_custkey + 3 * i) % 7 for i in range(7)] AS p FROM customer) SELECT c_custkey, [list_position(p, i) - 1 for i in range(7)] AS inverse FROM p")
def inverse_permutation(spark, d):
    p = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("c_custkey") + 3 * i) % 7)
    return R.table(spark, d, "customer").select("c_custkey", S.inverse_permutation(p).alias("inverse"))


@query("logit_coherence", f"WITH {R.COLORS}, z AS (SELECT o, l, greatest(1e-15, least(1 - 1e-15, r * r)) AS z FROM c) SELECT o, l, -ln(1 / z - 1) AS logit, sqrt(z) AS magnitude FROM z")
def logit_coherence(spark, d):
    logit = S.logit_coherence(F.col("r"))
    return R.colors(spark, d).select("o", "l", logit.alias("logit"), S.coherence_from_logit(logit).alias("magnitude"))


@query(
    "nulls_and_nan",
    """SELECT * FROM (VALUES ('null', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('nan', 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE), ('low', 0.0, 0.0, 0.0, -2 * 12.92, ln(4 / (1 - 4.0::DOUBLE + 3 + 1e-15) * 0 + 1) - ln(1 / (1 - 1e-15) - 1)), ('high', 1.0, 1.0, 1.0, 1.055 * pow(3, 1 / 2.4::DOUBLE) - 0.055, -ln(1 / (1 - 1e-15) - 1))) t(id, clipped, held, scaled, srgb, logit)""",
)
def nulls_and_nan(spark, d):
    x = F.col("x")
    rows = spark.createDataFrame([("null", None), ("nan", float("nan")), ("low", -2.0), ("high", 3.0)], "id string, x double")
    return rows.select("id", S.clip(x).alias("clipped"), K.clip_color((x, x, x), 1)[0].alias("held"), K.clip_color((x, x, x), 2)[0].alias("scaled"), K.linear_to_srgb((x, x, x))[0].alias("srgb"), S.logit_coherence(x).alias("logit"))


@query("odd_dates", "SELECT * FROM (VALUES ('991231', '000214', 36524), ('000230', NULL, NULL), ('19x101', NULL, NULL), ('2001', NULL, NULL), (NULL, NULL, NULL), ('000101', '000215', 0)) t(s, later, days)")
def odd_dates(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("991231", "000230", "19x101", "2001", None, "000101")], "s string")
    return rows.select("s", S.date_add(F.col("s"), F.lit(45)).alias("later"), S.date_sub(F.col("s"), F.lit("000101")).alias("days"))


@query("odd_fits", "SELECT * FROM (VALUES ('one', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('still', NULL, NULL), ('two', 2.0, 1.0)) t(g, a, b)")
def odd_fits(spark, d):
    """A series of one row, one whose x does not vary, and a line with rows that do not count."""
    rows = [("one", 1.0, 2.0), ("still", 0.0, 1.0), ("still", 0.0, 5.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("two", None, 9.0), ("two", 4.0, None)]
    return T.fit_line(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").select("g", "a", "b")


@query("odd_groups", "SELECT * FROM (VALUES ('a', 'b', 4 / sqrt(1.25), false), ('a', 'c', NULL, true), ('b', 'c', NULL, true)) t(g1, g2, q, none)")
def odd_groups(spark, d):
    """Games and Howell's statistic where a group has one row."""
    rows = [("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 8.0), ("c", 5.0)]
    got = T.games_howell_q(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    return got.select("g1", "g2", "q", F.col("dof").isNull().alias("none"))


@query("array_shapes", "SELECT c_custkey, [c_custkey, 1, c_custkey, 1] AS tiled, CAST(NULL AS BIGINT[]) AS uneven, [[c_custkey, c_custkey], [1, 1], [c_custkey, c_custkey], [1, 1]] AS grid, c_custkey AS one, true AS is_one, false AS two_is_one, true AS row_is_vector, false AS square_is_vector, [false, true, true] AS close FROM customer")
def array_shapes(spark, d):
    k = F.col("c_custkey").cast("long")
    pair, row = F.array(k, F.lit(1).cast("long")), TY.ArrayType(TY.LongType())
    nested = TY.ArrayType(row)
    return R.table(spark, d, "customer").select(
        "c_custkey", S.tile_to(pair, 4).alias("tiled"), S.tile_to(pair, 5).alias("uneven"), S.tile_to(F.array(F.array(k), F.array(F.lit(1).cast("long"))), 4, 2).alias("grid"),
        S.lin(S.as_scalar(nested, F.array(F.array(k)))).alias("one"), S.is_scalar(nested, F.array(F.array(k))).alias("is_one"), S.is_scalar(row, pair).alias("two_is_one"),
        S.is_vector(nested, F.array(pair)).alias("row_is_vector"), S.is_vector(nested, F.array(pair, pair)).alias("square_is_vector"),
        S.arrays_equal(F.array(F.lit(1.0), F.lit(2.0), F.lit(1e6)), F.array(F.lit(1.001), F.lit(2.0), F.lit(1e6)), 1e-10).alias("close"),
    )


#: Texts with quotes of every sort, brackets, escapes and empty fields, and the fields they have; # stands for a number.
SPLITS = [
    ("a b#", ["a", "b#"]), ("a (b c) d#", ["a", "b c", "d#"]), ("'a # b' c", ["a # b", "c"]), ('x "y # z"', ["x", "y # z"]), ("a\\ #", ["a #"]), ("#  b", ["#", "", "b"]),
    ("[# 1] {2 3}", ["# 1", "2 3"]), ("", [""]), ("#", ["#"]), (" #", ["", "#"]), ("# ", ["#", ""]), ("'#' '' x", ["#", "", "x"]), ("\\'# b", ["'#", "b"]),
]


def _split_sql() -> str:
    text = lambda s: "replace('" + s.replace("'", "''") + "', '#', n)"
    rows = " UNION ALL ".join(f"SELECT s_suppkey, {k} AS k, [{', '.join(map(text, f))}] AS fields FROM n" for k, (_, f) in enumerate(SPLITS))
    return f"WITH n AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS n FROM supplier) {rows}"


@query("protected_split", _split_sql())
def protected_split(spark, d):
    n = F.col("s_suppkey").cast("string")
    cases = F.array(*[F.struct(F.lit(k).alias("k"), F.replace(F.lit(t), F.lit("#"), n).alias("t")) for k, (t, _) in enumerate(SPLITS)])
    rows = R.table(spark, d, "supplier").select("s_suppkey", F.explode(cases).alias("c"))
    return rows.select("s_suppkey", F.col("c.k").alias("k"), S.protected_split(F.col("c.t")).alias("fields"))


@query("unit_conversion", "SELECT p_partkey, p_size * 2.54::DOUBLE AS cm, p_size * 6894.7573::DOUBLE / 101325 AS atm FROM part")
def unit_conversion(spark, d):
    p = R.table(spark, d, "part")
    return p.select("p_partkey", U.convert(F.col("p_size"), "inch", "cm").alias("cm"), U.convert(F.col("p_size"), "psi", "atm").alias("atm"))


@query("mesh", "SELECT CAST(i % 40 AS BIGINT) AS x, CAST(i // 40 AS BIGINT) AS y FROM range(1000) t(i)")
def mesh(spark, d):
    return D.mesh(spark, 25, 40)


@query("color_map_jet", "SELECT CAST(i AS INTEGER) AS i, exp(-0.5 * ((i / 255.0 - 0.8) / 0.2) ^ 4) AS r, exp(-0.5 * ((i / 255.0 - 0.5) / 0.25) ^ 4) AS g, exp(-0.5 * ((i / 255.0 - 0.2) / 0.2) ^ 4) AS b FROM range(256) t(i)")
def color_map_jet(spark, d):
    return CM.jet(spark, 256)


@query("daylight", "WITH t AS (SELECT i, 4000 + i * 100.0::DOUBLE AS k FROM range(100) r(i)), x AS (SELECT i, CASE WHEN k > 7000 THEN 0.237040 + 247.48 / k + 1.9018e6 / k ^ 2 - 2.0064e9 / k ^ 3 ELSE 0.244063 + 99.11 / k + 2.9678e6 / k ^ 2 - 4.6070e9 / k ^ 3 END AS x FROM t), y AS (SELECT i, x, -3.0 * x * x + 2.870 * x - 0.275 AS y FROM x) SELECT CAST(i AS BIGINT) AS i, x / y AS wx, (1 - x - y) / y AS wz FROM y")
def daylight(spark, d):
    x, _, z = CM.daylight(4000 + F.col("id") * 100.0)
    return spark.range(100).select(F.col("id").alias("i"), x.alias("wx"), z.alias("wz"))


def _blur_sql(source: str, v: str, out: str) -> str:
    """Two steps: along rows, then along columns; weights beyond the border do not count."""
    w = G.gaussian_weights(0.6)
    rows = ", ".join(f"({k - len(w) // 2}, {c!r})" for k, c in enumerate(w))
    return f"""{out}_h AS (SELECT a.img, a.y, a.x, sum(b.{v} * w.w) / sum(w.w) AS v FROM {source} a CROSS JOIN (VALUES {rows}) w(o, w) JOIN {source} b ON b.img = a.img AND b.y = a.y AND b.x = a.x + w.o GROUP BY 1, 2, 3),
{out} AS (SELECT a.img, a.y, a.x, sum(b.v * w.w) / sum(w.w) AS v FROM {out}_h a CROSS JOIN (VALUES {rows}) w(o, w) JOIN {out}_h b ON b.img = a.img AND b.x = a.x AND b.y = a.y + w.o GROUP BY 1, 2, 3)"""


@query("blurred_pictures", f"WITH {R.IMAGES}, {_blur_sql('im', 'v', 'bl')} SELECT img, y, x, v FROM bl")
def blurred_pictures(spark, d):
    return D.blur(R.images(spark, d).withColumn("v", F.col("v").cast("double")), "img", 0.6)


@query(
    "adaptive_contrast",
    f"""WITH {R.IMAGES}, {_blur_sql('im', 'v', 'bl')}, q AS (SELECT im.img, im.y, im.x, im.v - bl.v AS d, (im.v - bl.v) ^ 2 AS q FROM im JOIN bl USING (img, y, x)), {_blur_sql('q', 'q', 'lo')},
r AS (SELECT q.img, q.y, q.x, q.d, sqrt(lo.v) AS r FROM q JOIN lo USING (img, y, x)), t AS (SELECT *, r + avg(r) OVER (PARTITION BY img) / 4 AS s FROM r) SELECT img, y, x, CASE WHEN s = 0 THEN 0 ELSE d / s END AS v FROM t""",
)
def adaptive_contrast(spark, d):
    return D.adaptive_contrast(R.images(spark, d), "img", 0.6)


@query("thinned_once")
def thinned_once(spark, d):
    return D.thin(R.images(spark, d), "img", 1)


@query("thinned_pictures")
def thinned_pictures(spark, d):
    return D.thin(R.images(spark, d), "img", None)


@query(
    "dynamic_rebin",
    f"""WITH {R.SIGNALS}, n AS (SELECT k, i, floor(x / 100) AS n, max(i) OVER (PARTITION BY k) + 1 AS m FROM s), p AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS p FROM n),
r AS (SELECT a.k, a.i, a.n, a.m, unnest(range(a.m)) AS r FROM p a), g AS (SELECT r.k, r.i, r.n, r.r, hi.p - coalesce(lo.p, 0) AS c FROM r JOIN p hi ON hi.k = r.k AND hi.i = least(r.i + r.r, r.m - 1) LEFT JOIN p lo ON lo.k = r.k AND lo.i = r.i - r.r - 1),
z AS (SELECT k, i, any_value(n) AS n, coalesce(min(r) FILTER (c > 10), 0) AS reach FROM g GROUP BY k, i), w AS (SELECT z.k, p.i AS t, z.i, z.n, exp(-0.5 * (p.i - z.i) ^ 2 / (z.reach ^ 2 + 1)) AS w FROM z JOIN p ON p.k = z.k),
v AS (SELECT *, w / sum(w) OVER (PARTITION BY k, i) * n AS v FROM w) SELECT k, t AS i, sum(v) AS x FROM v GROUP BY k, t""",
)
def dynamic_rebin(spark, d):
    s = R.signals(spark, d).withColumn("x", F.floor(F.col("x") / 100).cast("double"))
    return D.dynamic_rebin(s, ["k"], 10)
