"""Group comparisons, fits, resampling, primes and a Gaussian mixture, on partial aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def primes_below(spark: SparkSession, n: int) -> DataFrame:
    """p: all primes under n; multiples come only from primes up to the root, in parallel."""
    root = math.isqrt(max(n - 1, 0))
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out = spark.range(2, max(n, 2)).withColumnRenamed("id", "p")
    if not small:
        return out
    marks = spark.createDataFrame([(p,) for p in small], "q long").select(F.explode(F.sequence(F.col("q") * F.col("q"), F.lit(n - 1).cast("long"), F.col("q"))).alias("p"))
    return out.join(marks, "p", "left_anti")


def first_primes(spark: SparkSession, n: int) -> DataFrame:
    bound = 12 if n < 6 else int(n * (math.log(n) + math.log(math.log(n)))) + 1
    return primes_below(spark, bound).orderBy("p").limit(max(n, 0))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("vs"), F.var_pop(value).alias("vp"))


def tukey_q(df: DataFrame, group: str, value: str) -> DataFrame:
    """g1, g2, q, dof, groups of every pair of groups: studentized range statistics with the pooled variance. Null q where there is none."""
    m = group_moments(df, group, value)
    rest = F.sum(F.col("n") - 1)
    pooled = m.agg(F.try_divide(F.sum((F.col("n") - 1) * F.coalesce("vs", F.lit(0.0))), rest).alias("mse"), rest.alias("dof"), F.count("*").alias("groups"))
    a, b = m.select(F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("m").alias("m1")), m.select(F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    pairs = a.join(b, F.col("g1") < F.col("g2")).join(pooled)
    q = F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(F.col("mse") / 2 * (F.try_divide(F.lit(1), F.col("n1")) + F.try_divide(F.lit(1), F.col("n2")))))
    return pairs.select("g1", "g2", q.alias("q"), "dof", "groups")


def games_howell_q(df: DataFrame, group: str, value: str) -> DataFrame:
    """g1, g2, q, dof, groups without equal variances; population variances, as the reference method has them. Null where a group has one row."""
    m = group_moments(df, group, value).withColumn("s", F.try_divide(F.col("vp"), F.col("n")))
    a = m.select(*[F.col(c).alias(c + "1") for c in ("g", "n", "m", "s")])
    b = m.select(*[F.col(c).alias(c + "2") for c in ("g", "n", "m", "s")])
    s = F.col("s1") + F.col("s2")
    single = (F.col("n1") < 2) | (F.col("n2") < 2)
    dof = F.when(~single, F.try_divide(s * s, F.try_divide(F.col("s1") ** 2, F.col("n1") - 1) + F.try_divide(F.col("s2") ** 2, F.col("n2") - 1)))
    q = F.when(~single, F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(s / 2)))
    return a.join(b, F.col("g1") < F.col("g2")).join(m.agg(F.count("*").alias("groups"))).select("g1", "g2", q.alias("q"), dof.alias("dof"), "groups")


def studentized_range_sf(q: float, groups: int, dof: float) -> float:
    """Upper tail of the studentized range, by quadrature over the normal and the chi densities, at any degrees of freedom."""
    if q is None or dof is None or math.isnan(q) or math.isnan(dof):
        return float("nan")
    if not q > 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fine = np.linspace(-30, 8, 7601)
    phi = np.concatenate([[0], np.cumsum((np.exp(-fine[1:] ** 2 / 2) + 4 * np.exp(-((fine[1:] + fine[:-1]) / 2) ** 2 / 2) + np.exp(-fine[:-1] ** 2 / 2)) / 6 * np.diff(fine))]) / math.sqrt(2 * math.pi)
    below = np.interp(z, fine, phi)

    def inner(r: float) -> float:
        return float(np.trapezoid(groups * density * (below - np.interp(z - r, fine, phi, left=0.0)) ** (groups - 1), z))

    width = 8 / math.sqrt(2 * dof)
    s = np.linspace(max(1e-3, 1 - width), 1 + width, 201)
    log_chi = (dof - 1) * np.log(s) - dof * (s * s - 1) / 2
    weight = np.exp(log_chi - log_chi.max())
    return max(0.0, min(1.0, 1 - float(np.trapezoid(weight * np.array([inner(q * x) for x in s]), s) / np.trapezoid(weight, s))))


def with_p(pairs: DataFrame) -> DataFrame:
    """Adds p to (g1, g2, q, dof, groups); rows are pairs of groups, so few. Null where q is."""

    @F.pandas_udf("double")
    def p(q: pd.Series, dof: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([studentized_range_sf(a, n, b) for a, b, n in zip(q, dof, groups, strict=True)])

    return pairs.withColumn("p", F.when(F.col("q").isNotNull() & F.col("dof").isNotNull(), p("q", F.col("dof").cast("double"), "groups")))


def tukey_letters(pairs: DataFrame, df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """g, letters of every group, from (g1, g2, p): groups that share a letter do not differ at alpha; "a" is lowest. Rows are groups and pairs of them."""
    means = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.avg(value).alias("m"))
    one = pairs.select(F.lit(0).alias("_k"), F.col("g1").cast("string").alias("g1"), F.col("g2").cast("string").alias("g2"), "p")

    def run(ps: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        found = letters({(a, b): p for a, b, p in zip(ps.g1, ps.g2, ps.p, strict=True) if p == p}, dict(zip(ms.g, ms.m, strict=True)), alpha)
        return pd.DataFrame(sorted(found.items()), columns=["g", "letters"])

    return one.groupBy("_k").cogroup(means.withColumn("_k", F.lit(0)).groupBy("_k")).applyInPandas(run, "g string, letters string")


def letters(p: dict[tuple[str, str], float], means: dict[str, float], alpha: float = 0.05) -> dict[str, str]:
    """Compact letter display: groups that share a letter do not differ at alpha. Input is one row for each group."""
    names = sorted(means, key=means.get)
    alike = lambda a, b: a == b or p.get((a, b), p.get((b, a), 1.0)) > alpha
    cliques: list[set[str]] = []
    for a in names:
        grown = {a}
        for b in names:
            if all(alike(b, c) for c in grown):
                grown.add(b)
        if not any(grown <= c for c in cliques):
            cliques.append(grown)
    for i, a in enumerate(names):  # every alike pair must share one
        for b in names[i + 1 :]:
            if alike(a, b) and not any({a, b} <= c for c in cliques):
                grown = {a, b}
                for d in names:
                    if all(alike(d, c) for c in grown):
                        grown.add(d)
                cliques.append(grown)
    cliques.sort(key=lambda c: sum(means[x] for x in c) / len(c))
    return {a: "".join(chr(97 + k) for k, c in enumerate(cliques) if a in c) for a in names}


def hashed(key: str, rep: int, seed: int = 0) -> Column:
    """A number in [0, 1) for a key column of any type and a replicate."""
    return F.expr(f"pmod(xxhash64(`{key}`, {rep}, {seed}), {1 << 52}L) / {float(1 << 52)!r}D")


#: A prime under 2**31: products of remainders fit 64 bits.
PRIME = 2147483647


def congruential(key: str, rep: int, seed: int = 0) -> Column:
    """The same for whole numbers, in arithmetic that any SQL engine has: three squarings modulo a prime."""
    h = f"pmod(CAST(`{key}` AS BIGINT) * 48271 + {(rep + 1) * 69621 + seed + 1}L, {PRIME}L)"
    for k in (16807, 39373, 742938285):
        h = f"pmod({h} * ({h} + {k % 65536}L) + {k}L, {PRIME}L)"
    return F.expr(f"{h} / {float(PRIME)!r}D")


def bootstrap(df: DataFrame, key: str, times: int, statistic, seed: int = 0, draw=hashed) -> DataFrame:
    """rep, value of ``times`` resamples with replacement, by Poisson weights: one pass, nothing copied, any size.

    ``statistic(w)`` is an aggregate in which a row counts w times, such as weighted_mean("x"). A row's weight
    is a Poisson draw of its key and the replicate, so a resample's size varies as it would.
    """
    # A replicate's draw and its count are columns of their own, so that each is made once.
    draws = df.select("*", *[draw(key, r, seed).alias(f"_u{r}") for r in range(times)])
    tails = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    steps = " ".join(f"WHEN {{u}} < {t!r}D THEN {k}" for k, t in enumerate(tails))
    counts = draws.select("*", *[F.expr(f"CASE {steps.format(u=f'_u{r}')} ELSE 9 END").alias(f"_w{r}") for r in range(times)])
    one = counts.agg(*[statistic(F.col(f"_w{r}")).alias(f"_v{r}") for r in range(times)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"_v{r}").alias("value")) for r in range(times)])).alias("r")).select("r.*")


def weighted_mean(value: str):
    return lambda w: F.sum(w * F.col(value)) / F.sum(w)


def weighted_deviation(value: str):
    """Root mean square deviation."""
    return lambda w: F.sqrt(F.sum(w * F.col(value) * F.col(value)) / F.sum(w) - F.pow(F.sum(w * F.col(value)) / F.sum(w), F.lit(2.0)))


def bootstrap_means(df: DataFrame, key: str, value: str, times: int, seed: int = 0) -> DataFrame:
    return bootstrap(df, key, times, weighted_mean(value), seed).withColumnRenamed("value", "mean")


def resample(df: DataFrame, key: str, reps: int = 1, seed: int = 0, draw=hashed, buckets: int = 64) -> DataFrame:
    """rep, times and df's columns: exact resamples, n draws of n rows with replacement; rows never drawn are left out.

    Rows are numbered in order of a hash of their key within buckets, which begin where those before end, so
    no task numbers them all. Draws are counted by the number they fall on before they meet the rows.
    """
    tagged = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = {r["_b"]: r["n"] for r in tagged.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # one row a bucket
    first, total = {}, 0
    for b in range(buckets):
        first[b] = total
        total += sizes.get(b, 0)
    begin = F.create_map(*[F.lit(x) for p in first.items() for x in p])
    numbered = tagged.withColumn("_i", begin[F.col("_b")] + F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key), key)) - 1).drop("_b")
    out = None
    for rep in range(reps):
        pick = F.least(F.floor(draw("id", rep, seed) * total), F.lit(max(total - 1, 0))).alias("_i")
        counts = df.sparkSession.range(total).select(pick).groupBy("_i").agg(F.count("*").alias("times")).withColumn("rep", F.lit(rep))
        out = counts if out is None else out.unionByName(counts)
    return numbered.join(out, "_i").select("rep", "times", *df.columns)


def fit_line(df: DataFrame, keys: list[str], x: str, y: str, form: str = "linear") -> DataFrame:
    """keys, a, b, r2: y = a x + b (linear), a x (slope, b null), a log x + b (log), b x^a (power), b e^(a x) (exp).

    One aggregate. Rows with a null, or with a logarithm of no number, do not count; null where x does not vary
    (for a slope: is all 0). fits.fit() has errors and covariances, and fits the curved forms themselves.
    """
    u = F.log(x) if form in ("log", "power") else F.col(x)
    v = F.log(y) if form in ("power", "exp") else F.col(y)
    s = df.select(*keys, u.cast("double").alias("_u"), v.cast("double").alias("_v"))
    if form == "slope":
        s = s.where("_u IS NOT NULL AND _v IS NOT NULL")
        a = F.try_divide(F.sum(F.col("_u") * F.col("_v")), F.sum(F.col("_u") ** 2))
        out = s.groupBy(*keys).agg(a.alias("a"), (1 - F.try_divide(F.sum(F.col("_v") ** 2) - a * F.sum(F.col("_u") * F.col("_v")), F.var_pop("_v") * F.count("*"))).alias("r2"))
        return out.select(*keys, "a", F.lit(None).cast("double").alias("b"), "r2")
    out = s.groupBy(*keys).agg(F.regr_slope("_v", "_u").alias("a"), F.regr_intercept("_v", "_u").alias("b"), F.regr_r2("_v", "_u").alias("r2"))
    return out.withColumn("b", F.exp("b")) if form in ("power", "exp") else out


def em_step(df: DataFrame, x: str, weight: list[float], mean: list[float], var: list[float], pull: float = 0.0, times: str | None = None) -> DataFrame:
    """k, weight, mean, var, n, likelihood after one round of expectation and maximisation, as sums over the rows.

    ``pull`` holds variances off 0: (sum + pull) / (n + pull). ``times``: a column of how often a row counts.
    """
    v, c = F.col(x).cast("double"), F.lit(1.0) if times is None else F.col(times).cast("double")
    dens = [F.lit(w / math.sqrt(2 * math.pi * s)) * F.exp(-((v - m) ** 2) / (2 * s)) for w, m, s in zip(weight, mean, var, strict=True)]
    each = df.where(v.isNotNull()).select(v.alias("_x"), c.alias("_c"), *[d.alias(f"_d{k}") for k, d in enumerate(dens)])
    total = sum((F.col(f"_d{k}") for k in range(1, len(dens))), F.col("_d0"))
    each = each.select("_x", "_c", total.alias("_t"), *[(F.col("_c") * F.col(f"_d{k}") / (total + 1e-300)).alias(f"_r{k}") for k in range(len(dens))])
    aggs = [a for k in range(len(weight)) for a in (F.sum(f"_r{k}").alias(f"n{k}"), F.sum(F.col(f"_r{k}") * F.col("_x")).alias(f"s{k}"), F.sum(F.col(f"_r{k}") * F.col("_x") ** 2).alias(f"q{k}"))]
    one = each.agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log(F.col("_t") + 1e-300)).alias("ll"), *aggs)
    rows = []
    for k in range(len(weight)):
        n, s, q = F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"q{k}")
        var_k = F.try_divide(q - F.try_divide(s * s, n) + pull, n + pull)
        rows.append(F.struct(F.lit(k).alias("k"), F.try_divide(n, F.col("n")).alias("weight"), F.try_divide(s, n).alias("mean"), var_k.alias("var"), F.col("n").alias("n"), F.col("ll").alias("likelihood")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mixture(df: DataFrame, x: str, k: int, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-6) -> list[tuple[float, float, float]]:
    """(weight, mean, variance) of k Gaussians; the driver holds k rows, each round is one aggregate."""
    q = df.approxQuantile(x, [(i + 0.5) / k for i in range(k)], 0.01)
    spread = df.agg(F.var_pop(x)).first()[0] or 1.0
    state = [(1 / k, m, spread / k) for m in q]
    for _ in range(rounds):
        got = [(r["weight"], r["mean"], max(r["var"], floor)) for r in sorted(em_step(df, x, *map(list, zip(*state, strict=True))).collect())]
        moved = max(abs(a - b) for s, t in zip(state, got, strict=True) for a, b in zip(s, t, strict=True))
        state = got
        if moved < tolerance:
            break
    return state


@dataclass
class Mixture:
    """Gaussians in one dimension whose number is searched for: (weight, mean, variance) of each, and the score of every state kept."""

    state: list[tuple[float, float, float]]
    scores: list[float]


def split_merge_mixture(df: DataFrame, x: str, k: int, tolerance: float = 1e-3, pull: float = 0.01, rounds: int = 100, candidates: int = 5, nudge: float = 1.0, seed: int = 0) -> Mixture:
    """Expectation and maximisation with moves: merges and splits in turn, each kept if the score grows, until both fail.

    The score is the log likelihood less half the log of n for each of 3 numbers a Gaussian. Candidates for a
    merge are the pairs with the largest products of their shares, for a split those whose shares differ most
    from their curve. Equal values are counted first, so a round is an aggregate over the distinct ones.
    """
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(F.col(x).cast("double").alias("_v")).agg(F.count("*").alias("_n")).persist()
    rng = np.random.default_rng(seed)
    n, spread = counts.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_v") ** 2) / F.sum("_n") - F.pow(F.sum(F.col("_n") * F.col("_v")) / F.sum("_n"), F.lit(2.0))).first()
    if not n:
        return Mixture([], [])

    def settle(state):
        old = None
        for _ in range(rounds):
            got = em_step(counts, "_v", *map(list, zip(*state, strict=True)), pull=pull, times="_n").orderBy("k").collect()
            likelihood = got[0]["likelihood"]
            if old is not None and abs((likelihood - old) / likelihood) < tolerance:
                break
            old = likelihood
            state = [(r["weight"], r["mean"] if r["mean"] is not None else s[1], max(r["var"] if r["var"] is not None else s[2], 1e-9)) for r, s in zip(got, state, strict=True)]
        return state, old - 0.5 * math.log(n) * 3 * len(state)

    def merits(state):
        v, c = F.col("_v"), F.col("_n")
        dens = [F.lit(1 / math.sqrt(2 * math.pi * s)) * F.exp(-((v - m) ** 2) / (2 * s)) for _, m, s in state]
        rows = counts.select("_n", *[d.alias(f"_g{i}") for i, d in enumerate(dens)])
        total = sum((F.lit(state[i][0]) * F.col(f"_g{i}") for i in range(1, len(state))), F.lit(state[0][0]) * F.col("_g0")) + 1e-300
        rows = rows.select("_n", *[F.col(f"_g{i}") for i in range(len(state))], *[(F.lit(state[i][0]) * F.col(f"_g{i}") / total).alias(f"_r{i}") for i in range(len(state))])
        sums = rows.agg(*[F.sum(c * F.col(f"_r{i}")) for i in range(len(state))]).first()
        pairs = [(i, j) for i in range(len(state)) for j in range(i + 1, len(state))]
        share = [F.col(f"_r{i}") / (sums[i] + 1e-300) for i in range(len(state))]
        apart = [F.sum(F.when(share[i] > 1e-5, c * share[i] * F.log(share[i] / (F.col(f"_g{i}") + 1e-5))).otherwise(0.0)) for i in range(len(state))]
        got = rows.agg(*apart, *[F.sum(c * F.col(f"_r{i}") * F.col(f"_r{j}")) for i, j in pairs]).first()
        split = sorted(range(len(state)), key=lambda i: -(got[i] or 0))
        merge = [p for _, p in sorted(((-(got[len(state) + q] or 0), p) for q, p in enumerate(pairs)))]
        return merge[:candidates], split[:candidates]

    low, high = counts.agg(F.min("_v"), F.max("_v")).first()
    state, score = settle([(1 / k, m, max(spread / 40, 1e-9)) for m in (low + (high - low) * rng.random(k)).tolist()])
    scores, merging, fails = [score], True, 0
    while fails < 2:
        merge, split = merits(state)
        for move in merge if merging else split:
            if merging:
                i, j = move
                (w0, m0, s0), (w1, m1, s1) = state[i], state[j]
                trial = [s for q, s in enumerate(state) if q not in (i, j)] + [(w0 + w1, (m0 + m1) / 2, (s0 + s1) / 2)]
            else:
                w0, m0, s0 = state[move]
                one, two = (m0 + nudge * math.sqrt(s0) * float(z) for z in rng.standard_normal(2))
                trial = [s for q, s in enumerate(state) if q != move] + [(w0 / 2, one, s0), (w0 / 2, two, s0)]
            trial, score = settle(trial)
            if score > scores[-1]:
                state, fails = trial, 0
                scores.append(score)
                break
        else:
            fails += 1
            merging = not merging
    counts.unpersist()
    return Mixture(sorted(state, key=lambda s: s[1]), scores)
