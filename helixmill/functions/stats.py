"""Statistics as Column expressions and windows: no Python runs on the executors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes and weights of Gauss and Legendre's rule on (-1, 1), for Student's t.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(48)


def _sine_integral(upper: Column, df: Column) -> Column:
    """Integral of sin(x) ** (df - 1) up to ``upper``, over the stretch that is not negligible: the integrand falls at least as fast as a Gaussian of width 1 / sqrt(df), and as an exponential of rate (df - 1) / tan(upper)."""
    rate = F.greatest((df - 1) / F.tan(upper), F.lit(1e-300))
    half = F.least(upper, 12.0 / F.sqrt(df), 45.0 / rate) / 2
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(NODES, WEIGHTS, strict=True)])
    return F.aggregate(pairs, F.lit(0.0), lambda total, n: total + n["w"] * F.pow(F.sin(upper - half + half * n["x"]), df - 1)) * half


def t_two_sided(t: Column, df: Column) -> Column:
    """P(\\|T\\| >= \\|t\\|) for Student's t: the regularised incomplete beta at df / (df + t**2), as a ratio of two sine integrals."""
    return _sine_integral(F.asin(F.sqrt(df / (df + t * t))), df) / _sine_integral(F.lit(math.pi / 2), df)


def welch(table: DataFrame) -> DataFrame:
    """Add t, df and p_value to a table with n, mean and var of Case (1) and Control (0); null where either side has under two values or neither varies."""
    a, b = F.try_divide("var1", "n1"), F.try_divide("var0", "n0")
    return table.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(a + b))).withColumn("df", F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1.0) + F.try_divide(b * b, F.col("n0") - 1.0))).withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def adjust(table: DataFrame, p: str = "p_value", key: str = "feature", by: tuple[str, ...] = ()) -> DataFrame:
    """Add p_bonferroni, p_holm and p_bh. One row a feature within ``by``: windows hold as many rows as there are features, never samples."""
    up = Window.partitionBy(*by).orderBy(p, key)
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.col(p)).over(Window.partitionBy(*by))
    ranked = table.withColumn("_rank", F.row_number().over(up)).withColumn("_n", n)
    holm = F.max(F.least(F.lit(1.0), (F.col("_n") - F.col("_rank") + 1) * F.col(p))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col("_n") / F.col("_rank") * F.col(p))).over(down)
    return ranked.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).withColumn("p_holm", holm).withColumn("p_bh", bh).drop("_rank", "_n")


def harmonic(*values: Column) -> Column:
    """Harmonic mean; 0 if a value is 0, null if one is null."""
    zero = values[0] == 0
    for v in values[1:]:
        zero = zero | (v == 0)
    return F.when(zero, 0.0).otherwise(len(values) / sum(1 / v for v in values))


def make_names(name: Column) -> Column:
    """Syntactic names: other characters become dots, and names that don't begin with a letter, or a dot before no digit, get an X."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9._]", ".")
    return F.when(clean.rlike(r"^([A-Za-z]|\.([^0-9]|$))"), clean).otherwise(F.concat(F.lit("X"), clean))


def unit_hash(*parts) -> Column:
    """A number in [0, 1) that only depends on its parts: the same on any partitioning, and in SQL engines with md5."""
    digest = F.md5(F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(16**7)


#: Coefficients of Lanczos's approximation with g = 7 (fixed values).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, from 0.5 on."""
    z = x - 1.0
    sums = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        sums = sums + c / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(sums)


def _steps(size: Column, least: int, times: float) -> Column:
    """1, 2, ... as many as a series or fraction needs, which grow as the root of its parameters."""
    return F.sequence(F.lit(1), (least + times * F.sqrt(size)).cast("int"))


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function: by its series below a + 1, else by its continued fraction."""
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    steps = _steps(F.greatest(a, x), 80, 12.0)
    series = F.aggregate(steps, F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total")), lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["total"] + s["term"] * x / (a + i)).alias("total")))["total"]
    begin = x + 1.0 - a

    def step(s, i):
        top, b = -i * (i - a), begin + 2.0 * i
        d, c = 1.0 / (top * s["d"] + b), b + top / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(steps, F.struct(F.lit(1e300).alias("c"), (1.0 / begin).alias("d"), (1.0 / begin).alias("h")), step)["h"]
    return F.when(x <= 0, 1.0).when(x < a + 1.0, F.greatest(F.lit(0.0), 1.0 - scale * series)).otherwise(scale * fraction)


def chi_squared_upper(x: Column, df: Column) -> Column:
    """P(X >= x) for the chi-squared distribution; null without a degree of freedom."""
    return F.when(df > 0, gamma_upper(F.greatest(df, F.lit(1)) / 2.0, x / 2.0))


def binomial_even(k: Column, n: Column) -> Column:
    """The two-sided exact test of k of n against one half: twice the smaller tail, an incomplete beta function by its continued fraction; 1 in the middle and of none."""
    few = F.least(k, n - k).cast("double")
    a, b, x = n - few, few + 1.0, F.lit(0.5)
    first = 1.0 / (1.0 - (a + b) * x / (a + 1.0))

    def step(s, m):
        up = m * (b - m) * x / ((a - 1.0 + 2.0 * m) * (a + 2.0 * m))
        d, c = 1.0 / (1.0 + up * s["d"]), 1.0 + up / s["c"]
        h = s["h"] * d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 1.0 + 2.0 * m))
        d2, c2 = 1.0 / (1.0 + down * d), 1.0 + down / c
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    fraction = F.aggregate(_steps(F.greatest(a, b), 60, 6.0), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step)["h"]
    tail = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a + b) * math.log(0.5)) * fraction / a
    return F.when(2 * few >= n, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))
