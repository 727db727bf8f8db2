"""Hypergeometric overlap test as joins and expressions."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the published switch to a normal approximation is wanted: terms of the exact sum at most.
PUBLISHED_TERMS = 256
#: Standard deviations around the mode beyond which all terms together are below the smallest double.
REACH = 40

# Fixed coefficients of the rational erf approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Fixed coefficients of Stirling's series for ln Gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def _stirling_error(n: Column) -> Column:
    """ln n! minus Stirling's leading term; exact below 16, a series above."""
    exact = [0.0] + [
        math.lgamma(k + 1) - (k * math.log(k) - k + 0.5 * math.log(2 * math.pi * k)) for k in range(1, 16)
    ]
    x = n.cast("double")
    series = F.lit(0.0)
    for i, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(x, F.lit(2 * i + 1))
    small = F.element_at(F.array(*[F.lit(v) for v in exact]), F.least(n, F.lit(15)).cast("int") + 1)
    return F.when(n < 16, small).otherwise(series)


def ln_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k) in saddle-point form: no differences of huge logarithms, so n may be any size."""
    m = n - k
    share = k / n
    entropy = -k * F.log(share) - m * F.log1p(-share)
    spread = F.lit(0.5) * F.log(n / (F.lit(2 * math.pi) * k * m.cast("double")))
    inner = entropy + spread + _stirling_error(n) - _stirling_error(k) - _stirling_error(m)
    return F.when((k <= 0) | (m <= 0), 0.0).otherwise(inner)


def ln_hypergeometric(k: Column, k_pop: Column, n_draw: Column, n_total: Column) -> Column:
    """Log probability of exactly k marked among n_draw from n_total with k_pop marked."""
    return (
        ln_binomial(k_pop, k) + ln_binomial(n_total - k_pop, n_draw - k) - ln_binomial(n_total, n_draw)
    )


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_sf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) - erf(z / F.lit(math.sqrt(2.0))))


def upper_tail_normal(k: Column, k_pop: Column, n_draw: Column, n_total: Column) -> Column:
    """Normal approximation of P(X >= k) with continuity correction."""
    n, p = n_draw.cast("double"), k_pop / n_total
    mean = n * p
    var = n * p * (1 - p) * (n_total - n_draw) / F.greatest(n_total - 1, F.lit(1))
    z = (k - F.lit(0.5) - mean) / F.sqrt(var)
    return F.when(var > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), normal_sf(z)))).otherwise(
        F.when(k.cast("double") <= mean, 1.0).otherwise(0.0)
    )


def hypergeometric_upper_tail(
    pairs: DataFrame, k: str, k_pop: str, n_draw: str, n_total: str, exact_terms: int | None = None
) -> DataFrame:
    """``pairs`` with ``p_value`` = P(X >= k), summed exactly whatever the size.

    Terms are scaled by the largest so far as they are added, so none underflows, and those too far from the mode
    to change a double are left out.  With ``exact_terms`` (published value: PUBLISHED_TERMS) sums of more terms are
    replaced by the normal approximation.
    """
    K, P, D, N = (F.col(c).cast("bigint") for c in (k, k_pop, n_draw, n_total))
    top = F.least(P, D)
    low = F.greatest(K, D + P - N)
    mode = F.floor((D + 1) * (P + 1) / (N + 2)).cast("bigint")
    spread = F.sqrt(D * (P / N) * (1 - P / N) * (N - D) / F.greatest(N - 1, F.lit(1)))
    reach = (F.ceil(F.coalesce(spread, F.lit(0.0)) * REACH) + REACH).cast("bigint")
    begin = F.least(F.greatest(low, mode - reach), top)
    until = F.greatest(F.least(top, F.greatest(low, mode) + reach), begin)
    log_p = F.transform(F.when(top >= low, F.sequence(begin, until)), lambda i: ln_hypergeometric(i, P, D, N))

    def add(acc: Column, x: Column) -> Column:
        more = x > acc["top"]
        return F.struct(
            F.greatest(x, acc["top"]).alias("top"),
            F.when(more, acc["sum"] * F.exp(acc["top"] - x) + 1.0).otherwise(acc["sum"] + F.exp(x - acc["top"])).alias("sum"),
        )

    first = F.struct(F.lit(-1e308).alias("top"), F.lit(0.0).alias("sum"))
    exact = F.aggregate(log_p, first, add, lambda acc: F.least(F.lit(1.0), F.exp(acc["top"] + F.log(acc["sum"]))))
    p = F.when(K <= 0, 1.0).when(K > top, 0.0)
    if exact_terms is None:
        p = p.otherwise(exact)
    else:
        p = p.when(top - K + 1 <= exact_terms, exact).otherwise(upper_tail_normal(K, P, D, N))
    return pairs.withColumn("p_value", p)


def overlap_is_significant(p_value: Column, k: Column, n_a: Column, n_b: Column, p_max: float) -> Column:
    """False when any margin or the overlap is empty."""
    return (k > 0) & (n_a > 0) & (n_b > 0) & (p_value <= p_max)
