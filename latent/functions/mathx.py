"""Special functions and log-space arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling series of log gamma, coefficients of 1/x, 1/x^3, ... 1/x^13.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
SHIFT = 7


def sql(x) -> str:
    """A number as a SQL double, or SQL text in brackets."""
    return f"{float(x)!r}D" if isinstance(x, (int, float)) else f"({x})"


def lgamma_sql(x) -> str:
    """SQL text of log Γ(x), x > 0: small arguments are shifted up before the Stirling series.

    Formulas that use it are put together as SQL text, which Spark parses in one call;
    building them operator by operator costs far more than running them on small data.
    """
    if isinstance(x, (int, float)):
        return sql(math.lgamma(x))
    x = sql(x)
    small = f"{x} < {SHIFT}"
    y = f"(IF({small}, {x} + {SHIFT}D, CAST({x} AS DOUBLE)))"
    inv2 = f"(1D / ({y} * {y}))"
    series = sql(STIRLING[-1])
    for c in reversed(STIRLING[:-1]):
        series = f"({series} * {inv2} + {sql(c)})"
    rising = " * ".join([f"CAST({x} AS DOUBLE)"] + [f"({x} + {i}D)" for i in range(1, SHIFT)])
    return (f"(({y} - 0.5D) * ln({y}) - {y} + {sql(0.5 * math.log(2 * math.pi))} + {series} / {y}"
            f" - IF({small}, ln({rising}), 0D))")


def lgamma_col(x) -> Column:
    """log Γ of a SQL expression, x > 0."""
    return F.expr(lgamma_sql(x))


def factln_col(n) -> Column:
    return lgamma_col(f"{n} + 1D")


def polya_sql(a, n, k) -> str:
    return f"({lgamma_sql(f'{sql(a)} + {sql(n)} + {sql(k)}')} - {lgamma_sql(f'{sql(a)} + {sql(n)}')})"


def polya_ratio(a, n, k) -> Column:
    """log Γ(a+n+k) − log Γ(a+n): the Dirichlet-multinomial step for k more of a term."""
    return F.expr(polya_sql(a, n, k))


def polya_empty(a, k) -> Column:
    """``polya_ratio(a, 0, k)``; a plain log for k = 1."""
    many = f"{lgamma_sql(f'{sql(a)} + {sql(k)}')} - {lgamma_sql(a)}"
    return F.expr(f"IF({k} = 1, ln({sql(a)}), {many})")


def polya_gain(a, n, k) -> Column:
    """What n earlier occurrences add to ``polya_ratio(a, 0, k)``; a plain log for k = 1."""
    many = f"{polya_sql(a, n, k)} - {lgamma_sql(f'{sql(a)} + {sql(k)}')} + {lgamma_sql(a)}"
    return F.expr(f"IF({k} = 1, ln({sql(a)} + {n}) - ln({sql(a)}), {many})")


def logsumexp(df, keys, value: str, out: str = "lse"):
    """Stable log Σ exp(value) per key; −inf entries carry no mass."""
    peak = df.groupBy(*keys).agg(F.max(value).alias("_peak"))
    if keys:
        joined = df.join(peak, list(keys))
    else:
        joined = df.withColumn("_peak", F.lit(df.agg(F.max(value)).first()[0]).cast("double"))
    return (joined.groupBy(*keys)
            .agg((F.max("_peak") + F.ln(F.sum(F.exp(F.col(value) - F.col("_peak"))))).alias(out)))


def normalize_log(df, keys, value: str, out: str = "p"):
    """Turn log weights into probabilities summing to 1 per key."""
    return (df.join(logsumexp(df, keys, value, "_lse"), list(keys))
            .withColumn(out, F.exp(F.col(value) - F.col("_lse"))).drop("_lse"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def log_bessel_i(nu: float, z) -> Column:
    """Large-order approximation of log I_nu(z)."""
    z = F.lit(float(z)) if not isinstance(z, Column) else z
    root = F.sqrt(1.0 + F.pow(z / nu, F.lit(2.0)))
    eta = root + F.ln(z / nu) - F.ln(1.0 + root)
    return -0.5 * math.log(2 * math.pi * nu) + nu * eta - 0.5 * F.ln(root)


def vmf_logp(v, mu, kappa, p: int, normalize: bool = True) -> Column:
    """von Mises-Fisher log density of unit vector ``v`` around unit mean ``mu``."""
    kappa = F.lit(float(kappa)) if not isinstance(kappa, Column) else kappa
    value = kappa * dot(v, mu)
    if normalize:
        value = (value + (p / 2.0) * F.ln(kappa / (2 * math.pi)) - F.ln(kappa)
                 - log_bessel_i(p / 2.0 - 1.0, kappa))
    return value


def dp_size_logp(sizes, n: str, alpha: float, eps: float = 1e-6):
    """Symmetric Dirichlet log density of bounded cluster shares, clipped to ±300."""
    total = sizes.agg(F.sum(F.col(n) - alpha)).first()[0]
    share = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), (F.col(n) - alpha) / total))
    body = sizes.agg(F.sum((alpha - 1) * F.ln(share)).alias("_body"), F.count("*").alias("_dim"))
    density = F.expr(f"{lgamma_sql(f'{sql(alpha)} * _dim')} - _dim * {lgamma_sql(float(alpha))} + _body")
    return body.select(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), density)).alias("logp"))
