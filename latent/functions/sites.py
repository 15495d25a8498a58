"""Keyed random draws.

Every random number is a hash of the seed and the keys of the thing being drawn, so
a draw does not depend on partitioning, retries or row order and can be replayed in
plain SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MANTISSA = 16 ** 13


class Key(str):
    """Name of a column whose value takes part in a draw's key."""


DOC, TERM, POS = Key("doc_id"), Key("term"), Key("pos")


def uniform_sql(*keys) -> str:
    parts = [f"CAST({k} AS STRING)" if isinstance(k, Key) else "'" + str(k).replace("'", "\\'") + "'"
             for k in keys]
    return (f"(CAST(conv(substring(md5(concat_ws('|', {', '.join(parts)})), 1, 13), 16, 10) AS BIGINT)"
            f" / {float(MANTISSA)!r}D)")


def site_uniform(*keys) -> Column:
    """Uniform in [0, 1) from 52 bits of the md5 of the joined keys, columns or constants."""
    return F.expr(uniform_sql(*keys))


def site_integer(n, *keys) -> Column:
    return F.expr(f"CAST(floor({uniform_sql(*keys)} * {n}) AS INT)")


def site_gaussian(*keys) -> Column:
    """Standard normal by Box-Muller; the first uniform is flipped into (0, 1]."""
    return F.expr(f"sqrt(-2D * ln(1D - {uniform_sql(*keys, 'a')}))"
                  f" * cos({2 * math.pi!r}D * {uniform_sql(*keys, 'b')})")


def sample_site(scores: DataFrame, keys: list[str], candidate: str, u: Column,
                log_weight: str = "log_weight") -> DataFrame:
    """Inverse-CDF draw of one candidate per site from unnormalised log weights.

    Candidates are laid out in candidate order and the one whose interval holds
    ``u`` is kept, with its normalised probability. A window partition holds one
    site's candidates, never a site's data.
    """
    by = ", ".join(keys)
    upto = f"PARTITION BY {by} ORDER BY {candidate}"
    return (scores.withColumn("_u", u)
            .selectExpr(*keys, candidate, "_u", f"exp({log_weight} - max({log_weight}) OVER "
                        f"(PARTITION BY {by})) AS _w")
            .selectExpr("*", f"sum(_w) OVER ({upto} ROWS UNBOUNDED PRECEDING) AS _cum")
            .selectExpr("*", f"max(_cum) OVER (PARTITION BY {by}) AS _tot",
                        f"lag(_cum, 1, 0D) OVER ({upto}) AS _from")
            .where("_from <= _u * _tot AND _u * _tot < _cum")
            .selectExpr(*keys, candidate, "_w / _tot AS chosen_probability"))


def chosen_probability(scores: DataFrame, keys: list[str], log_weight: str = "log_weight",
                       out: str = "p") -> DataFrame:
    """Normalised probability of every candidate of a site."""
    site = Window.partitionBy(*keys)
    w = F.exp(F.col(log_weight) - F.max(log_weight).over(site))
    return (scores.withColumn("_w", w)
            .withColumn(out, F.col("_w") / F.sum("_w").over(site)).drop("_w"))


def draw_rows(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Column index per row of a weight matrix, by inverse CDF."""
    cum = np.cumsum(weights, axis=1)
    picked = (cum <= (u * cum[:, -1])[:, None]).sum(axis=1)
    return np.minimum(picked, weights.shape[1] - 1).astype(np.int32)


def draw_segments(weights: np.ndarray, offsets: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As ``draw_rows`` for rows of unequal length laid end to end."""
    lengths = np.diff(offsets)
    starts = offsets[:-1]
    share = weights / np.repeat(np.add.reduceat(weights, starts), lengths)
    cum = np.cumsum(share)
    before = cum[starts] - share[starts]
    upto = cum[offsets[1:] - 1]
    picked = np.searchsorted(cum, before + u * (upto - before), side="right") - starts
    return np.clip(picked, 0, lengths - 1).astype(np.int32)


def flat(column: pa.Array, k: int) -> np.ndarray:
    """A list column of constant length k as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
