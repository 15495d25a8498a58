"""Arrow kernels that score and draw a token's slot in one pass over a batch.

Spark does the joins that bring each token its counts; these functions only do the
arithmetic. Weights are plain products, so no logarithm is taken per candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf

from latent.functions.sites import draw_rows, draw_segments, flat, numbers


def _own(z: np.ndarray, k: int) -> np.ndarray:
    """One at each token's present slot; nothing for tokens not yet placed (z < 0)."""
    own = np.zeros((len(z), k))
    placed = np.flatnonzero(z >= 0)
    own[placed, z[placed]] = 1
    return own


def stick_weights(nd: np.ndarray, m: float, pi: float) -> np.ndarray:
    """Two-parameter stick-breaking weight of each level given a document's level counts.

    The last level takes what the stick has left, so the weights add up to one.
    """
    below = np.cumsum(nd[:, ::-1], axis=1)[:, ::-1]
    passed = (m * pi + below[:, 1:]) / (pi + below[:, :-1])
    reach = np.cumprod(np.hstack([np.ones((len(nd), 1)), passed]), axis=1)
    broken = (pi * (1 - m) + nd) / (pi + below) * reach
    broken[:, -1] = reach[:, -1]
    return broken


def flat_draw(k: int, alpha, eta_sum: float, totals=None, first: int = 0,
              stick: tuple[float, float] | None = None):
    """Draw among k slots: word part (eta+nw)/(Σeta+nwsum) times document part alpha+nd.

    ``totals`` holds nwsum when all documents share the same k nodes; otherwise it comes
    as a column. Slots below ``first`` are never drawn. ``stick`` = (m, π) replaces the
    document part by stick-breaking weights.
    """
    alpha = np.broadcast_to(np.asarray(alpha, dtype=float), (k,))
    shared = None if totals is None else np.asarray(totals, dtype=float)

    def weigh(nw, nwsum, nd, z, eta, u):
        own = _own(z, k)
        nd = nd - own
        doc = alpha + nd if stick is None else stick_weights(nd, *stick)
        w = (eta[:, None] + nw - own) / (eta_sum + nwsum - own) * doc
        if first:
            w[:, :first] = 0.0
        return pa.array(draw_rows(w, u))

    if shared is None:
        @arrow_udf("int")
        def draw(nw: pa.Array, nwsum: pa.Array, nd: pa.Array, z: pa.Array, eta: pa.Array,
                 u: pa.Array) -> pa.Array:
            return weigh(flat(nw, k), flat(nwsum, k), flat(nd, k), numbers(z), numbers(eta),
                         numbers(u))
    else:
        @arrow_udf("int")
        def draw(nw: pa.Array, nd: pa.Array, z: pa.Array, eta: pa.Array,
                 u: pa.Array) -> pa.Array:
            return weigh(flat(nw, k), shared, flat(nd, k), numbers(z), numbers(eta),
                         numbers(u))
    return draw


def list_draw(eta_sum: float, n_terms: int):
    """As ``flat_draw`` for documents with slot lists of their own length.

    A slot flagged ``reject`` gives every term the weight 1/V.
    """
    @arrow_udf("int")
    def draw(nw: pa.Array, nwsum: pa.Array, nd: pa.Array, alpha: pa.Array, reject: pa.Array,
             z: pa.Array, eta: pa.Array, u: pa.Array) -> pa.Array:
        offsets = nw.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        lengths = np.diff(offsets)
        at = numbers(z)
        own = np.zeros(offsets[-1])
        placed = np.flatnonzero(at >= 0)
        own[offsets[placed] + at[placed]] = 1
        each = [c.flatten().to_numpy(zero_copy_only=False) for c in (nw, nwsum, nd, alpha, reject)]
        word = ((np.repeat(numbers(eta), lengths) + each[0] - own)
                / (eta_sum + each[1] - own))
        word = np.where(each[4] > 0, 1.0 / n_terms, word)
        return pa.array(draw_segments(word * (each[3] + each[2] - own), offsets, numbers(u)))
    return draw


def log_draw():
    """Index drawn from a list of unnormalised log weights."""
    @arrow_udf("int")
    def draw(log_weights: pa.Array, u: pa.Array) -> pa.Array:
        offsets = log_weights.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        lw = log_weights.flatten().to_numpy(zero_copy_only=False)
        peak = np.maximum.reduceat(lw, offsets[:-1])
        return pa.array(draw_segments(np.exp(lw - np.repeat(peak, np.diff(offsets))), offsets,
                                      numbers(u)))
    return draw

