"""Ranked and running views of count tables and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


# Fixed values: (acceptance rate, factor); the first band that applies wins.
TOO_LOW = ((0.001, 0.1), (0.05, 0.5), (0.2, 0.9))
TOO_HIGH = ((0.95, 10.0), (0.75, 2.0), (0.5, 1.1))


def top_terms(node_terms: DataFrame, k: int = 10, node: str = "node_id") -> DataFrame:
    """The k heaviest terms per node; equal counts rank by term."""
    order = Window.partitionBy(node).orderBy(F.desc("n"), "term")
    return (node_terms.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select(node, "rank", "term", "n"))


def top_term_pairs(node_terms: DataFrame, k: int = 10) -> DataFrame:
    """Distinct pairs among each node's top k: at most k(k−1)/2 per node."""
    listed = (top_terms(node_terms, k).groupBy("node_id")
              .agg(F.sort_array(F.collect_list("term")).alias("t")))
    first = listed.select("t", F.posexplode("t").alias("i", "w1"))
    rest = F.slice("t", F.col("i") + 2, F.greatest(F.lit(0), F.size("t") - F.col("i") - 1))
    return first.select("w1", F.explode(rest).alias("w2")).distinct()


def build_sort(dist: DataFrame, concept: str, entry: str, to_show: int = 100) -> DataFrame:
    """Concept total with its heaviest entries, heaviest first."""
    order = Window.partitionBy(concept).orderBy(F.desc("n"), entry)
    ranked = dist.withColumn("rank", F.row_number().over(order))
    totals = dist.groupBy(concept).agg(F.sum("n").alias("total"))
    shown = (ranked.where(F.col("rank") <= to_show).groupBy(concept)
             .agg(F.sort_array(F.collect_list(F.struct("rank", entry, "n"))).alias("top"))
             .select(concept, F.transform("top", lambda r: F.concat_ws(" ", r[entry], r["n"]))
                     .alias("entries")))
    return totals.join(shown, concept)


def _below(*keys: str):
    return (Window.partitionBy(*keys).orderBy(F.desc("level"))
            .rowsBetween(Window.unboundedPreceding, 0))


def tokens_at_or_below(doc_levels: DataFrame) -> DataFrame:
    """A_l: the document's tokens at level l or deeper."""
    return doc_levels.withColumn("at_or_below", F.sum("n").over(_below("doc_id")))


def gem_stick_prefix(doc_levels: DataFrame, m: float, pi: float) -> DataFrame:
    """Running Σ_{j<l} ln((mπ + A_{j+1}) / (π + A_j)) over levels, with A_l."""
    by_level = Window.partitionBy("doc_id").orderBy("level")
    prev = F.lag("at_or_below").over(by_level)
    step = F.coalesce(F.ln((m * pi + F.col("at_or_below")) / (pi + prev)), F.lit(0.0))
    running = by_level.rowsBetween(Window.unboundedPreceding, 0)
    return (tokens_at_or_below(doc_levels).withColumn("_step", step)
            .withColumn("stick", F.sum("_step").over(running)).drop("_step"))


def best_so_far(trace: DataFrame, keys: list[str], iter_col: str = "iter") -> DataFrame:
    """Running best log-likelihood and the sweep that set it; the first sweep is always best."""
    seen = (Window.partitionBy(*keys).orderBy(iter_col)
            .rowsBetween(Window.unboundedPreceding, 0))
    prev_best = F.max("ll").over(Window.partitionBy(*keys).orderBy(iter_col)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    marked = (trace.withColumn("_prev", prev_best)
              .withColumn("is_best", F.col("_prev").isNull() | (F.col("ll") > F.col("_prev"))))
    return (marked.withColumn("best_ll", F.max("ll").over(seen))
            .withColumn("best_iter", F.max(F.when(F.col("is_best"), F.col(iter_col))).over(seen))
            .drop("_prev"))


def converged(trace: DataFrame, keys: list[str], interval: int,
              iter_col: str = "iter") -> DataFrame:
    """Marks sweeps at which ``interval`` sweeps have passed without a new best."""
    return (best_so_far(trace, keys, iter_col)
            .withColumn("converged", F.col(iter_col) - F.col("best_iter") >= interval))


def select_samples(samples: DataFrame, mode: str, keep: int = 20) -> DataFrame:
    """``map`` keeps the best states, ``bayes`` the periodic ones; per chain the last ``keep``."""
    kind = {"map": "best", "bayes": "sample"}[mode]
    newest = Window.partitionBy("chain_id").orderBy(F.desc("iter"))
    return (samples.where(F.col("kind") == kind)
            .withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") <= keep).drop("_rank"))


def tune_proposal(scale, accept_rate) -> Column:
    """Rescale a random-walk step by its acceptance band; steps start no larger than 10000."""
    step = F.least(scale, F.lit(10000.0))
    factor = F.lit(1.0)
    for bound, f in reversed(TOO_LOW):
        factor = F.when(accept_rate < bound, F.lit(f)).otherwise(factor)
    for bound, f in reversed(TOO_HIGH):
        factor = F.when(accept_rate > bound, F.lit(f)).otherwise(factor)
    return step * factor


def move_rates(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of sites whose assignment changed."""
    old = before.select(*keys, F.col(value).alias("_old"))
    moved = (F.col(value) != F.col("_old")).cast("long")
    return (after.select(*keys, value).join(old, keys)
            .agg(F.count("*").alias("proposed"), F.sum(moved).alias("moved")))
