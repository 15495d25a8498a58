"""Several chains over a parameter grid."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.operators.corpus import Corpus
from latent.plans.loop import Fitted, Run


def grid(**values) -> list[dict]:
    """Every combination of the listed parameter values."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def run_chains(fit: Callable[..., Fitted], data: DataFrame | Corpus, settings: list[dict],
               seeds: list[int], run: Run = Run(), parallel: int = 2) -> list[Fitted]:
    """Fit every setting under every seed; chains run as concurrent jobs of one session.

    Chains are numbered in order and write under their own ``chain_id``. Given a built
    :class:`Corpus`, fits over plain cells (flat, tree, cross-cat, mixture, clustered) share it;
    given cells, each chain builds its own.
    """
    jobs = [(i, s, seed) for i, (s, seed) in enumerate(product(settings, seeds))]

    def one(job):
        chain, setting, seed = job
        return fit(data, run=replace(run, seed=seed, chain_id=chain), **setting)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(one, jobs))


def all_traces(chains: list[Fitted]) -> DataFrame:
    traces = [c.trace() for c in chains]
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t)
    return out


def best_chain(chains: list[Fitted]) -> Fitted:
    """The chain that reached the highest log-likelihood."""
    top = (all_traces(chains).groupBy("chain_id").agg(F.max("ll").alias("ll"))
           .orderBy(F.desc("ll"), "chain_id").first()["chain_id"])
    return next(c for c in chains if c.model.run.chain_id == top)
