"""The sampling loop every model shares.

A sweep visits each site once. Sites are split by hash into ``batches``; inside a
batch every site is scored with its own contribution removed and all else frozen,
and counts are taken afresh between batches. One site per batch is the sequential
sampler; fewer batches is the usual approximate distributed scheme.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.operators.corpus import Corpus
from latent.session import Workspace, short_shuffles, subfolders

State = dict[str, list[DataFrame]]


@dataclass(frozen=True)
class Run:
    """How long to sample and what to keep."""

    seed: int = 0
    batches: int = 4
    max_sweeps: int = 100
    interval: int = 2000
    sample_lag: int = 0
    out: str | None = None
    chain_id: int = 0
    save_best: bool = True


def whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class Model:
    """A model turns a corpus into state tables and moves them one sweep at a time."""

    kind = "model"
    learned_names: tuple[str, ...] = ()

    def __init__(self, corpus: Corpus | None, run: Run, workspace: Workspace, **hyper):
        self.corpus, self.run, self.ws, self.hyper = corpus, run, workspace, hyper

    def start(self) -> State:
        raise NotImplementedError

    def sweep(self, state: State, it: int) -> State:
        raise NotImplementedError

    def log_likelihood(self, state: State) -> float:
        raise NotImplementedError

    def tables(self, state: State) -> dict[str, DataFrame]:
        return {name: whole(parts) for name, parts in state.items()}

    def numbers(self, state: State) -> dict:
        """Further scalars for the trace row."""
        return {}

    def learned(self) -> dict[str, DataFrame]:
        """Tables beside the state that sampling has changed; saved and restored with it."""
        return {}

    def restore(self, learned: dict[str, DataFrame], numbers: dict) -> None:
        """Take up what :meth:`learned` and :meth:`numbers` gave when the state was saved."""

    def split(self, df: DataFrame, name: str) -> list[DataFrame]:
        """Materialise a table with a ``batch`` column as one part per batch."""
        return self.ws.split(df, name, "batch", self.run.batches)

    def each_batch(self, state: State, name: str,
                   step: Callable[[State, DataFrame, int], DataFrame]) -> State:
        """Replace the parts of one table in turn, each seeing the parts before it renewed."""
        for b in range(self.run.batches):
            part = state[name][b]
            renewed = self.ws.cut(step(state, part, b).select(*part.columns), f"{name}-{b}")
            parts = list(state[name])
            parts[b] = renewed
            state = {**state, name: parts}
        return state


@dataclass
class Fitted:
    model: Model
    state: State
    trace_rows: list[dict] = field(default_factory=list)
    best: State | None = None

    def tables(self, best: bool = False) -> dict[str, DataFrame]:
        state = self.best if best and self.best else self.state
        return self.model.tables(state)

    def trace(self) -> DataFrame:
        """One row per sweep with the hyperparameters it ran under."""
        schema = ("chain_id long, iter long, ll double, best_ll double, best_iter long, "
                  "numbers map<string,double>, hyper map<string,string>")
        hyper = {k: str(v) for k, v in self.model.hyper.items() if not hasattr(v, "sparkSession")}
        rows = [(r["chain_id"], r["iter"], r["ll"], r["best_ll"], r["best_iter"], r["numbers"],
                 hyper) for r in self.trace_rows]
        return self.model.ws.spark.createDataFrame(rows, schema)


def save_model(fitted: Fitted, state: State, kind: str, it: int) -> None:
    """Write each state table under out/<table>/chain_id=/kind=/iter=/."""
    run = fitted.model.run
    for name, df in {**fitted.model.tables(state), **fitted.model.learned()}.items():
        df.write.mode("overwrite").parquet(
            f"{run.out}/{name}/chain_id={run.chain_id}/kind={kind}/iter={it}")


def save_trace(fitted: Fitted) -> None:
    run = fitted.model.run
    if fitted.trace_rows:
        fitted.trace().coalesce(1).write.mode("overwrite").parquet(
            f"{run.out}/trace/chain_id={run.chain_id}")


def fit(model: Model, before: Fitted | None = None) -> Fitted:
    """Sweep until ``max_sweeps``, or until ``interval`` sweeps bring no new best.

    ``before`` is a fit to go on from: its last trace row belongs to its state.
    """
    run = model.run
    with short_shuffles(model.ws.spark):
        fitted = before or Fitted(model, model.start())
    state, rows = fitted.state, fitted.trace_rows
    first_iter = rows[-1]["iter"] if rows else 0
    best_ll = rows[-1]["best_ll"] if rows else None
    best_iter, kind, it = rows[-1]["best_iter"] if rows else 0, "last", first_iter
    for it in range(first_iter + bool(rows), first_iter + run.max_sweeps + 1):
        with short_shuffles(model.ws.spark):
            if it > first_iter:
                state = model.sweep(state, it)
            ll = model.log_likelihood(state)
        if best_ll is None or ll > best_ll:
            best_ll, best_iter, fitted.best = ll, it, state
            if run.out and run.save_best:
                save_model(fitted, state, "best", it)
        fitted.state = state
        fitted.trace_rows.append({
            "chain_id": run.chain_id, "iter": it, "ll": float(ll), "best_ll": float(best_ll),
            "best_iter": best_iter,
            "numbers": {k: float(v) for k, v in model.numbers(state).items()}})
        if run.out and run.sample_lag and it > first_iter and it % run.sample_lag == 0:
            save_model(fitted, state, f"sample-{it:05d}", it)
            save_trace(fitted)
        model.ws.retain([df for s in (state, fitted.best) for parts in s.values()
                         for df in parts])
        if it - best_iter >= run.interval:
            kind = "converged"
            break
    if run.out:
        save_model(fitted, state, kind, it)
        save_trace(fitted)
    return fitted


def load_state(model: Model, path: str, kind: str, it: int) -> State:
    spark = model.ws.spark
    state: State = {}
    for name in model.state_names:
        rows = spark.read.parquet(f"{path}/{name}").where(
            (F.col("chain_id") == model.run.chain_id) & F.col("kind").startswith(kind)
            & (F.col("iter") == it)).drop("chain_id", "kind", "iter")
        state[name] = (model.split(rows, name) if "batch" in rows.columns
                       else [model.ws.cut(rows, name)])
    return state


def resume(model: Model, path: str, kind: str = "last", it: int | None = None) -> Fitted:
    """Go on from saved state tables as if sampling had not stopped.

    The trace up to that sweep, the best state so far, and what the model has learned beside
    its state come back with it.
    """
    spark, chain = model.ws.spark, model.run.chain_id
    at = F.col("chain_id") == chain
    if it is None:
        it = spark.read.parquet(f"{path}/{model.state_names[0]}").where(
            at & F.col("kind").startswith(kind)).agg(F.max("iter")).first()[0]
    trace = (spark.read.parquet(f"{path}/trace").where(at & (F.col("iter") <= it))
             .orderBy("iter").collect())
    names = ("chain_id", "iter", "ll", "best_ll", "best_iter", "numbers")
    rows = [{n: r[n] for n in names} for r in trace]
    if not rows or rows[-1]["iter"] != it:
        raise ValueError(f"no trace row of sweep {it} for chain {chain} under {path}")
    learned = {}
    for name in model.learned_names:
        if name in subfolders(spark, path):
            table = spark.read.parquet(f"{path}/{name}").where(
                at & F.col("kind").startswith(kind) & (F.col("iter") == it))
            if not table.isEmpty():
                learned[name] = model.ws.cut(table.drop("chain_id", "kind", "iter"), name, pin=True)
    model.restore(learned, rows[-1]["numbers"])
    before = Fitted(model, load_state(model, path, kind, int(it)), rows)
    best = rows[-1]["best_iter"]
    if best != it and model.run.save_best:
        before.best = load_state(model, path, "best", int(best))
    else:
        before.best = before.state
    return fit(model, before)
