"""Spherical Dirichlet-process mixture of unit vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from latent.functions.mathx import dp_size_logp, l2_normalize, vmf_logp
from latent.functions.sites import Key, flat, site_integer, site_uniform
from latent.operators.clusters import draw_vmf
from latent.operators.corpus import batch_of
from latent.operators.windows import tune_proposal
from latent.plans.loop import Fitted, Model, Run, State, fit, whole
from latent.plans.rounds import fresh_id
from latent.session import Workspace

AUXILIARY = 4


def keyed_normals(keys, p: int) -> np.ndarray:
    """Standard normal rows, each from a generator seeded by its own key."""
    rows = [np.random.Generator(np.random.Philox(int.from_bytes(
        hashlib.md5(str(k).encode()).digest(), "little"))).standard_normal(p) for k in keys]
    return np.array(rows).reshape(-1, p)


def on_sphere(x: np.ndarray, positive: bool) -> np.ndarray:
    x = np.maximum(x, 0.0) if positive else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cluster_vector_sums(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Sum of member vectors per cluster, one partial sum per coordinate."""
    each = (vectors.join(members.select("vec_id", "cluster"), "vec_id")
            .select("cluster", F.posexplode("embedding").alias("i", "x")))
    return (each.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
            .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
            .select("cluster", F.col("s.x").alias("total")))


class VMF(Model):
    """State: members (vec_id, cluster) and means (cluster, mu)."""

    kind = "vmf"
    state_names = ("members", "means")

    def __init__(self, vectors: DataFrame, run: Run, workspace: Workspace, k: int = 10,
                 kappa: float = 20.0, xi: float = 1.0, alpha: float = 1.0, restrict: bool = False,
                 tune_interval: int = 10):
        super().__init__(None, run, workspace, k=k, kappa=kappa, xi=xi, alpha=alpha,
                         restrict=restrict, tune_interval=tune_interval)
        self.k, self.kappa, self.xi, self.alpha = k, kappa, xi, alpha
        self.restrict, self.tune_interval = restrict, tune_interval
        self.vectors = workspace.cut(vectors.select("vec_id", l2_normalize("embedding")
                                                    .alias("embedding")), "vectors", pin=True)
        head = self.vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
        self.n, self.p = head[0], head[1]
        self.center = np.full(self.p, 1 / np.sqrt(self.p))
        self.scale, self.tried, self.kept = 1.0, 0, 0

    def prior_means(self, keys: list) -> np.ndarray:
        """Means drawn around the prior direction, then moved by one random-walk step."""
        base = on_sphere(self.center + self.xi * keyed_normals([f"{k}|p" for k in keys], self.p),
                         False)
        return on_sphere(base + self.scale * keyed_normals([f"{k}|s" for k in keys], self.p),
                         self.restrict)

    def mean_table(self, ids, mus: np.ndarray) -> DataFrame:
        rows = [(int(i), [float(x) for x in m]) for i, m in zip(ids, mus)]
        return self.ws.spark.createDataFrame(rows, "cluster long, mu array<double>")

    def start(self) -> State:
        run = self.run
        members = self.vectors.select(
            "vec_id", site_integer(self.k, run.seed, "init", Key("vec_id")).cast("long")
            .alias("cluster"), batch_of(run.batches, run.seed, Key("vec_id")).alias("batch"))
        means = self.mean_table(range(self.k), self.prior_means(
            [f"{run.seed}|init|{i}" for i in range(self.k)]))
        parts = self.split(members, "members")
        live = means.join(whole(parts).select("cluster").distinct(), "cluster", "left_semi")
        return {"members": parts, "means": [self.ws.cut(live, "means")]}

    def sweep(self, state: State, it: int) -> State:
        seed = self.run.seed
        if it % self.tune_interval == 0 and self.tried:
            self.scale = self.ws.spark.range(1).select(tune_proposal(
                F.lit(self.scale), F.lit(self.kept / self.tried))).first()[0]
            self.tried = self.kept = 0
        for b in range(self.run.batches):
            members, means = whole(state["members"]), state["means"][0]
            part = state["members"][b]
            fresh = self.prior_means([f"{seed}|{it}|{b}|{j}" for j in range(AUXILIARY)])
            mine = self.vectors.join(part.select("vec_id"), "vec_id", "left_semi")
            drawn = draw_vmf(mine, members, means, self.kappa, self.alpha, self.n, self.p,
                             (seed * 1_000_003 + it * 1009 + b) % (1 << 32), fresh)
            new_id = F.lit(fresh_id(it, b, 0)) - 1 - F.col("cluster")
            to = F.when(F.col("cluster") < 0, new_id).otherwise(F.col("cluster"))
            moved = self.ws.cut(part.join(
                drawn.select("vec_id", to.alias("_to")), "vec_id", "left").withColumn(
                "cluster", F.coalesce("_to", "cluster")).select(*part.columns), f"members-{b}")
            parts = list(state["members"])
            parts[b] = moved
            added = self.mean_table([fresh_id(it, b, 0) + j for j in range(AUXILIARY)], fresh)
            live = whole(parts).select("cluster").distinct()
            means = self.ws.cut(means.unionByName(added).join(live, "cluster", "left_semi"),
                                "means")
            state = {"members": parts, "means": [means]}
        return self.move_means(state, it)

    def move_means(self, state: State, it: int) -> State:
        """A Metropolis step for every mean: prior ξ·centerᵀφ plus κ·φᵀ(sum of its vectors)."""
        p, kappa, xi, scale = self.p, self.kappa, self.xi, self.scale
        center, restrict, seed = self.center, self.restrict, self.run.seed

        @arrow_udf("struct<mu:array<double>,kept:boolean>")
        def step(cluster: pa.Array, mu: pa.Array, total: pa.Array, u: pa.Array) -> pa.Array:
            old, sums = flat(mu, p), flat(total, p)
            keys = [f"{seed}|{it}|mean|{c}" for c in cluster.to_pylist()]
            new = on_sphere(old + scale * keyed_normals(keys, p), restrict)
            gain = ((new - old) @ center) * xi + kappa * np.einsum("ij,ij->i", new - old, sums)
            kept = np.log(np.maximum(u.to_numpy(zero_copy_only=False), 1e-300)) <= gain
            mus = np.where(kept[:, None], new, old)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, mus.size + 1, p, dtype=np.int32)), pa.array(mus.ravel()))
            return pa.StructArray.from_arrays([lists, pa.array(kept)], ["mu", "kept"])

        sums = cluster_vector_sums(self.vectors, whole(state["members"]))
        u = site_uniform(seed, it, "mean-accept", Key("cluster"))
        moved = self.ws.cut(state["means"][0].join(sums, "cluster")
                            .select("cluster", step("cluster", "mu", "total", u).alias("s"))
                            .select("cluster", "s.mu", "s.kept"), "moved")
        n, kept = moved.agg(F.count("*"), F.count_if("kept")).first()
        self.tried, self.kept = self.tried + n, self.kept + kept
        return {**state, "means": [self.ws.cut(moved.drop("kept"), "means")]}

    def restore(self, learned, numbers):
        self.scale = numbers["scale"]
        self.tried, self.kept = int(numbers["tried"]), int(numbers["kept"])

    def log_likelihood(self, state: State) -> float:
        return ll_vmf(self.vectors, whole(state["members"]), state["means"][0], self.kappa,
                      self.p, self.alpha)

    def numbers(self, state: State) -> dict:
        return {"clusters": state["means"][0].count(), "scale": self.scale,
                "tried": self.tried, "kept": self.kept}


def ll_vmf(vectors: DataFrame, members: DataFrame, means: DataFrame, kappa: float, p: int,
           alpha: float) -> float:
    """Log density of every vector around its cluster's mean, plus the size density."""
    placed = vectors.join(members.select("vec_id", "cluster"), "vec_id").join(means, "cluster")
    data = placed.agg(F.sum(vmf_logp(F.col("embedding"), F.col("mu"), kappa, p))).first()[0]
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return data + dp_size_logp(sizes, "n", alpha).first()[0]


def fit_vmf_dp(vectors: DataFrame, run: Run = Run(), **hyper) -> Fitted:
    """Cluster ``vectors(vec_id, embedding)`` on the sphere; ``hyper`` as in :class:`VMF`."""
    ws = Workspace(vectors.sparkSession)
    return fit(VMF(vectors, run, ws, **hyper))
