"""Document-level conditional scores for mixtures and multi-view clusterings.

A document's data term against cluster k splits into what an empty cluster would give,
one aggregate per document, and the gain from terms the two share, an equi join of two
sparse tables on the term. Sites meet clusters through the view they belong to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latent.functions.mathx import lgamma_col, lgamma_sql, log_bessel_i, polya_empty, polya_gain, sql
from latent.functions.sites import TERM, site_integer, site_uniform
from latent.operators.corpus import count_lists, dealt_by, from_lists, spread_join

NEW = -1


def _zero() -> Column:
    return F.lit(0).cast("long")


def view_cells(cells: DataFrame, term_views: DataFrame) -> DataFrame:
    """Cells with the view their term belongs to."""
    return cells.join(term_views.select("term", "view"), "term")


def cluster_terms(vcells: DataFrame, members: DataFrame) -> DataFrame:
    held = vcells.join(members.select("doc_id", "view", "cluster"), ["doc_id", "view"])
    return held.groupBy("view", "cluster", "term").agg(F.sum("n").alias("nw"))


def cluster_sizes(members: DataFrame, terms: DataFrame) -> DataFrame:
    """ndsum (members, with or without tokens) and nwsum per (view, cluster)."""
    sums = terms.groupBy("view", "cluster").agg(F.sum("nw").alias("nwsum"))
    sizes = members.groupBy("view", "cluster").agg(F.count("*").alias("ndsum"))
    return (sizes.join(sums, ["view", "cluster"], "left")
            .withColumn("nwsum", F.coalesce("nwsum", _zero())))


def sites_of(members: DataFrame, vcells: DataFrame) -> DataFrame:
    """(doc, view) sites with their present cluster (null when unplaced) and token count k."""
    k = vcells.groupBy("doc_id", "view").agg(F.sum("n").alias("k"))
    return (members.select("doc_id", "view", F.col("cluster").alias("home"))
            .join(k, ["doc_id", "view"], "left").withColumn("k", F.coalesce("k", _zero())))


def _is_home() -> Column:
    return F.coalesce(F.col("cluster") == F.col("home"), F.lit(False)).cast("long")


def _site_cells(sites: DataFrame, vcells: DataFrame) -> DataFrame:
    return vcells.join(sites.select("doc_id", "view", "home"), ["doc_id", "view"])


def shared_gain(sites: DataFrame, vcells: DataFrame, terms: DataFrame, gain: Column,
                hot=(), hot_docs=()) -> DataFrame:
    """Σ of ``gain`` over shared terms per (doc, view, cluster).

    ``gain`` is a column of the site's count ``n`` and the cluster's count without it, ``_rest``.
    A cell meets its term's clusters as lists, which are taken apart where a site's cells are together,
    so no row per (cell, cluster) is shuffled. Cells of ``hot_docs`` are together by parts.
    """
    mine = _site_cells(sites, vcells).select("doc_id", "view", "term", "home", "n")
    met = spread_join(mine, count_lists(terms, ["view", "term"], "cluster"), ["view", "term"], list(hot),
                      "term", "doc_id")
    return list_gain(met, ["doc_id", "view"], "cluster", "home", gain, hot_docs)


def list_gain(met: DataFrame, keys: list[str], of: str, home: str, gain: Column, hot_docs=()) -> DataFrame:
    """(keys, of, gain): Σ of ``gain`` over rows (doc_id, keys, term, n, home) that have met the counts of
    their term as lists. Their sums are made where the rows of ``keys`` are together."""
    dealt = dealt_by(met, keys, hot_docs, "term").drop("term")
    parts = [c for c in dealt.columns if c == "_part"]
    own = F.coalesce(F.col(of) == F.col(home), F.lit(False)).cast("long")
    gains = (from_lists(dealt, of).withColumn("_rest", F.col("nw") - own * F.col("n")).where(F.col("_rest") > 0)
             .groupBy(*keys, of, *parts).agg(F.sum(gain).alias("gain")))
    return gains.groupBy(*keys, of).agg(F.sum("gain").alias("gain")) if parts else gains


def _against(sites: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every site with each cluster of its view, the site's own share removed."""
    own = _is_home()
    return (sites.join(clusters, "view")
            .withColumn("ndsum", F.col("ndsum") - own)
            .withColumn("nwsum", F.col("nwsum") - own * F.col("k")))


def empty_data(sites: DataFrame, vcells: DataFrame, eta: float) -> DataFrame:
    """Σ_w of the term factors an empty cluster gives each site."""
    return (vcells.join(sites.select("doc_id", "view"), ["doc_id", "view"], "left_semi")
            .groupBy("doc_id", "view")
            .agg(F.sum(polya_empty(float(eta), "n")).alias("empty")))


def score_clusters(sites: DataFrame, vcells: DataFrame, terms: DataFrame, clusters: DataFrame,
                   alpha: float, eta: float, eta_sum: float, denominator: Column,
                   hot=()) -> DataFrame:
    """Existing clusters: ln ndsum¬ − ln denominator + Dirichlet-multinomial ratio.

    For the hard form the denominator is D − 1 + α; a cluster only the site itself holds is
    no candidate.
    """
    gain = shared_gain(sites, vcells, terms, polya_gain(float(eta), "_rest", "n"), hot)
    base = _against(sites, clusters).where(F.col("ndsum") > 0)
    lw = (F.ln("ndsum") - F.ln(denominator) + lgamma_col(f"{sql(eta_sum)} + nwsum")
          - lgamma_col(f"{sql(eta_sum)} + nwsum + k")
          + F.coalesce("empty", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)))
    return (base.join(gain, ["doc_id", "view", "cluster"], "left")
            .join(empty_data(sites, vcells, eta), ["doc_id", "view"], "left")
            .select("doc_id", "view", "cluster", lw.alias("log_weight")))


def open_views(clusters: DataFrame, kmax: int = -1, noise_view: bool = False) -> DataFrame:
    """Views that may still take a new cluster."""
    n = clusters.groupBy("view").agg(F.count("*").alias("_k"))
    if kmax >= 0:
        n = n.where(F.col("_k") < kmax)
    if noise_view:
        n = n.where(F.col("view") != 0)
    return n.select("view")


def score_new_cluster(sites: DataFrame, vcells: DataFrame, open_to: DataFrame, alpha: float,
                      eta: float, eta_sum: float, denominator: Column) -> DataFrame:
    """The new-cluster candidate: ln α − ln denominator + the ratio of an empty cluster."""
    lw = (F.lit(float(np.log(alpha))) - F.ln(denominator) + lgamma_col(float(eta_sum))
          - lgamma_col(f"{sql(eta_sum)} + k") + F.coalesce("empty", F.lit(0.0)))
    return (sites.join(open_to, "view", "left_semi")
            .join(empty_data(sites, vcells, eta), ["doc_id", "view"], "left")
            .select("doc_id", "view", F.lit(NEW).cast("long").alias("cluster"),
                    lw.alias("log_weight")))


def score_soft_clusters(sites: DataFrame, vcells: DataFrame, terms: DataFrame,
                        clusters: DataFrame, alpha: float, eta: float, eta_sum: float,
                        kmax: int = -1, noise_view: bool = False, hot=()) -> DataFrame:
    """Soft form: the denominator counts the view's documents, one site removed; sites
    without a token in the view are skipped; a document alone gets no new cluster."""
    held = clusters.groupBy("view").agg(F.sum("ndsum").alias("n_view"))
    sites = sites.where(F.col("k") > 0).join(held, "view")
    denominator = F.col("n_view") - 1 - 1 + alpha
    old = score_clusters(sites, vcells, terms, clusters, alpha, eta, eta_sum, denominator, hot)
    alone = (clusters.where(F.col("ndsum") == 1)
             .select("view", F.col("cluster").alias("home")))
    free = sites.join(alone, ["view", "home"], "left_anti")
    new = score_new_cluster(free, vcells, open_views(clusters, kmax, noise_view), alpha, eta,
                            eta_sum, denominator)
    return old.unionByName(new)


def plugin_gain(beta: float) -> Column:
    """What a term the cluster has adds to its plug-in weight, for ``shared_gain``."""
    return F.expr(f"n * (ln(_rest + {sql(beta)}) - ln({sql(beta)}))")


def score_mixture(sites: DataFrame, signal: DataFrame, terms: DataFrame, clusters: DataFrame,
                  prior: str, xi: float, k: int, alpha: float, beta: float, beta_sum: float,
                  n_docs: int, n_noise: int, hot=()) -> DataFrame:
    """Plug-in mixture scores under a finite, Dirichlet-process or uniform prior.

    ``signal`` holds the documents' signal cells, ``sites`` also the full length ``n_doc``.
    Only terms the cluster has add to the data term; the others cost ln β each.
    """
    gain = shared_gain(sites, signal, terms, plugin_gain(beta), hot)
    base = _against(sites, clusters)
    if prior == "dirichlet":
        weight = F.ln(xi + F.col("ndsum")) - F.ln(F.lit(k * xi + n_docs))
    elif prior == "dp":
        base = base.where(F.col("ndsum") > 0)
        weight = F.ln("ndsum") - F.ln(F.lit(n_docs - 1 + xi))
    else:
        weight = F.lit(0.0)
    lw = (weight + F.coalesce("gain", F.lit(0.0))
          + F.col("k") * (F.ln(F.lit(float(beta))) - F.ln(beta_sum + F.col("nwsum"))))
    if n_noise > 0:
        lw = lw + F.col("k") * (F.ln(F.lit(float(alpha)))
                                - F.ln((n_noise + 1) * alpha + F.col("n_doc")))
    scores = (base.join(gain, ["doc_id", "view", "cluster"], "left")
              .select("doc_id", "view", "cluster", lw.alias("log_weight")))
    if prior != "dp":
        return scores
    fresh = (F.lit(float(np.log(xi))) - F.ln(F.lit(n_docs - 1 + xi))
             + F.col("k") * (F.ln(F.lit(float(beta))) - F.ln(F.lit(float(beta_sum)))))
    return scores.unionByName(sites.select(
        "doc_id", "view", F.lit(NEW).cast("long").alias("cluster"), fresh.alias("log_weight")))


def _size_factor(eta_sum: float) -> Column:
    return F.expr(f"{lgamma_sql(float(eta_sum))} - {lgamma_sql(f'{sql(eta_sum)} + nwsum')}")


def score_feature_view(wanted: DataFrame, terms: DataFrame, clusters: DataFrame,
                       view_features: DataFrame, eta: float, eta_sum: float, xi: float,
                       n_terms: int, n_views: int) -> DataFrame:
    """Fit of each (term, view) of ``wanted``: evidence over the view's clusters plus prior.

    ``terms`` must hold the term's counts in that view's clusters. Clusters without the term
    add only their size factor, which is one number per view.
    """
    per_view = clusters.groupBy("view").agg(F.sum(
        _size_factor(eta_sum)).alias("norm"))
    own = (wanted.join(terms, ["term", "view"])
           .groupBy("term", "view")
           .agg(F.sum(polya_empty(float(eta), "nw")).alias("own")))
    prior = (F.ln(F.coalesce("features", _zero()) + xi) - F.ln(F.lit(n_terms + n_views * xi)))
    return (wanted.join(per_view, "view").join(view_features, "view", "left")
            .join(own, ["term", "view"], "left")
            .select("term", "view", (F.col("norm") + F.coalesce("own", F.lit(0.0)) + prior)
                    .alias("log_weight")))


def propose_views(term_views: DataFrame, n_views: int, rate: float, seed, it) -> DataFrame:
    """Terms that try another view this sweep, with a uniform target; same-view tries are void."""
    u = site_uniform(seed, it, "try", TERM)
    target = site_integer(n_views, seed, it, "target", TERM)
    return (term_views.where(u < rate).select("term", F.col("view").alias("old_view"),
                                              target.cast("long").alias("new_view"))
            .where(F.col("old_view") != F.col("new_view")))


def mh_accept_feature(proposals: DataFrame, cells: DataFrame, members: DataFrame,
                      terms: DataFrame, clusters: DataFrame, term_views: DataFrame, eta: float,
                      eta_sum: float, xi: float, n_terms: int, n_views: int, seed, it
                      ) -> DataFrame:
    """Proposals with their log ratio; ``accepted`` where ln u falls below it.

    Before: the term in its old view as it stands. After: the new view's clusters with the
    term's own counts added. Moving the term changes the size factor only of clusters that
    meet it, so both sides come from the term's counts per cluster.
    """
    features = term_views.groupBy("view").agg(F.count("*").alias("features"))
    before = score_feature_view(
        proposals.select("term", F.col("old_view").alias("view")), terms, clusters, features,
        eta, eta_sum, xi, n_terms, n_views).select("term", F.col("log_weight").alias("before"))
    placed = (cells.join(proposals.select("term", F.col("new_view").alias("view")), "term")
              .join(members.select("doc_id", "view", "cluster"), ["doc_id", "view"])
              .groupBy("term", "view", "cluster").agg(F.sum("n").alias("add")))
    delta = (placed.join(clusters, ["view", "cluster"]).groupBy("term", "view").agg(F.sum(
        polya_empty(float(eta), "add") + lgamma_col(f"{sql(eta_sum)} + nwsum")
        - lgamma_col(f"{sql(eta_sum)} + nwsum + add")).alias("delta")))
    norm = clusters.groupBy("view").agg(F.sum(
        _size_factor(eta_sum)).alias("norm"))
    prior = (F.ln(F.coalesce("features", _zero()) + 1 + xi) - F.ln(F.lit(n_terms + n_views * xi)))
    after = (proposals.select("term", F.col("new_view").alias("view"))
             .join(norm, "view").join(features, "view", "left")
             .join(delta, ["term", "view"], "left")
             .select("term", (F.col("norm") + F.coalesce("delta", F.lit(0.0)) + prior)
                     .alias("after")))
    u = site_uniform(seed, it, "accept", TERM)
    return (proposals.join(before, "term").join(after, "term")
            .withColumn("log_ratio", F.col("after") - F.col("before"))
            .withColumn("accepted", F.ln(F.greatest(u, F.lit(1e-300))) < F.col("log_ratio"))
            .drop("before", "after"))


def move_feature(term_views: DataFrame, accepted: DataFrame) -> DataFrame:
    """Relocate accepted terms; every count follows, being derived from this table."""
    to = accepted.where("accepted").select("term", F.col("new_view").alias("_to"))
    return (term_views.join(to, "term", "left")
            .withColumn("view", F.coalesce("_to", "view")).drop("_to"))


# Means and vectors meet in blocks of about so many rows each.
MEAN_BLOCK, VECTOR_BLOCK = 1024, 4096
# Fixed values of the mixer below: odd, under 2^31, so that products stay in 64 signed bits.
MIX = (1_640_531_527, 2_146_121_005, 1_566_083_941)


def pair_uniform(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A keyed uniform in (0, 1) for every pair of two columns of whole numbers."""
    word = 1 << 32

    def mixed(h):
        for shift, c in ((16, MIX[1]), (15, MIX[2])):
            h = (h ^ (h >> shift)) * c % word
        return h ^ (h >> 16)
    high = mixed((a[:, None] * MIX[0] % word + mixed(b % word)[None, :] + seed) % word)
    low = mixed((high + 1) % word)
    return (high * float(1 << 20) + low // 4096 + 0.5) / float(1 << 52)


def _blocked(vectors: DataFrame, members: DataFrame, weighted: DataFrame, kappa: float, p: int, keep,
             schema: str) -> DataFrame:
    """``keep(vec_ids, clusters, log_weights)`` of every block of vectors against every block of
    ``weighted`` (cluster, mu, w, w_own) means; blocks meet as groups, no row leaves the executors."""
    const = vectors.sparkSession.range(1).select(
        ((p / 2.0) * F.ln(F.lit(kappa / (2 * np.pi))) - F.ln(F.lit(float(kappa)))
         - log_bessel_i(p / 2.0 - 1.0, kappa)).alias("c")).first()[0]
    n_means = -(-weighted.count() // MEAN_BLOCK) or 1
    n_vectors = -(-vectors.count() // VECTOR_BLOCK) or 1

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = (vectors.join(members.select("vec_id", F.col("cluster").alias("home")), "vec_id", "left")
            .select("vec_id", "home", F.col("embedding").cast("array<double>").alias("embedding"),
                    F.pmod(F.xxhash64("vec_id"), F.lit(n_vectors)).alias("chunk"))
            .withColumn("block", every(n_means)))
    right = (weighted.withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(n_means)))
             .withColumn("chunk", every(n_vectors)))

    def meet(v: pa.Table, m: pa.Table) -> pa.Table:
        m = m.combine_chunks().sort_by("cluster")
        v = v.combine_chunks()
        ids, own = (c.to_numpy() for c in (m.column("cluster"), m.column("w_own").fill_null(-np.inf)))
        at = v.column("home").fill_null(-(2 ** 62)).to_numpy()
        x, mus = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(-1, p)
                  for t, c in ((v, "embedding"), (m, "mu")))
        lw = kappa * (x @ mus.T) + const + np.where(
            at[:, None] == ids[None, :], own[None, :], m.column("w").to_numpy()[None, :])
        return keep(v.column("vec_id").to_numpy(), ids, lw)
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(meet, schema)


def _weighted(members: DataFrame, means: DataFrame, alpha: float, n: int,
              fresh: np.ndarray | None) -> DataFrame:
    """Means with the log prior of a vector outside and, null if alone, of a member."""
    base = float(np.log(n - 1 + alpha))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    out = means.join(sizes, "cluster").select(
        F.col("cluster").cast("long").alias("cluster"), "mu", (F.ln("size") - base).alias("w"),
        F.when(F.col("size") > 1, F.ln(F.col("size") - 1) - base).alias("w_own"))
    if fresh is None:
        return out
    w = float(np.log(alpha / len(fresh)) - base)
    rows = [(-1 - i, [float(x) for x in mu], w, w) for i, mu in enumerate(fresh)]
    return out.unionByName(means.sparkSession.createDataFrame(
        rows, "cluster long, mu array<double>, w double, w_own double"))


def score_vmf(vectors: DataFrame, members: DataFrame, means: DataFrame, kappa: float,
              alpha: float, n: int, p: int, fresh: np.ndarray | None = None) -> DataFrame:
    """Spherical scores: ln size¬ − ln(D−1+α) + log density, over all clusters with members.

    Rows of ``fresh`` are auxiliary means, each weighted α/m, offered as clusters −1, −2, ….
    """
    def listed(vec_ids, ids, lw):
        i, j = np.nonzero(np.isfinite(lw))
        return pa.table({"vec_id": vec_ids[i], "cluster": ids[j], "log_weight": lw[i, j]})
    return _blocked(vectors, members, _weighted(members, means, alpha, n, fresh), kappa, p, listed,
                    "vec_id long, cluster long, log_weight double")


def draw_vmf(vectors: DataFrame, members: DataFrame, means: DataFrame, kappa: float, alpha: float,
             n: int, p: int, seed: int, fresh: np.ndarray | None = None) -> DataFrame:
    """(vec_id, cluster): a draw in proportion to ``score_vmf``, the best of log weight plus keyed
    Gumbel noise. A block gives one winner a vector; the winners of all blocks give the draw."""
    def winners(vec_ids, ids, lw):
        with np.errstate(invalid="ignore"):
            value = lw - np.log(-np.log(pair_uniform(vec_ids, ids, seed)))
        best = np.argmax(value, axis=1) if value.size else np.zeros(0, np.int64)
        some = np.flatnonzero(np.isfinite(value[np.arange(len(best)), best])) if value.size else best
        return pa.table({"vec_id": vec_ids[some], "cluster": ids[best[some]],
                         "value": value[some, best[some]]})
    each = _blocked(vectors, members, _weighted(members, means, alpha, n, fresh), kappa, p, winners,
                    "vec_id long, cluster long, value double")
    return each.groupBy("vec_id").agg(F.max(F.struct("value", "cluster")).alias("b")).select(
        "vec_id", F.col("b.cluster").alias("cluster"))
