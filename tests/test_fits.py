import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, site_integer
from latent.operators.corpus import Corpus, expand_tokens
from latent.operators.counts import path_doc_counts
from latent.operators.paths import tree_is_consistent
from latent.operators.structure import sense_paths
from latent.plans import chains, crosscat, labeled, lda, mixture, ncrp, vmf
from latent.plans.loop import Run, fit, resume, whole
from latent.session import Workspace
from latent.streaming import fold

RUN = Run(seed=1, batches=2, max_sweeps=2)


def lls(fitted):
    return [r["ll"] for r in fitted.trace_rows]


def same_cluster_share(members):
    """Largest-cluster share of each planted half, and whether the halves are apart."""
    rows = members.groupBy((F.col("doc_id") % 2).alias("half"), "cluster").count().collect()
    return {(r["half"], r["cluster"]): r["count"] for r in rows}


def test_lda_keeps_tokens_and_ignores_partitioning(spark, planted, tmp_path):
    a = lda.fit_lda(planted, 2, run=RUN)
    b = lda.fit_lda(planted.repartition(5).orderBy(F.desc("term")), 2, run=RUN)
    ta, tb = a.tables()["tokens"], b.tables()["tokens"]
    key = ["doc_id", "term", "pos", "z"]
    assert sorted(map(tuple, ta.select(key).collect())) == sorted(map(tuple, tb.select(key).collect()))
    assert ta.count() == planted.agg(F.sum("n")).first()[0]
    assert lls(a)[-1] > lls(a)[0]


def test_lda_sweep_equals_plain_python(spark):
    """One site per batch is the sequential sampler."""
    cells = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "b", 1), (1, "c", 1)],
                                  "doc_id long, term string, n long")
    ws, k, alpha, eta = Workspace(spark), 2, 0.3, 0.2
    start = expand_tokens(cells).withColumn("z", site_integer(k, 19, "init", DOC, TERM, POS))
    run = Run(seed=19, batches=4)
    model = lda.LDA(Corpus.build(ws, cells), run, ws, k, alpha, eta, preassigned=start)
    state = model.start()
    rows = [r for part in state["tokens"] for r in part.collect()]
    assert len({r["batch"] for r in rows}) == 4
    z = {(r["doc_id"], r["term"]): r["z"] for r in rows}
    from hashlib import md5
    for r in sorted(rows, key=lambda r: r["batch"]):
        site = (r["doc_id"], r["term"])
        rest = {s: t for s, t in z.items() if s != site}
        w = []
        for t in range(k):
            nw = sum(1 for s, x in rest.items() if x == t and s[1] == site[1])
            n = sum(1 for x in rest.values() if x == t)
            nd = sum(1 for s, x in rest.items() if x == t and s[0] == site[0])
            w.append((eta + nw) / (3 * eta + n) * (alpha + nd))
        u = int(md5(f"19|1|z|{site[0]}|{site[1]}|1".encode()).hexdigest()[:13], 16) / 16 ** 13
        z[site] = 0 if u * sum(w) < w[0] else 1
    got = {(r["doc_id"], r["term"]): r["z"] for r in whole(model.sweep(state, 1)["tokens"]).collect()}
    assert got == z


def test_labeled_stays_in_its_lists(spark, planted):
    topics = planted.select("doc_id").distinct().where("doc_id < 12").select("doc_id", F.explode(
        F.array(F.lit("all"), F.concat(F.lit("t"), F.col("doc_id") % 2))).alias("topic"))
    f = labeled.fit_labeled_lda(planted, topics, noise=1, run=RUN, learn=True)
    tables = f.tables()
    held = tables["tokens"].join(tables["doc_topics"].withColumnRenamed("slot", "z"), ["doc_id", "z"])
    assert held.count() == tables["tokens"].count() == planted.where("doc_id < 12").agg(
        F.sum("n")).first()[0]
    assert lls(f)[-1] > lls(f)[0]


def test_tree_state_stays_consistent(spark, planted):
    f = ncrp.fit_ncrp(planted, 3, run=RUN, max_branches=2)
    t = f.tables()
    paths = t["paths"]
    links = paths.where("parent_id is not null").select("parent_id", F.col("node_id").alias("child_id"))
    total = planted.agg(F.sum("n")).first()[0]
    assert tree_is_consistent(t["tokens"], paths, links.distinct(), path_doc_counts(paths),
                              total).isEmpty()
    fan = paths.groupBy("parent_id").agg(F.count_distinct("node_id").alias("n")).agg(F.max("n"))
    assert fan.first()[0] <= 2
    assert lls(f)[-1] > lls(f)[0]


def test_dp_mixture_separates_planted_halves(spark, planted):
    f = ncrp.fit_dp_mixture(planted, run=RUN)
    leaves = f.tables()["paths"].where("level = 1").select("doc_id", F.col("node_id").alias("cluster"))
    shares = same_cluster_share(leaves)
    assert not {c for h, c in shares if h == 0} & {c for h, c in shares if h == 1}
    assert f.tables()["tokens"].where("z = 0").isEmpty()


def test_crosscat_keeps_sites_and_cap(spark, planted, tmp_path):
    run = Run(seed=2, batches=2, max_sweeps=1, out=str(tmp_path / "cc"), sample_lag=1)
    f = crosscat.fit_crosscat(planted, 2, run=run, kmax=3, noise_view=True)
    members = f.tables()["members"]
    assert members.count() == 32
    k = {r["view"]: r["n"] for r in members.groupBy("view").agg(
        F.count_distinct("cluster").alias("n")).collect()}
    assert k[0] == 1 and k[1] <= 3
    ws = Workspace(spark)
    model = crosscat.CrossCat(Corpus.build(ws, planted), Run(seed=2, batches=2, max_sweeps=0), ws, 2,
                              kmax=3, noise_view=True)
    again = resume(model, str(tmp_path / "cc"), "last")
    assert [r["iter"] for r in again.trace_rows] == [0, 1] and lls(again) == lls(f)


def test_resume_goes_on_like_an_unbroken_run(spark, planted, tmp_path):
    def soft(sweeps):
        ws = Workspace(spark)
        return crosscat.SoftCrossCat(Corpus.build(ws, planted.withColumn("n", F.lit(1).cast("long"))), Run(
            seed=2, batches=1, max_sweeps=sweeps, out=str(tmp_path / f"soft{sweeps}")), ws, 2)

    whole_run, first = fit(soft(2)), fit(soft(1))
    model = soft(1)
    model.run = replace(model.run, max_sweeps=1)
    again = resume(model, str(tmp_path / "soft1"))
    assert [r["iter"] for r in again.trace_rows] == [0, 1, 2]
    assert all(math.isclose(a, b) for a, b in zip(lls(again), lls(whole_run), strict=True))
    assert again.trace_rows[-1]["best_iter"] == whole_run.trace_rows[-1]["best_iter"]
    assert lls(first) == lls(again)[:2]
    saved = spark.read.parquet(str(tmp_path / "soft1" / "trace")).orderBy("iter").collect()
    assert [r["iter"] for r in saved] == [0, 1, 2]


def test_a_batch_founds_many_clusters(spark):
    """Documents without a common term: with a large gamma each wants a cluster of its own."""
    rows = [(d, f"w{d}", 6) for d in range(24)]
    cells = spark.createDataFrame(rows, "doc_id long, term string, n long")
    f = ncrp.fit_dp_mixture(cells, run=Run(seed=1, batches=1, max_sweeps=1), gamma=1000.0)
    assert f.tables()["paths"].where("level = 1").select("node_id").distinct().count() > 12


def test_idle_senses_are_redrawn(spark, planted):
    """Levels of senses that were not chosen move as well, so they can win later."""
    docs = planted.select("doc_id").distinct().select("doc_id", F.lit("leaf").alias("node"))
    edges = spark.createDataFrame([("leaf", "x"), ("leaf", "y"), ("x", "root"), ("y", "root")],
                                  "child string, parent string")
    ws = Workspace(spark)
    model = labeled.SenseSelection(Corpus.build(ws, planted), Run(seed=1, batches=2), ws,
                                   sense_paths(docs, edges, ws))
    state, seen = model.start(), []
    for it in (0, 1, 2):
        state = model.sweep(state, it) if it else state
        levels = {(r["doc_id"], r["sense"], r["term"], r["pos"]): r["z"]
                  for r in whole(state["tokens"]).collect()}
        seen.append((levels, dict(whole(state["chosen"]).select("doc_id", "sense").collect())))
    (_, first), (before, second), (after, third) = seen
    assert before.keys() == after.keys() and len(third) == 16
    moved = [k for k in after if before[k] != after[k] and third[k[0]] != k[1] == 1 - second[k[0]]]
    kept = [d for d in second if second[d] == third[d]]
    assert moved or not kept


@pytest.mark.parametrize("implementation", ["normal", "marginal"])
def test_soft_crosscat_keeps_tokens(spark, planted, implementation):
    f = crosscat.fit_soft_crosscat(planted, 2, run=Run(seed=2, batches=1, max_sweeps=1),
                                   implementation=implementation)
    assert f.tables()["tokens"].count() == planted.count()
    assert f.tables()["members"].count() == 32


def test_mixture_climbs_and_keeps_documents(spark, planted):
    f = mixture.fit_mixture(planted, "dirichlet", 2, 1, run=Run(seed=1, batches=2, max_sweeps=1))
    assert lls(f)[-1] > lls(f)[0]
    f = mixture.fit_mixture(planted, "dp", 3, 0, run=Run(seed=1, batches=1, max_sweeps=1))
    shares = same_cluster_share(f.tables()["members"])
    assert sum(shares.values()) == 16


def test_clustered_respects_types(spark, planted):
    features = spark.createDataFrame(
        [("a", "v", "f", 1), ("b", "v", "f", 1), ("c", "n", "g", 2), ("c", "n", "h", 1)],
        "word string, type string, feature string, n long")
    f = mixture.fit_clustered_lda(planted, features, 2, 2, run=RUN, type_dependent=True)
    t = f.tables()["tokens"]
    assert t.where("term = 'd'").isEmpty()
    assert t.where("(term = 'c') != startswith(cluster, 'n/')").isEmpty()


def test_vmf_finds_planted_directions(spark):
    rows = [(i, [5.0 if j == i % 2 else 0.1 * ((i + j) % 3) for j in range(4)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    f = vmf.fit_vmf_dp(vectors, run=Run(seed=1, batches=2, max_sweeps=3), k=3, kappa=30.0)
    assert f.tables()["members"].count() == 20
    assert lls(f)[-1] > lls(f)[0]


def test_sense_selection_picks_one_sense(spark, planted):
    docs = planted.select("doc_id").distinct().select("doc_id", F.concat(F.lit("d"), "doc_id")
                                                      .alias("node"))
    edges = docs.select(F.col("node").alias("child"), F.explode(F.array(F.lit("x"), F.lit("y")))
                        .alias("parent")).unionByName(spark.createDataFrame(
                            [("x", "root"), ("y", "root")], "child string, parent string"))
    f = labeled.fit_sense_selection(planted, docs, edges, run=Run(seed=1, batches=1, max_sweeps=1))
    chosen = f.tables()["chosen"]
    assert chosen.count() == 16 and chosen.where("sense not in (0, 1)").isEmpty()
    assert f.tables()["tokens"].count() == 2 * planted.agg(F.sum("n")).first()[0]


def test_chains_and_saved_states(spark, planted, tmp_path):
    run = Run(batches=1, max_sweeps=1, out=str(tmp_path / "grid"))
    done = chains.run_chains(lda.fit_lda, planted, chains.grid(k=[2], alpha=[0.1, 0.5]), [7], run)
    assert [c.model.run.chain_id for c in done] == [0, 1]
    assert chains.all_traces(done).count() == 4
    assert chains.best_chain(done) in done
    saved = spark.read.parquet(str(tmp_path / "grid" / "tokens"))
    assert {r[0] for r in saved.select("kind").distinct().collect()} >= {"best", "last"}


def test_chains_share_one_corpus(spark, planted, monkeypatch):
    """Each chain equals its single run over cells, and no chain writes the corpus again."""
    ws, run = Workspace(spark), Run(batches=1, max_sweeps=2)
    corpus = Corpus.build(ws, planted)
    cuts, cut = [], Workspace.cut
    monkeypatch.setattr(Workspace, "cut", lambda self, df, name, pin=False: (
        cuts.append(name), cut(self, df, name, pin))[1])
    done = chains.run_chains(lda.fit_lda, corpus, chains.grid(k=[2, 3]), [7, 8], run)
    assert not {"cells", "vocab", "docs"} & set(cuts)
    for chain, (k, seed) in zip(done, [(2, 7), (2, 8), (3, 7), (3, 8)], strict=True):
        alone = lda.fit_lda(planted, k, run=Run(seed=seed, batches=1, max_sweeps=2))
        assert np.allclose(lls(chain), lls(alone))
        one, other = (sorted(map(tuple, f.tables()["tokens"].select("doc_id", "term", "pos", "z").collect()))
                      for f in (chain, alone))
        assert one == other
    assert corpus.cells.count() == planted.count()


def test_window_fit_evicts_and_replays(spark, tmp_path):
    model = fold.WindowFit(spark, 2, window=3, path=str(tmp_path / "w"))
    for b in range(3):
        rows = [(b * 2 + i, w, 2) for i in range(2) for w in "ab"]
        model.on_batch(spark.createDataFrame(rows, "doc_id long, term string, n long"), b)
    first = sorted(map(tuple, model.state(spark).select("doc_id", "term", "pos", "z").collect()))
    assert len({r[0] for r in first}) == 3
    model.on_batch(spark.createDataFrame(
        [(4 + i, w, 2) for i in range(2) for w in "ab"], "doc_id long, term string, n long"), 2)
    assert first == sorted(map(tuple, model.state(spark).select("doc_id", "term", "pos", "z").collect()))
    # A new process goes on from the folder, replays included, and keeps two tables at most.
    again = fold.WindowFit(spark, 2, window=3, path=str(tmp_path / "w"))
    again.on_batch(spark.createDataFrame([(90, "a", 2)], "doc_id long, term string, n long"), 3)
    kept = {r[0] for r in again.state(spark).select("doc_id").collect()}
    assert len(kept) == 3 and 90 in kept | {r[0] for r in first} and len(kept & {r[0] for r in first}) >= 2
    assert again.saved(spark) == [2, 3]
