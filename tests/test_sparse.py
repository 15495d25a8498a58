import numpy as np
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, site_uniform
from latent.operators.corpus import Corpus
from latent.plans import lda
from latent.plans.loop import Run
from latent.plans.sparse import SparseCounts, redraw_sparse
from latent.session import Workspace


def test_proposals_leave_the_token_out():
    rng = np.random.default_rng(1)
    held = SparseCounts(np.array([0, 2, 1]), np.array([3, 1, 5]), np.array([0, 2, 3]), 4)
    for owner, own, rest in ((0, 2, [3, 0, 0, 0]), (0, 0, [2, 0, 1, 0]), (1, 1, [0, 4, 0, 0]), (0, -1, [3, 0, 1, 0])):
        n = 200_000
        got = held.propose(np.full(n, owner), np.full(n, own), 0.25, rng.random(n))
        total = sum(rest) + 1.0 + (own >= 0)
        share = np.bincount(got + 1, minlength=5) / n
        want = np.array([float(own >= 0)] + [r + 0.25 for r in rest]) / total
        assert np.abs(share - want).max() < 0.005
    assert held.at(np.array([0, 0, 1, 1]), np.array([2, 1, 1, 3])).tolist() == [1, 0, 5, 0]


def test_steps_reach_the_full_conditional(spark):
    """One token in each of many like documents, all starting at the unlikeliest topic."""
    n, k, alpha, eta = 4000, 3, 0.4, 0.5
    rows = [(d, t, 1, z) for d in range(n) for t, z in (("a", 2), ("b", 0), ("c", 1), ("d", 0))]
    rows += [(n + i, "a", 1, z) for i, z in enumerate([0] * 3000 + [1] * 6000)]
    tokens = spark.createDataFrame(rows, "doc_id long, term string, pos int, z int").cache()
    ws = Workspace(spark)
    corpus = Corpus.build(ws, tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n")))
    part = tokens.where(f"term = 'a' and doc_id < {n}")
    drawn = redraw_sparse(part, tokens, k, alpha, eta, corpus, site_uniform(4, DOC, TERM, POS), ws, steps=40)
    assert drawn.columns == part.columns
    got = {r["z"]: r["count"] for r in drawn.groupBy("z").count().collect()}
    nw = np.array([3000, 6000, n - 1])
    totals = np.array([3000 + 2 * n, 6000 + n, n - 1])
    p = (nw + eta) / (totals + 4 * eta) * (np.array([2, 1, 0]) + alpha)
    p = p / p.sum()
    assert sum(got.values()) == n
    for z in range(k):
        assert abs(got.get(z, 0) - n * p[z]) < 4.5 * np.sqrt(n * p[z] * (1 - p[z]))


def test_fit_improves_and_keeps_tokens(spark, planted):
    f = lda.fit_lda(planted, 40, run=Run(seed=1, batches=2, max_sweeps=2), proposals=4)
    t = f.tables()["tokens"]
    assert t.count() == planted.agg(F.sum("n")).first()[0] and t.where("z < 0 or z >= 40").isEmpty()
    lls = [r["ll"] for r in f.trace_rows]
    assert lls[-1] > lls[0]
