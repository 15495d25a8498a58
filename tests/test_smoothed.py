import math
import random

from latent.operators import summary
from latent.session import Workspace


def brute(shares, phi):
    p = {}
    for doc, node, w in shares:
        for n, term, share in phi:
            if n == node:
                p[doc, term] = p.get((doc, term), 0.0) + w * share
    return {cell: round(math.log(x), 9) for cell, x in p.items()}


def frames(spark, shares, phi):
    return (spark.createDataFrame(shares, "doc_id long, node_id string, p_node double"),
            spark.createDataFrame(phi, "node_id string, term string, phi double"))


def test_best_terms_walk_as_deep_as_needed(spark):
    r = random.Random(4)
    # The lists of x and y run against each other, so sums stand far down both; z is short, ties abound.
    phi = [("x", f"t{i:03d}", (200 - i) / 40_000) for i in range(200)]
    phi += [("y", f"t{i:03d}", (1 + i) / 40_000 + (0.002 if i == 100 else 0)) for i in range(200)]
    phi += [("z", "only", 0.5)] + [("even", f"e{i}", 0.01) for i in range(30)]
    shares = [(1, "x", 0.5), (1, "y", 0.5), (2, "x", 1.0), (3, "z", 1.0), (4, "even", 1.0),
              (5, "even", 0.3), (5, "y", 0.7), (6, "missing", 1.0)]
    shares += [(10 + i, node, r.random()) for i in range(20) for node in "xyz"]
    want = {}
    for (doc, term), v in brute(shares, phi).items():
        want.setdefault(doc, []).append((-v, term))
    want = {(doc, i + 1, term, round(-v, 8)) for doc, found in want.items()
            for i, (v, term) in enumerate(sorted(found)[:3])}
    a, b = frames(spark, shares, phi)
    got = summary.best_terms(a, b, 3, Workspace(spark)).collect()
    assert {(x.doc_id, x["rank"], x.term, round(x.log_p, 8)) for x in got} == want and len(got) == len(want)
    assert (1, 1) in {(x.doc_id, x["rank"]) for x in got if x.term == "t100"}
    assert summary.best_terms(a.limit(0), b, 3, Workspace(spark)).count() == 0


def test_cells_are_those_asked_for(spark):
    phi = [("x", "a", 0.2), ("x", "b", 0.1), ("y", "a", 0.4)]
    shares = [(1, "x", 0.25), (1, "y", 0.75), (2, "x", 1.0)]
    a, b = frames(spark, shares, phi)
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "zz"), (3, "a"), (None, "a")],
                                  "doc_id long, term string")
    got = {(r.doc_id, r.term): round(r.log_p, 9) for r in summary.smoothed_cells(a, b, asked).collect()}
    full = brute(shares, phi)
    assert got == {cell: full[cell] for cell in [(1, "a"), (2, "b")]}
