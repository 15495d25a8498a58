"""What a draw of tree paths builds: tables of the tree, and how often the tokens are counted."""

import random

import pytest
from pyspark.sql import functions as F

from latent.operators.corpus import Corpus
from latent.operators.descent import Descent
from latent.operators.paths import graft_paths, tree_state
from latent.plans.loop import Run
from latent.plans.ncrp import NestedCRP
from latent.session import Workspace


class Noted(Workspace):
    """A workspace that notes the names of its tables."""

    def __init__(self, spark):
        super().__init__(spark)
        self.names = []

    def cut(self, df, name, pin=False):
        self.names.append(name)
        return super().cut(df, name, pin)


def state(spark, depth=3):
    r = random.Random(4)
    leaves = [(d, "/".join(["r", *(str(r.randrange(1 + (d + i) % 3)) for i in range(depth - 1))])) for d in range(30)]
    tokens = [(d, f"w{r.randrange(9)}", i, r.randrange(depth)) for d in range(30) for i in range(d % 7)]
    paths = graft_paths(spark.createDataFrame(leaves, "doc_id long, node_id string"), depth, F.lit("0"))
    return spark.createDataFrame(tokens, "doc_id long, term string, pos int, z int"), paths


@pytest.mark.parametrize("depth, kept", [(3, {}), (4, {"max_branches": 2}), (3, {"prix_fixe": True, "max_branches": 3})])
def test_nodes_and_their_candidates(spark, depth, kept):
    tokens, paths = state(spark, depth)
    nodes = Descent(Workspace(spark), tokens.select("doc_id").distinct(), tokens, paths, depth, 1.0, 0.1, 0.9,
                    (1,), **kept).nodes.collect()
    known = {n["node_id"]: n for n in tree_state(tokens, paths)[1].collect()}
    cap, got = kept.get("max_branches", -1), {n["node_id"]: n for n in nodes}
    assert len(nodes) == len(got) and set(got) == set(known)

    def kids(node):
        return sorted(x for x, y in known.items() if y["parent_id"] == node)

    def esc(node):
        level = known[node]["level"]
        may = level == depth - 2 if kept.get("prix_fixe") else level < depth - 1
        return int(may and (cap < 0 or len(kids(node)) < cap))

    def n(node):
        return esc(node) + sum(map(n, kids(node))) if kids(node) else 1

    for node, k in known.items():
        g = got[node]
        assert all(g[c] == k[c] for c in ("level", "parent_id", "ndsum", "nwsum", "n_parent"))
        assert (g["esc"], g["n"]) == (esc(node), n(node)) and g["hi"] - g["lo"] == g["n"]
        if k["parent_id"]:
            before = [x for x in kids(k["parent_id"]) if x < node]
            assert g["n_up"] == n(k["parent_id"]) and g["lo"] == esc(k["parent_id"]) + sum(map(n, before))


def test_tokens_are_counted_once_for_all_rounds(spark):
    ws = Noted(spark)
    rows = [(d, f"w{d}{i}", 3) for d in range(6) for i in range(2)]  # no two share a word: many ask for nodes
    corpus = Corpus.build(ws, spark.createDataFrame(rows, "doc_id long, term string, n long"))
    model = NestedCRP(corpus, Run(seed=1, batches=1, max_sweeps=1), ws, 3, gamma=50.0)
    tokens = spark.createDataFrame([(d, t, i, i) for d, t, n in rows for i in range(n)],
                                   "doc_id long, term string, pos int, z int")
    paths = graft_paths(spark.createDataFrame([(0, "r/a/a")], "doc_id long, node_id string"), 3, F.lit("0"))
    ws.names.clear()
    drawn = model.draw_paths(corpus.docs.where("doc_id > 0"), ws.cut(tokens, "tokens"), paths, 0, 1)
    assert drawn.select("doc_id").distinct().count() == 5
    rounds = ws.names.count("drawn")
    assert rounds > 1 and ws.names.count("held") == 1
    assert len(ws.names) <= 2 + 14 * rounds
