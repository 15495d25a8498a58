import pytest
from pyspark.sql import functions as F

from latent.operators import clusters, corpus, paths, structure, windows
from latent.session import Workspace


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_spread_join_equals_plain_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id") % 50)).alias("term"), F.col("id").alias("doc_id"))
    small = big.select("term").distinct().withColumn("v", F.length("term"))
    hot = corpus.hot_keys(big.groupBy("term").agg(F.count("*").alias("df")), "term", "df", 2000, 100)
    assert hot[0][0] == "hot" and hot[0][1] > 1 and len(hot) == 1
    for how in ("inner", "left"):
        spread = corpus.spread_join(big, small, ["term"], hot, "term", "doc_id", how)
        plain = big.join(small, "term", how)
        assert sorted(map(tuple, spread.select("doc_id", "v").collect())) == sorted(
            map(tuple, plain.select("doc_id", "v").collect()))


def test_contract_tree(spark):
    edges = edge_frame(spark, [("b", "a"), ("c", "b"), ("x", "c"), ("y", "c"), ("wn_dead", "y")])
    nodes, links = structure.contract_tree(edges, Workspace(spark))
    labels = {r["node"]: r["label"] for r in nodes.collect()}
    # a and b fold into c; y keeps its name after its childless synset goes.
    assert labels == {"c": "a\\nb\\nc", "x": "x", "y": "y"}
    assert {tuple(r) for r in links.collect()} == {("x", "c"), ("y", "c")}


def test_dag_walks(spark):
    edges = edge_frame(spark, [("d", "p"), ("d", "q"), ("p", "root"), ("q", "root")])
    up = {(r["node"], r["ancestor"]): r["distance"] for r in structure.ancestors(edges).collect()}
    assert up[("d", "root")] == 2 and up[("d", "d")] == 0 and len(up) == 9
    routes = {tuple(r["path"]) for r in structure.root_paths(edges).collect() if r["node"] == "d"}
    assert routes == {("d", "p", "root"), ("d", "q", "root")}
    docs = spark.createDataFrame([(1, "d")], "doc_id long, node string")
    senses = structure.sense_paths(docs, edges).collect()
    assert {(r["sense"], r["level"], r["node_id"]) for r in senses} == {
        (0, 0, "root"), (0, 1, "p"), (0, 2, "d"), (1, 0, "root"), (1, 1, "q"), (1, 2, "d")}


def test_senses_of_two_nodes_and_cycles(spark):
    edges = edge_frame(spark, [("d", "p"), ("e", "p"), ("e", "q"), ("p", "root"), ("q", "root")])
    docs = spark.createDataFrame([(1, "d"), (1, "e")], "doc_id long, node string")
    rows = structure.sense_paths(docs, edges).collect()
    lists = {}
    for r in sorted(rows, key=lambda r: r["level"]):
        lists.setdefault(r["sense"], []).append(r["node_id"])
    assert lists == {0: ["root", "p", "d"], 1: ["root", "p", "e"], 2: ["root", "q", "e"]}
    ring = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "top")])
    with pytest.raises(Exception, match="cycle"):
        structure.root_paths(ring).collect()
    with pytest.raises(ValueError, match="cycle"):
        structure.contract_tree(ring, Workspace(spark))


def test_names_listing_several_docs(spark):
    edges = edge_frame(spark, [("d1 d2", "root")])
    docs = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d3")], "doc_id long, name string")
    assert {r["doc_id"] for r in structure.nodes_naming_docs(edges, docs).collect()} == {1, 2}


def test_graft_and_audit(spark):
    choices = spark.createDataFrame([(1, "r/0/1"), (2, "r/0"), (3, "r")], "doc_id long, node_id string")
    rows = paths.graft_paths(choices, 3, F.lit("new"))
    got = {(r["doc_id"], r["level"]): r["node_id"] for r in rows.collect()}
    assert got[(1, 2)] == "r/0/1" and got[(2, 2)] == "r/0/new" and got[(3, 2)] == "r/new/0"
    tokens = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 1, 0)],
                                   "doc_id long, term string, pos int, z int")
    edges = rows.where("parent_id is not null").select("parent_id", F.col("node_id").alias("child_id"))
    counted = rows.groupBy("node_id").agg(F.count("*").alias("ndsum"))
    assert paths.tree_is_consistent(tokens, rows, edges.distinct(), counted, 2).isEmpty()
    assert not paths.tree_is_consistent(tokens, rows, edges.distinct(), counted, 3).isEmpty()


def test_move_feature(spark):
    views = spark.createDataFrame([("a", 0), ("b", 1)], "term string, view long")
    moved = spark.createDataFrame([("a", 1, True), ("b", 0, False)],
                                  "term string, new_view long, accepted boolean")
    assert {tuple(r) for r in clusters.move_feature(views, moved).collect()} == {("a", 1), ("b", 1)}


def test_top_pairs_are_bounded(spark):
    nt = spark.range(300).select((F.col("id") % 3).cast("string").alias("node_id"),
                                 F.concat(F.lit("t"), "id").alias("term"), F.col("id").alias("n"))
    assert windows.top_term_pairs(nt, 4).count() == 18


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    chain = spark.range(n - 1).select(F.format_string("v%05d", "id").alias("child"),
                                      F.format_string("v%05d", F.col("id") + 1).alias("parent"))
    ws = Workspace(spark)
    asked = spark.createDataFrame([("v00000",), ("v09990",)], "node string")
    far = structure.ancestors(chain, ws, asked).groupBy("node").agg(
        F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    assert {r["node"]: (r["n"], r["d"]) for r in far} == {"v00000": (n, n - 1), "v09990": (10, 9)}
    assert ws._serial <= 2 + 2 * 14
    ws = Workspace(spark)
    nodes, links = structure.contract_tree(chain, ws)
    # All but the childless end fold into the node above it.
    assert sorted(r["node"] for r in nodes.collect()) == ["v00000", "v00001"] and links.count() == 1
    folded = nodes.where("node = 'v00001'").first()["label"].split(structure.MERGE_MARK)
    assert folded == [f"v{i:05d}" for i in range(n - 1, 0, -1)]
    assert ws._serial <= 60
