"""Topic lists and hierarchies: building, contracting and walking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from latent.functions.mathx import lgamma_sql, sql
from latent.operators.levels import few_nodes, node_counts, with_node_maps
from latent.session import Workspace

MERGE_MARK = "\\n"


def tree_edges_to_tree(edges: DataFrame, use_dag: bool = False) -> DataFrame:
    """One parent per child, the last listed, unless a DAG is wanted."""
    if use_dag:
        return edges.select("child", "parent").distinct()
    return edges.groupBy("child").agg(F.max_by("parent", "line_no").alias("parent"))


def find_root(edges: DataFrame) -> DataFrame:
    """Nodes that are parents but nobody's child."""
    return (edges.select(F.col("parent").alias("node")).distinct()
            .join(edges.select(F.col("child").alias("node")), "node", "left_anti"))


def tree_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).unionByName(
        edges.select(F.col("parent").alias("node"))).distinct()


def list_ranks(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, tail, dist) of every ``upper`` of chains (upper, lower), in which each node has one
    lower and one upper at most. Pointers double, so a chain of n takes log n rounds."""
    now = ws.cut(links.select(F.col("upper").alias("node"), F.col("lower").alias("tail"),
                              F.lit(1).cast("long").alias("dist")), "ranks")
    while True:
        ahead = now.select(F.col("node").alias("tail"), F.col("tail").alias("_tail"),
                           F.col("dist").alias("_dist"))
        if now.join(ahead, "tail", "left_semi").isEmpty():
            return now
        now = ws.cut(now.join(ahead, "tail", "left").select(
            "node", F.coalesce("_tail", "tail").alias("tail"),
            (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist")), "ranks")


def contract_tree(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Simplify a hierarchy to a fix-point; returns (nodes(node, label), edges(child, parent)).

    A node with exactly one child is merged into it when that child has no other parent and
    children of its own; the label then names both. When nothing merges, childless ``wn_``
    nodes go. Each round merges whole chains, ranked by pointer doubling.
    """
    links = ws.cut(edges.select("child", "parent").distinct(), "links")
    nodes = ws.cut(tree_nodes(links).withColumn("label", F.col("node")), "labels")
    fail_on_cycle(links, ws)
    while True:
        n_children = links.groupBy("parent").agg(F.count("*").alias("children"),
                                                 F.min("child").alias("only"))
        n_parents = links.groupBy("child").agg(F.count("*").alias("parents"))
        single = n_children.where(F.col("children") == 1)
        merge = (single.join(n_parents.where(F.col("parents") == 1)
                             .select(F.col("child").alias("only")), "only", "left_semi")
                 .join(links.select(F.col("parent").alias("only")).distinct(), "only", "left_semi")
                 .select(F.col("parent").alias("upper"), F.col("only").alias("lower")))
        merge = ws.cut(merge, "merge")
        if not merge.isEmpty():
            ranks = list_ranks(merge, ws)
            tails = ranks.select(F.col("tail").alias("node"), "tail", F.lit(0).cast("long").alias("dist")).distinct()
            # From the head of the chain to its tail.
            label = F.array_join(F.sort_array(F.collect_list(F.struct(
                (-F.col("dist")).alias("at"), "label")))["label"], MERGE_MARK)
            named = ranks.unionByName(tails).join(nodes, "node").groupBy("tail").agg(label.alias("_label"))
            new_nodes = (nodes.join(ranks.select("node"), "node", "left_anti")
                         .join(named.withColumnRenamed("tail", "node"), "node", "left")
                         .select("node", F.coalesce("_label", "label").alias("label")))
            # Links below a merged node are the chain's own; what hung on its head gets the tail.
            new_links = (links.join(ranks.select(F.col("node").alias("parent")), "parent", "left_anti")
                         .join(ranks.select(F.col("node").alias("child"), "tail"), "child", "left")
                         .select(F.coalesce("tail", "child").alias("child"), "parent"))
        else:
            bare = (nodes.where(F.col("label").startswith("wn_"))
                    .join(links.select(F.col("parent").alias("node")), "node", "left_anti")
                    .select("node"))
            bare = ws.cut(bare, "bare")
            if bare.isEmpty():
                return nodes, links
            new_nodes = nodes.join(bare, "node", "left_anti")
            new_links = links.join(bare.withColumnRenamed("node", "child"), "child", "left_anti")
        nodes, links = ws.cut(new_nodes, "labels"), ws.cut(new_links, "links")


def _doubled(hop: DataFrame, ws: Workspace) -> DataFrame:
    """(child, parent) pairs twice as many links apart."""
    far = hop.select(F.col("child").alias("_mid"), F.col("parent").alias("_top"))
    return ws.cut(hop.join(far, F.col("parent") == F.col("_mid")).select(
        "child", F.col("_top").alias("parent")).distinct(), "hops")


def fail_on_cycle(links: DataFrame, ws: Workspace) -> None:
    """An error if following (child, parent) links upwards never ends for some node.

    A walk of as many links as there are nodes has passed one of them twice.
    """
    n, step, hop = tree_nodes(links).count(), 1, links.select("child", "parent").distinct()
    while not hop.isEmpty():
        if step >= n:
            raise ValueError(f"the hierarchy has a cycle above {hop.first()['child']}")
        hop, step = _doubled(hop, ws), 2 * step


def ancestors(edges: DataFrame, ws: Workspace | None = None,
              nodes: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance), itself at 0, the least distance kept; for all nodes of the
    hierarchy or those of ``nodes`` (node).

    Hops double in length and what a node reaches is extended by each, so a hierarchy of depth
    d takes log d rounds.
    """
    ws = ws or Workspace(edges.sparkSession)
    hop = ws.cut(edges.select("child", "parent").distinct(), "up")
    every = ws.cut(tree_nodes(hop), "nodes")
    asked = every if nodes is None else every.join(nodes.select("node").distinct(), "node", "left_semi")
    reach = asked.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    n, step = every.count(), 1
    while step < n and not hop.isEmpty():
        climbed = reach.join(hop, F.col("ancestor") == F.col("child")).select(
            "node", F.col("parent").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        reach = ws.cut(reach.unionByName(climbed).groupBy("node", "ancestor").agg(
            F.min("distance").alias("distance")), "closure")
        step *= 2
        if step < n:
            hop = _doubled(hop, ws)
    return reach


def ancestor_topics(doc_nodes: DataFrame, edges: DataFrame, fold_non_wn: bool = False,
                    ws: Workspace | None = None) -> DataFrame:
    """A document's topics: its node and all ancestors, each once; optionally only ``wn_``."""
    topics = (doc_nodes.join(ancestors(edges, ws, doc_nodes), "node")
              .select("doc_id", F.col("ancestor").alias("topic")).distinct())
    return topics.where(F.col("topic").startswith("wn_")) if fold_non_wn else topics


def nodes_naming_docs(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, node) where a space-separated part of the node's name is the document's name."""
    named = tree_nodes(edges).select("node", F.explode(F.split("node", " ")).alias("name"))
    return named.join(docs, "name").select("doc_id", "node").distinct()


def root_paths(edges: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Every distinct path from a node to a root, as an array starting at the node.

    A path that comes back to one of its own nodes is an error: a hierarchy has no cycle.
    """
    ws = ws or Workspace(edges.sparkSession)
    up = ws.cut(edges.select("child", "parent").distinct(), "up")
    start = tree_nodes(up).join(up.withColumnRenamed("child", "node"), "node", "left").select(
        "node", "parent", F.array_compact(F.array("node", "parent")).alias("path"))
    while True:
        # A path ends at a root, or goes on at its last node, where it meets all paths of that.
        paths = ws.cut(start.select("node", F.col("parent").alias("last"), "path"), "paths")
        on = paths.where(F.col("last").isNotNull())
        if on.isEmpty():
            return paths.select("node", "path")
        more = paths.select(F.col("node").alias("last"), F.col("last").alias("parent"),
                            F.slice("path", F.lit(2), F.size("path")).alias("_rest"))
        again = F.arrays_overlap("path", "_rest")
        joined = on.join(more, "last").select(
            "node", "parent", F.when(again, F.raise_error(F.concat(
                F.lit("the hierarchy has a cycle through "), "last"))).otherwise(
                F.concat("path", "_rest")).alias("path"))
        start = joined.unionByName(paths.where(F.col("last").isNull()).select(
            "node", F.col("last").alias("parent"), "path"))


def sense_paths(doc_nodes: DataFrame, edges: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """One topic list per direct parent of the document's node, with ln(freq) of that edge.

    Senses count from 0 by node and parent, over all nodes of a document; levels run from the
    root side to the document.
    """
    senses = doc_nodes.select(F.col("node").alias("child")).join(edges, "child").select(
        F.col("parent").alias("node"))
    closure = ancestors(edges, ws, senses)
    freq = F.coalesce("freq", F.lit(1.0)) if "freq" in edges.columns else F.lit(1.0)
    listed = Window.partitionBy("doc_id").orderBy("node", "parent")
    direct = (doc_nodes.join(edges.withColumn("freq", freq).withColumnRenamed("child", "node"),
                             "node")
              .withColumn("sense", F.row_number().over(listed) - 1)
              .select("doc_id", "node", "parent", "sense", F.ln("freq").alias("log_freq")))
    above = (direct.join(closure.withColumnRenamed("node", "parent"), "parent")
             .select("doc_id", "sense", F.col("ancestor").alias("node_id"),
                     (F.col("distance") + 1).alias("distance"), "log_freq"))
    own = direct.select("doc_id", "sense", F.col("node").alias("node_id"),
                        F.lit(0).alias("distance"), "log_freq")
    down = Window.partitionBy("doc_id", "sense").orderBy(F.desc("distance"), "node_id")
    return (above.unionByName(own).withColumn("level", F.row_number().over(down) - 1)
            .select("doc_id", "sense", "node_id", "level", "log_freq"))


def as_slots(doc_topics: DataFrame, alpha: float) -> DataFrame:
    """Number each document's topics 0, 1, … and give each the prior α."""
    order = Window.partitionBy("doc_id").orderBy("topic")
    return doc_topics.select("doc_id", (F.row_number().over(order) - 1).alias("slot"),
                             F.col("topic").alias("node_id"), F.lit(float(alpha)).alias("alpha"))


def add_reject(doc_topics: DataFrame) -> DataFrame:
    """Every listed document may also reject a word."""
    return doc_topics.select("doc_id", "topic").unionByName(
        doc_topics.select("doc_id").distinct().withColumn("topic", F.lit("REJECT")))


def with_noise_topics(doc_topics: DataFrame, n: int) -> DataFrame:
    """Give every document the n shared noise topics besides its labels."""
    names = F.array(*[F.lit(f"NOISE_{i}") for i in range(n)])
    noise = doc_topics.select("doc_id").distinct().select("doc_id", F.explode(names).alias("topic"))
    return doc_topics.select("doc_id", "topic").unionByName(noise)


def topics_by_name(topic_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Topic file rows (doc, pos, topic) of documents in the corpus; the greatest id of a name wins."""
    ids = docs.groupBy("name").agg(F.max("doc_id").alias("doc_id"))
    return (topic_rows.join(ids, topic_rows["doc"] == ids["name"])
            .select("doc_id", F.col("doc").alias("name"), "pos", "topic"))


def docs_without_topics(docs: DataFrame, doc_topics: DataFrame) -> DataFrame:
    return docs.join(doc_topics.select("doc_id"), "doc_id", "left_anti")


def cull_unique_topics(doc_topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop topics only one document carries, its own name aside.

    Input (doc_id, name, pos, topic). Returns the kept rows, and (topic, pos, culled): the
    culled labels the document's first kept topic takes on, one row each. Documents left
    without a topic drop out, and their culled labels with them.
    """
    held = doc_topics.groupBy("topic").agg(F.count("*").alias("_holders"))
    marked = (doc_topics.join(held, "topic")
              .withColumn("_culled", (F.col("_holders") == 1) & (F.col("topic") != F.col("name"))))
    kept = marked.where(~F.col("_culled")).select("doc_id", "name", "pos", "topic")
    first = kept.groupBy("doc_id").agg(F.min_by("topic", "pos").alias("first_topic"))
    labels = (marked.where("_culled").join(first, "doc_id")
              .select(F.col("first_topic").alias("topic"), "doc_id", "pos",
                      F.col("topic").alias("culled")))
    return kept, labels


def score_senses(cells: DataFrame, doc_senses: DataFrame, node_terms: DataFrame, eta: float,
                 eta_sum: float) -> DataFrame:
    """Σ over a sense's nodes and the document's tokens of lgamma(nw+η) − lgamma(nwsum+Ση),
    plus ln freq(sense)."""
    nwsum = node_terms.groupBy("node_id").agg(F.sum("n").alias("nwsum"))
    length = cells.groupBy("doc_id").agg(F.sum("n").alias("n_doc"))
    base = (doc_senses.join(nwsum, "node_id", "left").join(length, "doc_id")
            .groupBy("doc_id", "sense")
            .agg(F.sum(F.expr(f"n_doc * ({lgamma_sql(float(eta))} - "
                              f"{lgamma_sql(f'{sql(eta_sum)} + coalesce(nwsum, 0)')})"))
                 .alias("base"),
                F.max("log_freq").alias("log_freq")))
    counts = node_terms.select("node_id", "term", F.col("n").alias("nw"))
    if few_nodes(doc_senses):
        asked = F.broadcast(doc_senses.select("node_id").distinct())
        listed = doc_senses.groupBy("doc_id").agg(F.collect_list(F.struct("sense", "node_id")).alias("_s"))
        met = with_node_maps(cells, counts.join(asked, "node_id", "left_semi")).where("_map IS NOT NULL")
        # Dealt by their document, its cells stay together until they are summed.
        near = met.join(listed, "doc_id").withColumn("nw", node_counts("_s.node_id")).selectExpr("doc_id", "n", "inline(transform(_s, (x, i) -> "
                              "named_struct('sense', x.sense, 'nw', nw[i])))")
    else:
        near = (cells.join(doc_senses.select("doc_id", "sense", "node_id"), "doc_id")
                .join(counts, ["node_id", "term"]))
    gain = (near.where(F.col("nw") > 0)
            .groupBy("doc_id", "sense")
            .agg(F.sum(F.expr(f"n * ({lgamma_sql(f'{sql(eta)} + nw')} - "
                              f"{lgamma_sql(float(eta))})")).alias("gain")))
    return (base.join(gain, ["doc_id", "sense"], "left")
            .select("doc_id", "sense", (F.col("base") + F.coalesce("gain", F.lit(0.0))
                                        + F.col("log_freq")).alias("log_weight")))


