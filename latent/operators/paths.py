"""Path scores and structure of a nested clustering tree.

``paths(doc_id, level, node_id, parent_id)`` is the whole tree: its nodes are the distinct
path entries, so a node without documents does not exist. Node ids spell their root path,
``r/3/7``, which gives every node's ancestors without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from latent.functions.mathx import lgamma_col, lgamma_sql, polya_empty, polya_gain, sql
from latent.operators.corpus import depth_eta_sql, spread_join

ROOT = "r"


def _zero() -> Column:
    return F.lit(0).cast("long")


def parent_of(node: Column) -> Column:
    """Root path without its last step; null for the root."""
    return F.when(F.instr(node, "/") > 0, F.regexp_replace(node, "/[^/]*$", ""))


def level_of(node: Column) -> Column:
    return F.length(node) - F.length(F.replace(node, F.lit("/"), F.lit("")))


def path_of(node: Column, depth: int) -> Column:
    """Entries from the root to a node, filled with fresh '0' steps down to ``depth``."""
    steps = F.split(node, "/")
    full = F.concat(steps, F.array_repeat(F.lit("0"), F.lit(depth) - F.size(steps)))
    return F.transform(F.sequence(F.lit(1), F.lit(depth)),
                       lambda i: F.array_join(F.slice(full, F.lit(1), i), "/"))


def graft_paths(choices: DataFrame, depth: int, suffix: Column) -> DataFrame:
    """Path rows for the chosen nodes: a leaf keeps its root path, an inner node gets a fresh
    chain to ``depth`` whose first step is ``suffix``."""
    inner = level_of(F.col("node_id")) < depth - 1
    start = F.when(inner, F.concat_ws("/", F.col("node_id"), suffix)).otherwise(F.col("node_id"))
    rows = choices.select("doc_id", F.posexplode(path_of(start, depth)).alias("level", "node_id"))
    return rows.withColumn("parent_id", parent_of(F.col("node_id")))


def prune_empty(paths: DataFrame) -> DataFrame:
    """The live tree: nodes some document still passes through."""
    return paths.select("level", "node_id", "parent_id").distinct()


def ancestor_bridge(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, node itself included) from root-path ids."""
    steps = F.split("node_id", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(steps)),
                         lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return nodes.select("node_id", F.explode(prefix).alias("ancestor_id"))


def tree_state(tokens: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts per (level, node, term), and nodes with ndsum, nwsum and child count."""
    at = paths.select("doc_id", F.col("level").alias("z"), "node_id")
    terms = (tokens.join(at, ["doc_id", "z"]).groupBy(F.col("z").alias("level"), "node_id", "term")
             .agg(F.count("*").alias("nw")))
    nwsum = terms.groupBy("node_id").agg(F.sum("nw").alias("nwsum"))
    nodes = (paths.groupBy("level", "node_id", "parent_id").agg(F.count("*").alias("ndsum"))
             .join(nwsum, "node_id", "left").withColumn("nwsum", F.coalesce("nwsum", _zero())))
    children = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("children"))
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("ndsum").alias("n_parent"))
    return terms, (nodes.join(children, "node_id", "left").join(up, "parent_id", "left")
                   .withColumn("children", F.coalesce("children", _zero())))


def doc_level_terms(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", F.col("z").alias("level"), "term").agg(
        F.count("*").alias("n"))


def doc_levels(doc_ids: DataFrame, dlt: DataFrame, depth: int, eta: float,
               scale: float) -> DataFrame:
    """Per document and level: tokens there, and the term factors of an empty node."""
    e = depth_eta_sql(eta, scale, "level")
    held = dlt.groupBy("doc_id", "level").agg(
        F.sum("n").alias("k"), F.sum(polya_empty(e, "n")).alias("empty"))
    grid = doc_ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
                          .alias("level"))
    return (grid.join(held, ["doc_id", "level"], "left")
            .withColumn("k", F.coalesce("k", _zero()))
            .withColumn("empty", F.coalesce("empty", F.lit(0.0))))


def node_scores(doc_ids: DataFrame, tokens: DataFrame, paths: DataFrame, depth: int, gamma: float,
                eta: float, eta_sum: float, scale: float = 1.0, m_dependent: bool = False,
                hot=()) -> DataFrame:
    """ln weight of the path down to every node the document may visit, the document removed.

    Documents without a path yet take part with nothing to remove. Columns besides
    ``log_weight``: level, ndsum¬, children.
    """
    terms, nodes = tree_state(tokens, paths)
    mine = tokens.join(doc_ids, "doc_id", "left_semi")
    dlt = doc_level_terms(mine)
    levels = doc_levels(doc_ids, dlt, depth, eta, scale)
    homes = paths.select("doc_id", "level", F.col("node_id").alias("home"),
                         F.col("parent_id").alias("home_parent"))
    at_home = F.coalesce(F.col("node_id") == F.col("home"), F.lit(False)).cast("long")
    under_home = F.coalesce(F.col("parent_id") == F.col("home_parent"),
                            F.lit(False)).cast("long")
    e, es = depth_eta_sql(eta, scale, "level"), depth_eta_sql(eta_sum, scale, "level")

    met = spread_join(dlt.join(homes, ["doc_id", "level"], "left"), terms, ["level", "term"],
                      list(hot), "term", "doc_id")
    gain = (met.withColumn("_rest", F.col("nw") - at_home * F.col("n")).where(F.col("_rest") > 0)
            .groupBy("doc_id", "node_id")
            .agg(F.sum(polya_gain(e, "_rest", "n")).alias("gain")))

    base = (levels.join(homes, ["doc_id", "level"], "left").join(nodes, "level")
            .withColumn("ndsum", F.col("ndsum") - at_home)
            .withColumn("n_parent", F.col("n_parent") - under_home)
            .withColumn("nwsum", F.col("nwsum") - at_home * F.col("k"))
            .where(F.col("ndsum") > 0))
    bottom = ((gamma + 1) * F.col("n_parent") - 1 if m_dependent
              else gamma + F.col("n_parent") - 1)
    prior = F.when(F.col("level") > 0, F.ln("ndsum") - F.ln(bottom.cast("double"))).otherwise(0.0)
    lp = (prior + lgamma_col(f"{sql(es)} + nwsum") - lgamma_col(f"{sql(es)} + nwsum + k")
          + F.col("empty") + F.coalesce("gain", F.lit(0.0)))
    each = (base.join(gain, ["doc_id", "node_id"], "left")
            .select("doc_id", "node_id", "level", "ndsum", "children", lp.alias("lp")))
    bridge = ancestor_bridge(nodes.select("node_id"))
    summed = (each.select("doc_id", F.col("node_id").alias("ancestor_id"), "lp")
              .join(bridge, "ancestor_id").groupBy("doc_id", "node_id")
              .agg(F.sum("lp").alias("log_weight")))
    return each.drop("lp").join(summed, ["doc_id", "node_id"])


def score_paths(visits: DataFrame, depth: int) -> DataFrame:
    """Candidates that keep to an existing leaf."""
    return visits.where(F.col("level") == depth - 1).select("doc_id", "node_id", "log_weight")


def score_branches(visits: DataFrame, doc_ids: DataFrame, tokens: DataFrame, depth: int,
                   gamma: float, eta: float, eta_sum: float, scale: float = 1.0,
                   m_dependent: bool = False, max_branches: int = -1,
                   prix_fixe: bool = False) -> DataFrame:
    """Candidates that leave the tree at an inner node for a fresh chain.

    The chain's data term is the suffix sum, below the node's level, of what empty nodes
    give the document.
    """
    mine = tokens.join(doc_ids, "doc_id", "left_semi")
    es = depth_eta_sql(eta_sum, scale, "level")
    levels = doc_levels(doc_ids, doc_level_terms(mine), depth, eta, scale).withColumn(
        "fresh", F.expr(f"empty + {lgamma_sql(es)} - {lgamma_sql(f'{sql(es)} + k')}"))
    below = (Window.partitionBy("doc_id").orderBy(F.desc("level"))
             .rowsBetween(Window.unboundedPreceding, -1))
    chain = levels.select("doc_id", "level", F.coalesce(F.sum("fresh").over(below), F.lit(0.0))
                          .alias("chain"))
    inner = visits.where(F.col("level") == depth - 2 if prix_fixe else F.col("level") < depth - 1)
    if max_branches >= 0:
        inner = inner.where(F.col("children") < max_branches)
    n = F.col("ndsum")
    escape = (F.ln(gamma * n) - F.ln(((gamma + 1) * n - 1).cast("double")) if m_dependent
              else F.ln(F.lit(float(gamma))) - F.ln((gamma + n - 1).cast("double")))
    return (inner.join(chain, ["doc_id", "level"])
            .select("doc_id", "node_id",
                    (F.col("log_weight") + escape + F.col("chain")).alias("log_weight")))


def tree_is_consistent(tokens: DataFrame, paths: DataFrame, edges: DataFrame,
                       node_docs: DataFrame, n_tokens: int) -> DataFrame:
    """Violations of the tree audit; an empty result means the state is sound.

    Every path link must be an edge, every node's document count its path count, every
    token must sit on its document's path, and tokens must add up.
    """
    links = paths.where(F.col("parent_id").isNotNull()).select("parent_id", "node_id").distinct()
    bad_link = (links.join(edges.withColumnRenamed("child_id", "node_id"),
                           ["parent_id", "node_id"], "left_anti")
                .select(F.lit("link").alias("fault"), "node_id"))
    counted = paths.groupBy("node_id").agg(F.count("*").alias("ndsum"))
    bad_docs = (node_docs.join(counted, ["node_id", "ndsum"], "left_anti")
                .select(F.lit("docs").alias("fault"), "node_id"))
    stray = (tokens.join(paths.select("doc_id", F.col("level").alias("z")), ["doc_id", "z"],
                         "left_anti")
             .groupBy("z").count()
             .select(F.lit("token").alias("fault"), F.col("z").cast("string").alias("node_id")))
    total = (tokens.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))
             .where(F.coalesce("n", _zero()) != n_tokens)
             .select(F.lit("total").alias("fault"), F.col("n").cast("string").alias("node_id")))
    return bad_link.unionByName(bad_docs).unionByName(stray).unionByName(total)
