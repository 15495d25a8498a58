"""Sufficient statistics: every one is a group-by count over the assignment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_term_counts(tokens: DataFrame, node: str = "node_id") -> DataFrame:
    return tokens.groupBy(node, "term").agg(F.count("*").alias("n"))


def node_doc_counts(tokens: DataFrame, node: str = "node_id") -> DataFrame:
    return tokens.groupBy(node, "doc_id").agg(F.count("*").alias("n"))


def node_totals(tokens: DataFrame, node: str = "node_id") -> DataFrame:
    """Tokens and documents with a token per node, by way of the (node, doc) partial counts."""
    return (node_doc_counts(tokens, node).groupBy(node)
            .agg(F.sum("n").alias("nwsum"), F.count("*").alias("ndsum")))


def path_doc_counts(paths: DataFrame) -> DataFrame:
    """Documents whose path includes the node, with or without tokens there."""
    return paths.groupBy("node_id").agg(F.count("*").alias("ndsum"))


def topic_array(k: int, z: str = "z") -> Column:
    """Dense per-topic counts of a group; one partial-aggregated sum per topic."""
    return F.expr(f"array({', '.join(f'count_if({z} = {i})' for i in range(k))})")


def nonzero_docs(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that really have tokens in each group."""
    return (tokens.groupBy(*keys, "doc_id").agg(F.count("*").alias("_n"))
            .groupBy(*keys).agg(F.count("*").alias("n_docs"), F.sum("_n").alias("n_tokens")))


def cluster_term_presence(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Documents of each cluster containing each term."""
    return (cells.where(F.col("n") > 0).join(clusters, "doc_id")
            .groupBy("cluster", "term").agg(F.count("*").alias("n_docs")))


def view_sizes(members: DataFrame, term_views: DataFrame) -> DataFrame:
    """Clusters and features per view."""
    clusters = (members.groupBy("view", "cluster").agg(F.count("*").alias("_n"))
                .groupBy("view").agg(F.count("*").alias("clusters")))
    features = term_views.groupBy("view").agg(F.count("*").alias("features"))
    return (clusters.join(features, "view", "left")
            .select("view", "clusters", F.coalesce("features", F.lit(0)).alias("features")))


def term_pair_counts(node_terms: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joint and marginal co-occurrence over nodes, for the asked pairs.

    ``pairs(w1, w2)`` names the pairs wanted (for one, :func:`top_term_pairs`): counting
    them costs a join with the nodes of w1, and never lists all pairs of a node. A term's
    marginal gains 2k from each node of k distinct terms.
    """
    node = node_terms.select("node_id", "term").distinct()
    wanted = pairs.where(F.col("w1") < F.col("w2")).distinct()
    holds = (wanted.join(node.withColumnRenamed("term", "w1"), "w1")
             .join(node.withColumnRenamed("term", "w2"), ["node_id", "w2"]))
    joint = holds.groupBy("w1", "w2").agg(F.count("*").alias("n_nodes"))
    sizes = node.groupBy("node_id").agg(F.count("*").alias("k"))
    marginal = (node.join(sizes, "node_id").groupBy("term")
                .agg(F.sum(2 * F.col("k")).alias("marginal")))
    return joint, marginal


def term_pmi(node_terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """ln joint − ln(m1·m2) with the joint count, per asked pair that co-occurs."""
    joint, marginal = term_pair_counts(node_terms, pairs)
    m1 = marginal.select(F.col("term").alias("w1"), F.col("marginal").alias("m1"))
    m2 = marginal.select(F.col("term").alias("w2"), F.col("marginal").alias("m2"))
    pmi = F.ln("n_nodes") - F.ln(F.col("m1").cast("double") * F.col("m2"))
    return (joint.join(m1, "w1").join(m2, "w2")
            .select("w1", "w2", pmi.alias("pmi"), "n_nodes"))
