"""Readable summaries of states and the read-side analysis of saved samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latent.operators.windows import top_terms
from latent.session import Workspace

TOLERANCE = 1e-6
SMALL_NODE = 10_000


def _listed(node_terms: DataFrame, key: str, k: int) -> DataFrame:
    ranked = top_terms(node_terms, k, key)
    return (ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "term")))
                                    .alias("t"))
            .select(key, F.array_join(F.col("t.term"), " ").alias("top")))


def tree_summary(tokens: DataFrame, paths: DataFrame, k: int = 10) -> DataFrame:
    """Level, documents, tokens and top terms per node."""
    at = paths.select("doc_id", F.col("level").alias("z"), "node_id")
    terms = tokens.join(at, ["doc_id", "z"]).groupBy("node_id", "term").agg(
        F.count("*").alias("n"))
    sizes = terms.groupBy("node_id").agg(F.sum("n").alias("tokens"))
    return (paths.groupBy("node_id", "level").agg(F.count("*").alias("docs"))
            .join(sizes, "node_id", "left").join(_listed(terms, "node_id", k), "node_id", "left")
            .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long"))))


def view_summary(tokens: DataFrame, k: int = 10) -> DataFrame:
    """Features, tokens and top terms per view; tokens(view, term, n)."""
    terms = tokens.groupBy("view", "term").agg(F.sum("n").alias("n"))
    return (terms.groupBy("view").agg(F.count("*").alias("features"), F.sum("n").alias("tokens"))
            .join(_listed(terms, "view", k), "view"))


def cluster_summary(members: DataFrame, held: DataFrame, k: int = 10) -> DataFrame:
    """Size, documents with tokens, tokens and top terms per (view, cluster).

    ``held(doc_id, view, term, n)`` are the cells of each view.
    """
    key = F.concat_ws("/", F.col("view").cast("string"), F.col("cluster").cast("string"))
    sizes = members.groupBy("view", "cluster").agg(F.count("*").alias("size"))
    rows = held.join(members.select("doc_id", "view", "cluster"), ["doc_id", "view"])
    terms = rows.groupBy(key.alias("key"), "term").agg(F.sum("n").alias("n"))
    docs = (rows.groupBy("view", "cluster", "doc_id").agg(F.sum("n").alias("n"))
            .groupBy("view", "cluster").agg(F.count("*").alias("nonzero_docs"),
                                            F.sum("n").alias("tokens")))
    zero = F.lit(0).cast("long")
    return (sizes.join(docs, ["view", "cluster"], "left").withColumn("key", key)
            .join(_listed(terms, "key", k), "key", "left").drop("key")
            .withColumn("nonzero_docs", F.coalesce("nonzero_docs", zero))
            .withColumn("tokens", F.coalesce("tokens", zero)))


def noise_summary(tokens: DataFrame, k: int = 10) -> DataFrame:
    """Tokens and top terms of each noise topic (slot above 0), with all tokens beside."""
    slots = tokens.groupBy("z", "term").agg(F.count("*").alias("n"))
    total = slots.agg(F.sum("n")).first()[0]
    noise = slots.where(F.col("z") > 0)
    return (noise.groupBy("z").agg(F.sum("n").alias("tokens"))
            .withColumn("all_tokens", F.lit(total)).join(_listed(noise, "z", k), "z"))


def quantize(node_terms: DataFrame, tol: float = TOLERANCE, keep_small: int | None = None
             ) -> DataFrame:
    """Terms holding over ``tol`` of their node; nodes under ``keep_small`` tokens keep all."""
    sums = node_terms.groupBy("node_id").agg(F.sum("n").alias("_sum"))
    keep = F.col("n") / F.col("_sum") > tol
    if keep_small is not None:
        keep = keep | (F.col("_sum") < keep_small)
    return node_terms.join(sums, "node_id").where(keep).drop("_sum")


def skip_noise(nodes: DataFrame, label: str = "label") -> DataFrame:
    return nodes.where(~F.col(label).startswith("NOISE"))


def sample_distributions(node_terms: DataFrame, node_docs: DataFrame, tol: float = TOLERANCE
                         ) -> tuple[DataFrame, DataFrame]:
    """Node–term and node–document sums over samples; each table reads both ways.

    Terms are quantised within their sample first.
    """
    sample = ["chain_id", "iter", "node_id"]
    sums = node_terms.groupBy(*sample).agg(F.sum("n").alias("_sum"))
    kept = node_terms.join(sums, sample).where(F.col("n") / F.col("_sum") > tol)
    return (kept.groupBy("chain_id", "node_id", "term").agg(F.sum("n").alias("n")),
            node_docs.groupBy("chain_id", "node_id", "doc_id").agg(F.sum("n").alias("n")))


def parents_of_nodes(edges: DataFrame) -> DataFrame:
    """Distinct parents per node over all samples."""
    return (edges.select("child_id", "parent_id").distinct().groupBy(
        F.col("child_id").alias("node_id"))
        .agg(F.sort_array(F.collect_list("parent_id")).alias("parents")))


def node_summary(node_terms: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Each node with its parents and top terms."""
    return (_listed(node_terms, "node_id", k).join(parents_of_nodes(edges), "node_id", "left")
            .select("node_id", F.array_join("parents", " ").alias("parents"), "top"))


def restrict_docs(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.join(docs.select("doc_id"), "doc_id", "left_semi")


def listed_shares(doc_topics: DataFrame, node_docs: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, node_id, p_node): smoothed share of each topic in a document's list."""
    counts = doc_topics.join(node_docs, ["doc_id", "node_id"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long")))
    sums = counts.groupBy("doc_id").agg(F.sum("n").alias("dsum"), F.count("*").alias("t"))
    share = (F.col("n") + alpha) / (F.col("dsum") + alpha * F.col("t"))
    return counts.join(sums, "doc_id").select("doc_id", "node_id", share.alias("p_node"))


def observed_shares(node_docs: DataFrame, n_topics: int, alpha: float) -> DataFrame:
    """The same over the topics a document has tokens in; the number of topics is given."""
    sums = node_docs.groupBy("doc_id").agg(F.sum("n").alias("dsum"))
    share = (F.col("n") + alpha) / (F.col("dsum") + alpha * n_topics)
    return node_docs.join(sums, "doc_id").select("doc_id", "node_id", share.alias("p_node"))


def term_shares(node_terms: DataFrame, n_terms: int, eta: float) -> DataFrame:
    """(node_id, term, phi): smoothed share of each term that a topic holds."""
    wsum = node_terms.groupBy("node_id").agg(F.sum("n").alias("wsum"))
    return node_terms.join(wsum, "node_id").select(
        "node_id", "term", ((F.col("n") + eta) / (F.col("wsum") + eta * n_terms)).alias("phi"))


def _mixed(shares: DataFrame, cells: DataFrame, phi: DataFrame) -> DataFrame:
    """(doc_id, term, p) of the asked cells of which some topic of the document holds the term."""
    return (cells.join(shares, "doc_id").join(phi, ["node_id", "term"])
            .groupBy("doc_id", "term").agg(F.sum(F.col("p_node") * F.col("phi")).alias("p")))


def smoothed_cells(shares: DataFrame, phi: DataFrame, asked: DataFrame) -> DataFrame:
    """ln p(term | doc) of the ``asked`` cells (doc_id, term) only.

    Repeated cells count once; a term that no topic of its document holds gives no row.
    """
    cells = asked.select("doc_id", "term").distinct()
    return _mixed(shares, cells, phi).select("doc_id", "term", F.ln("p").alias("log_p"))


def best_terms(shares: DataFrame, phi: DataFrame, k: int, ws: Workspace,
               deeper: int = 4) -> DataFrame:
    """The ``k`` likeliest terms of each document: doc_id, rank, term, log_p; equal log_p (to
    nine digits) go by term.

    A threshold walk: each round reads the topics' lists of terms, likeliest first, down to a
    depth, and scores the terms met there. A term not met is at most as likely as the mixture of
    the shares at that depth, so a document whose k-th term beats it is done; the others go
    ``deeper`` times as deep. Rows are at most documents × topics × depth, never × terms.
    """
    phi, todo = ws.cut(phi, "phi"), ws.cut(shares, "shares")
    by_node = Window.partitionBy("node_id").orderBy(F.desc("phi"), "term")
    by_doc = Window.partitionBy("doc_id").orderBy(F.desc("log_p"), "term")
    found, depth = [], 2 * k
    while not todo.isEmpty():
        heads = ws.cut(phi.withColumn("r", F.row_number().over(by_node)).where(
            F.col("r") <= depth), "heads")
        met = todo.join(heads, "node_id").select("doc_id", "term").distinct()
        best = ws.cut(_mixed(todo, met, phi).withColumn("log_p", F.round(F.ln("p"), 9))
                      .withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= k)
                      .select("doc_id", "rank", "term", "log_p"), "best")
        # A list that ended before the depth has no more terms to give.
        floor = heads.where(F.col("r") == depth).select("node_id", F.col("phi").alias("floor"))
        most = todo.join(floor, "node_id", "left").groupBy("doc_id").agg(
            F.sum(F.col("p_node") * F.coalesce("floor", F.lit(0.0))).alias("most"))
        last = best.where(F.col("rank") == k).select("doc_id", F.col("log_p").alias("last"))
        done = ws.cut(most.join(last, "doc_id", "left").where(
            (F.col("most") == 0) | (F.col("last") > F.ln("most") + 1e-8)).select("doc_id"), "done")
        found.append(best.join(done, "doc_id", "left_semi"))
        todo = ws.cut(todo.join(done, "doc_id", "left_anti"), "todo")
        depth *= deeper
    out = found[0] if found else todo.select("doc_id", F.lit(0).alias("rank"), F.lit("").alias(
        "term"), F.lit(0.0).alias("log_p"))
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _smoothed(shares: DataFrame, phi: DataFrame) -> DataFrame:
    p = F.sum(F.col("p_node") * F.col("phi"))
    return (shares.join(phi, "node_id").groupBy("doc_id", "term").agg(F.ln(p).alias("log_p")))


def smoothed_terms(doc_topics: DataFrame, node_docs: DataFrame, node_terms: DataFrame,
                   n_terms: int, alpha: float, eta: float) -> DataFrame:
    """ln p(term | doc) over each document's listed topics (doc_id, node_id), for every term of
    them: ``smoothed_cells`` and ``best_terms`` give what is asked for only."""
    return _smoothed(listed_shares(doc_topics, node_docs, alpha),
                     term_shares(node_terms, n_terms, eta))


def smoothed_terms_observed(node_docs: DataFrame, node_terms: DataFrame, n_terms: int,
                            n_topics: int, alpha: float, eta: float) -> DataFrame:
    """As ``smoothed_terms`` over the topics a document has tokens in; V and T are given."""
    return _smoothed(observed_shares(node_docs, n_topics, alpha),
                     term_shares(node_terms, n_terms, eta))


__all__ = ["tree_summary", "view_summary", "cluster_summary", "noise_summary", "quantize",
           "skip_noise", "sample_distributions", "parents_of_nodes", "node_summary",
           "restrict_docs", "listed_shares", "observed_shares", "term_shares", "smoothed_cells",
           "best_terms", "smoothed_terms", "smoothed_terms_observed"]
