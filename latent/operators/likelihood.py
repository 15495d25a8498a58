"""Log-likelihoods: joins and aggregates over the state tables, one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.functions.mathx import lgamma_sql, polya_empty, sql
from latent.operators.levels import located


def ll_flat(tokens: DataFrame, k: int, alpha: float, eta: float, n_terms: int) -> DataFrame:
    """Chain-of-topics score, each token's own count included.

    Grouping tokens by (topic, term) and by (document, topic) gives the same sum from two
    aggregates, with no join. A chain adds one edge term ln D − ln(D + γ − 1) per level; with
    γ = 1, as here, it is zero.
    """
    word = tokens.groupBy("z", "term").agg(F.count("*").alias("n"))
    topic = word.groupBy("z").agg(F.sum("n").alias("nwsum"),
                                  F.sum(F.col("n") * F.ln(F.col("n") + eta)).alias("s"))
    word_ll = topic.select((F.col("s") - F.col("nwsum")
                            * F.ln(F.col("nwsum") + n_terms * eta)).alias("x"))
    doc = tokens.groupBy("doc_id", "z").agg(F.count("*").alias("n"))
    per_doc = doc.groupBy("doc_id").agg(F.sum("n").alias("n_doc"),
                                        F.sum(F.col("n") * F.ln(F.col("n") + alpha)).alias("s"))
    doc_ll = per_doc.select((F.col("s") - F.col("n_doc")
                             * F.ln(F.col("n_doc") + k * alpha)).alias("x"))
    return word_ll.unionByName(doc_ll).agg(F.sum("x").alias("ll"))


def edge_terms(paths: DataFrame, gamma: float, m_dependent: bool = False) -> DataFrame:
    """ln of each child's share at its parent, once per child node."""
    nodes = paths.groupBy("node_id", "parent_id").agg(F.count("*").alias("ndsum"))
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("ndsum").alias("n_parent"))
    bottom = ((gamma + 1) * F.col("n_parent") - 1 if m_dependent
              else F.col("n_parent") + gamma - 1)
    return (nodes.join(parents, "parent_id")
            .select((F.ln("ndsum") - F.ln(bottom.cast("double"))).alias("x")))


def _slot_counts(tokens: DataFrame, slots: DataFrame):
    placed = located(tokens, slots)
    word = placed.groupBy("node_id", "term").agg(F.count("*").alias("n"))
    doc = placed.groupBy("doc_id", F.col("z").alias("slot")).agg(F.count("*").alias("nd"))
    return word, doc


def _word_terms(word: DataFrame, eta: float, eta_sum: float,
                eta_table: DataFrame | None = None) -> DataFrame:
    if eta_table is not None:
        word, eta = word.join(eta_table, "term"), F.col("eta")
    topic = word.groupBy("node_id").agg(F.sum("n").alias("nwsum"),
                                        F.sum(F.col("n") * F.ln(F.col("n") + eta)).alias("s"))
    return topic.select((F.col("s") - F.col("nwsum") * F.ln(F.col("nwsum") + eta_sum)).alias("x"))


def ll_tree(tokens: DataFrame, paths: DataFrame, alpha: float, eta: float, eta_sum: float,
            gamma: float, m_dependent: bool = False) -> DataFrame:
    """Edge terms, once per child, plus word and level terms of every token."""
    slots = paths.withColumnRenamed("level", "slot")
    word, doc = _slot_counts(tokens, slots)
    depth = paths.groupBy("doc_id").agg((F.count("*") * alpha).alias("alpha_sum"))
    per_doc = (doc.groupBy("doc_id").agg(F.sum("nd").alias("n_doc"),
                                         F.sum(F.col("nd") * F.ln(F.col("nd") + alpha)).alias("s"))
               .join(depth, "doc_id"))
    doc_ll = per_doc.select((F.col("s") - F.col("n_doc")
                             * F.ln(F.col("n_doc") + F.col("alpha_sum"))).alias("x"))
    return (edge_terms(paths, gamma, m_dependent).unionByName(_word_terms(word, eta, eta_sum))
            .unionByName(doc_ll).agg(F.sum("x").alias("ll")))


def ll_gem(tokens: DataFrame, paths: DataFrame, m: float, pi: float, eta: float, eta_sum: float,
           gamma: float) -> DataFrame:
    """As ``ll_tree`` with stick-breaking level terms."""
    from latent.operators.windows import gem_stick_prefix
    slots = paths.withColumnRenamed("level", "slot")
    word, doc = _slot_counts(tokens, slots)
    levels = (slots.join(doc, ["doc_id", "slot"], "left")
              .select("doc_id", F.col("slot").alias("level"),
                      F.coalesce("nd", F.lit(0).cast("long")).alias("n")))
    lp = (F.ln((1 - m) * pi + F.col("n")) - F.ln(pi + F.col("at_or_below")) + F.col("stick"))
    doc_ll = gem_stick_prefix(levels, m, pi).select((F.col("n") * lp).alias("x"))
    return (edge_terms(paths, gamma).unionByName(_word_terms(word, eta, eta_sum))
            .unionByName(doc_ll).agg(F.sum("x").alias("ll")))


def ll_labeled(tokens: DataFrame, doc_topics: DataFrame, eta: float, eta_sum: float,
               n_terms: int, eta_table: DataFrame | None = None) -> DataFrame:
    """Word term (−ln V under REJECT) plus ln(nd + α/T) − ln(N_d + α), T the list length.

    ``eta_table(term, eta)`` replaces the common prior by one per term.
    """
    placed = located(tokens, doc_topics)
    word = placed.groupBy("node_id", "term").agg(F.count("*").alias("n"))
    is_reject = F.col("node_id").startswith("REJECT")
    kept = _word_terms(word.where(~is_reject), eta, eta_sum, eta_table)
    rejected = word.where(is_reject).select((-F.col("n") * F.ln(F.lit(float(n_terms)))).alias("x"))
    nd = placed.groupBy("doc_id", F.col("z").alias("slot")).agg(F.count("*").alias("nd"))
    lists = doc_topics.groupBy("doc_id").agg(F.count("*").alias("t"))
    per_slot = (nd.join(doc_topics.select("doc_id", "slot", "alpha"), ["doc_id", "slot"])
                .join(lists, "doc_id")
                .join(nd.groupBy("doc_id").agg(F.sum("nd").alias("n_doc")), "doc_id"))
    doc_ll = per_slot.select((F.col("nd") * (F.ln(F.col("nd") + F.col("alpha") / F.col("t"))
                                             - F.ln(F.col("n_doc") + F.col("alpha")))).alias("x"))
    return kept.unionByName(rejected).unionByName(doc_ll).agg(F.sum("x").alias("ll"))


def ll_crosscat(cells: DataFrame, members: DataFrame, term_views: DataFrame, alpha: float,
                eta: float, eta_sum: float, n_docs: int, n_terms: int, xi: float,
                n_views: int) -> DataFrame:
    """Per view and cluster: Dirichlet-multinomial evidence and size prior; plus the view prior."""
    held = cells.join(term_views, "term").join(members, ["doc_id", "view"])
    word = held.groupBy("view", "cluster", "term").agg(F.sum("n").alias("n"))
    terms = word.select(polya_empty(float(eta), "n").alias("x"))
    sums = word.groupBy("view", "cluster").agg(F.sum("n").alias("nwsum"))
    clusters = members.groupBy("view", "cluster").agg(F.count("*").alias("ndsum")).join(
        sums, ["view", "cluster"], "left")
    size = F.expr(f"{lgamma_sql(float(eta_sum))} - "
                  f"{lgamma_sql(f'{sql(eta_sum)} + coalesce(nwsum, 0)')}")
    sizes = clusters.select((size + F.ln("ndsum") - F.ln(F.lit(n_docs - 1 + alpha))).alias("x"))
    views = (members.select("view").distinct()
             .join(term_views.groupBy("view").agg(F.count("*").alias("f")), "view", "left")
             .select((F.ln(F.coalesce("f", F.lit(0)) + xi)
                      - F.ln(F.lit(n_terms + n_views * xi))).alias("x")))
    return terms.unionByName(sizes).unionByName(views).agg(F.sum("x").alias("ll"))


def ll_soft_crosscat(draws: DataFrame) -> DataFrame:
    """Sum of ln p(chosen cluster) over the sweep's draws."""
    return draws.agg(F.sum(F.ln("chosen_probability")).alias("ll"))


def ll_clustered(tokens: DataFrame, features: DataFrame, t: int, alpha: float, xi: float,
                 xi_sum: float, eta: DataFrame, eta_sum: float) -> DataFrame:
    """Topic, document and feature terms; tokens(doc_id, term, pos, z, cluster).

    Features add n·ln(nw_f + eta_f) per feature of each token's word in its cluster.
    """
    tc = tokens.groupBy("z", "cluster").agg(F.count("*").alias("n"))
    word = (tc.groupBy("z").agg(F.sum("n").alias("nwsum"),
                                F.sum(F.col("n") * F.ln(F.col("n") + xi)).alias("s"))
            .select((F.col("s") - F.col("nwsum") * F.ln(F.col("nwsum") + xi_sum)).alias("x")))
    doc = tokens.groupBy("doc_id", "z").agg(F.count("*").alias("n"))
    docs = (doc.groupBy("doc_id").agg(F.sum("n").alias("n_doc"),
                                      F.sum(F.col("n") * F.ln(F.col("n") + alpha)).alias("s"))
            .select((F.col("s") - F.col("n_doc") * F.ln(F.col("n_doc") + t * alpha)).alias("x")))
    uses = (tokens.groupBy("term", "cluster").agg(F.count("*").alias("uses"))
            .join(features.select(F.col("word").alias("term"), "feature", F.col("n").alias("fn")),
                  "term"))
    cf = uses.groupBy("cluster", "feature").agg(F.sum(F.col("uses") * F.col("fn")).alias("nw"),
                                                F.sum("uses").alias("listed"))
    sums = cf.groupBy("cluster").agg(F.sum("nw").alias("nwsum"), F.sum("listed").alias("listed"))
    gain = cf.join(eta, "feature").select(
        (F.col("listed") * F.ln(F.col("nw") + F.col("eta"))).alias("x"))
    norm = sums.select((-F.col("listed") * F.ln(F.col("nwsum") + eta_sum)).alias("x"))
    return (word.unionByName(docs).unionByName(gain).unionByName(norm)
            .agg(F.sum("x").alias("ll")))


def ll_mixture(tokens: DataFrame, members: DataFrame, prior: str, xi: float, k: int, alpha: float,
               beta: float, beta_sum: float, n_docs: int, n_noise: int) -> DataFrame:
    """Cluster prior per document, signal tokens against their cluster, noise tokens theirs."""
    from latent.operators.levels import noise_slots
    placed = located(tokens, noise_slots(members, n_noise, alpha))
    word = placed.groupBy("node_id", "term").agg(F.count("*").alias("n"))
    parts = _word_terms(word, beta, beta_sum)
    nd = placed.groupBy("doc_id", "z").agg(F.count("*").alias("nd"))
    if n_noise > 0:
        sums = nd.groupBy("doc_id").agg(F.sum("nd").alias("n_doc"),
                                        F.sum(F.col("nd") * F.ln(F.col("nd") + alpha)).alias("s"))
        parts = parts.unionByName(sums.select(
            (F.col("s") - F.col("n_doc")
             * F.ln(F.col("n_doc") + (n_noise + 1) * alpha)).alias("x")))
    if prior != "uniform":
        live = (nd.where(F.col("z") == 0).join(members, "doc_id").groupBy("cluster")
                .agg(F.count("*").alias("ndsum")))
        held = members.groupBy("cluster").agg(F.count("*").alias("docs")).join(
            live, "cluster", "left").withColumn("ndsum", F.coalesce("ndsum", F.lit(0)))
        size = (F.ln(F.col("ndsum") + xi) - F.ln(F.lit(n_docs + k * xi)) if prior == "dirichlet"
                else F.ln("ndsum") - F.ln(F.lit(n_docs - 1 + xi)))
        if prior == "dp":
            held = held.where(F.col("ndsum") > 0)
        parts = parts.unionByName(held.select((F.col("docs") * size).alias("x")))
    return parts.agg(F.sum("x").alias("ll"))
