"""Token-level conditional scores.

A document offers a token some slots; each slot names the node whose word counts apply.
Flat topics, tree levels, views, label lists and noise topics differ only in that table:
``slots(doc_id, slot, node_id, alpha)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latent.operators.corpus import spread_join
from latent.operators.windows import gem_stick_prefix

# Up to so many nodes a term's counts travel as one map, which its tokens meet by the term alone.
FEW_NODES = 64


def topic_slots(doc_ids: DataFrame, k: int, alpha: float) -> DataFrame:
    """Slots of a flat model: every document may use every topic."""
    return doc_ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")
                          ).select("doc_id", "slot", F.col("slot").cast("string").alias("node_id"),
                                   F.lit(float(alpha)).alias("alpha"))


def located(tokens: DataFrame, slots: DataFrame) -> DataFrame:
    """Tokens with the node of their present slot."""
    at = slots.select("doc_id", F.col("slot").alias("z"), "node_id")
    return tokens.join(at, ["doc_id", "z"])


def slot_state(tokens: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts per (node, term), and slots with nd, nwsum, the document's Σα and N_d."""
    placed = located(tokens, slots)
    node_terms = placed.groupBy("node_id", "term").agg(F.count("*").alias("nw"))
    nd = placed.groupBy("doc_id", F.col("z").alias("slot"), "node_id").agg(F.count("*").alias("nd"))
    nwsum = nd.groupBy("node_id").agg(F.sum("nd").alias("nwsum"))
    zero = F.lit(0).cast("long")
    full = (slots.join(nd.drop("node_id"), ["doc_id", "slot"], "left")
            .join(nwsum, "node_id", "left")
            .withColumn("nd", F.coalesce("nd", zero))
            .withColumn("nwsum", F.coalesce("nwsum", zero)))
    per_doc = full.groupBy("doc_id").agg(F.sum("alpha").alias("alpha_sum"),
                                         F.sum("nd").alias("n_doc"))
    return node_terms, full.join(per_doc, "doc_id")


def _candidates(tokens: DataFrame, node_terms: DataFrame, full: DataFrame) -> DataFrame:
    return (tokens.join(full, "doc_id").join(node_terms, ["node_id", "term"], "left")
            .withColumn("own", (F.col("slot") == F.col("z")).cast("long"))
            .withColumn("nw", F.coalesce("nw", F.lit(0).cast("long"))))


def few_nodes(slots: DataFrame) -> bool:
    """Whether all documents' slots name at most FEW_NODES nodes, and none is null."""
    named = [r[0] for r in slots.select("node_id").distinct().limit(FEW_NODES + 1).collect()]
    return len(named) <= FEW_NODES and None not in named


def with_node_maps(rows: DataFrame, node_terms: DataFrame, hot=()) -> DataFrame:
    """``rows`` (term, any more columns) with ``_map``, the counts of their term by node. One equi join
    on the term; for few nodes, whose map is short. ``node_counts`` takes a list's counts from it."""
    maps = node_terms.where("node_id IS NOT NULL AND term IS NOT NULL").groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("node_id", "nw"))).alias("_map"))
    return spread_join(rows, maps, ["term"], list(hot), "term", "doc_id", "left")


def node_counts(nodes: str) -> Column:
    """From ``_map``, the counts of an array ``nodes`` of node ids."""
    return F.expr(f"transform({nodes}, x -> coalesce(_map[x], 0L))")


def _listed_candidates(tokens: DataFrame, node_terms: DataFrame, full: DataFrame) -> DataFrame:
    """As ``_candidates``; (document, term) pairs meet the counts by their term, and their document's
    slots after that, where they are listed."""
    pairs = tokens.groupBy("doc_id", "term").agg(F.collect_list(F.struct("pos", "z")).alias("_at"))
    per_doc = full.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        "slot", "node_id", "alpha", "nd", "nwsum", "alpha_sum", "n_doc"))).alias("_d"))
    met = with_node_maps(pairs, node_terms).join(per_doc, "doc_id").withColumn("nw", node_counts("_d.node_id"))
    back = met.select("doc_id", "term", F.inline(F.arrays_zip("_d", "nw")), "_at")
    return back.select("doc_id", "term", F.col("_d.*"), "nw", F.inline("_at")).withColumn(
        "own", (F.col("slot") == F.col("z")).cast("long"))


def word_part(eta, eta_sum: float) -> Column:
    return (F.ln(eta + F.col("nw") - F.col("own"))
            - F.ln(eta_sum + F.col("nwsum") - F.col("own")))


def score_levels(tokens: DataFrame, slots: DataFrame, eta: float, eta_sum: float,
                 skip_root: bool = False) -> DataFrame:
    """Log weight of every slot for every token, the token's own count removed.

    ``skip_root`` takes slot 0 out of the candidates; Σα still includes it.
    """
    meet = _listed_candidates if few_nodes(slots) else _candidates
    scored = meet(tokens, *slot_state(tokens, slots))
    doc = (F.ln(F.col("alpha") + F.col("nd") - F.col("own"))
           - F.ln(F.col("alpha_sum") + F.col("n_doc") - 1))
    if skip_root:
        scored = scored.where(F.col("slot") > 0)
    return scored.select("doc_id", "term", "pos", "slot",
                         (word_part(F.lit(float(eta)), eta_sum) + doc).alias("log_weight"))


def score_gem_levels(tokens: DataFrame, slots: DataFrame, m: float, pi: float, eta: float,
                     eta_sum: float) -> DataFrame:
    """Stick-breaking level scores, with one tail row (slot −1) for all deeper levels.

    Counts by level are those of the document without the token, so the windows run per
    (document, present slot of the removed token): at most levels² rows a document.
    """
    node_terms, full = slot_state(tokens, slots)
    removed = full.where(F.col("nd") > 0).select("doc_id", F.col("slot").alias("z"))
    levels = (full.join(removed, "doc_id")
              .withColumn("n", F.col("nd") - (F.col("slot") == F.col("z")).cast("long"))
              .withColumn("_doc", F.col("doc_id"))
              .withColumn("doc_id", F.struct("doc_id", "z"))
              .withColumnRenamed("slot", "level"))
    sticks = gem_stick_prefix(levels, m, pi)
    doc_lp = (F.ln(pi * (1 - m) + F.col("n")) - F.ln(pi + F.col("at_or_below")) + F.col("stick"))
    doc_part = sticks.select(F.col("_doc").alias("doc_id"), "z", F.col("level").alias("slot"),
                             "node_id", "nwsum", doc_lp.alias("lp"))
    scored = (tokens.join(doc_part, ["doc_id", "z"])
              .join(node_terms, ["node_id", "term"], "left")
              .withColumn("own", (F.col("slot") == F.col("z")).cast("long"))
              .withColumn("nw", F.coalesce("nw", F.lit(0).cast("long"))))
    eta_col = F.lit(float(eta))
    finite = scored.select("doc_id", "term", "pos", "slot",
                           (word_part(eta_col, eta_sum) + F.col("lp")).alias("log_weight"))
    left = doc_part.groupBy("doc_id", "z").agg((1 - F.sum(F.exp("lp"))).alias("rest"))
    tail = (tokens.join(left.where(F.col("rest") > 0), ["doc_id", "z"])
            .select("doc_id", "term", "pos", F.lit(-1).alias("slot"),
                    (F.ln("rest") + F.ln(eta_col / eta_sum)).alias("log_weight")))
    return finite.unionByName(tail)


def score_labels(tokens: DataFrame, doc_topics: DataFrame, eta: float, eta_sum: float,
                 n_terms: int) -> DataFrame:
    """As ``score_levels`` over each document's own topic list; N_d counts without the token.

    ``doc_topics`` is a slot table; a topic whose name starts with REJECT spreads its
    weight evenly over the vocabulary.
    """
    meet = _listed_candidates if few_nodes(doc_topics) else _candidates
    scored = meet(tokens, *slot_state(tokens, doc_topics))
    word = F.when(F.col("node_id").startswith("REJECT"), -F.ln(F.lit(float(n_terms)))).otherwise(
        word_part(F.lit(float(eta)), eta_sum))
    doc = (F.ln(F.col("alpha") + F.col("nd") - F.col("own"))
           - F.ln(F.col("alpha_sum") + F.col("n_doc") - 1))
    return scored.select("doc_id", "term", "pos", "slot", (word + doc).alias("log_weight"))


def score_soft_views(tokens: DataFrame, slots: DataFrame, eta: float, eta_sum: float,
                     xi: float) -> DataFrame:
    """View scores of a token. Slots are views, nodes the document's cluster in each view
    (or the view itself for the marginal form); ``alpha`` of the slot table is ξ."""
    return score_levels(tokens, slots.withColumn("alpha", F.lit(float(xi))), eta, eta_sum)


def score_clustered_topics(tokens: DataFrame, k: int, alpha: float, xi: float,
                           xi_sum: float) -> DataFrame:
    """Topic scores with the token's word cluster standing in for the word."""
    as_words = tokens.withColumn("_word", F.col("term")).withColumn(
        "term", F.col("cluster").cast("string")).withColumn("pos", F.struct("_word", "pos"))
    slots = topic_slots(tokens.select("doc_id").distinct(), k, alpha)
    scored = score_levels(as_words.drop("_word", "cluster"), slots, xi, xi_sum)
    return scored.select("doc_id", F.col("pos._word").alias("term"), F.col("pos.pos").alias("pos"),
                         "slot", "log_weight")


def score_noise(tokens: DataFrame, members: DataFrame, n_noise: int, alpha: float, beta: float,
                beta_sum: float) -> DataFrame:
    """Signal (the document's cluster, slot 0) against the noise topics, slots 1…N."""
    return score_levels(tokens, noise_slots(members, n_noise, alpha), beta, beta_sum)


def noise_slots(members: DataFrame, n_noise: int, alpha: float) -> DataFrame:
    node = F.when(F.col("slot") == 0, F.concat(F.lit("c"), "cluster")).otherwise(
        F.concat(F.lit("noise"), "slot"))
    return (members.select("doc_id", F.col("cluster").cast("string").alias("cluster"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_noise))).alias("slot"))
            .select("doc_id", "slot", node.alias("node_id"), F.lit(float(alpha)).alias("alpha")))
