"""Token resampling shared by the models, in its two physical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.functions.kernels import flat_draw, list_draw
from latent.functions.sites import DOC, POS, TERM, site_uniform
from latent.operators.corpus import Corpus, spread_join
from latent.operators.counts import topic_array
from latent.operators.levels import few_nodes, node_counts, slot_state, with_node_maps


def zeros(k: int):
    return F.array_repeat(F.lit(0).cast("long"), k)


def token_uniform(seed: int, it: int, step: str):
    return site_uniform(seed, it, step, DOC, TERM, POS)


def topic_totals(counts: DataFrame, k: int, column: str) -> list[int]:
    """Column sums of per-topic count arrays: k scalars."""
    row = counts.agg(F.expr(f"array({', '.join(f'sum(get({column}, {i}))' for i in range(k))})")
                     ).first()[0]
    return [int(x or 0) for x in row]


def redraw_topics(part: DataFrame, tokens: DataFrame, k: int, alpha, eta: float, corpus: Corpus,
                  u, ws, word: str = "term", eta_sum: float | None = None,
                  first: int = 0) -> DataFrame:
    """New topics for the tokens of ``part`` given all ``tokens``, when topics are shared.

    Counts travel as one array per term and one per document, so a token meets its
    candidates in two joins and nothing is exploded. ``tokens`` holds only placed tokens.
    """
    hot = corpus.hot if word == "term" else []
    nw = ws.cut(tokens.groupBy(word).agg(topic_array(k).alias("nw")), "nw")
    nd = tokens.groupBy("doc_id").agg(topic_array(k).alias("nd"))
    totals = topic_totals(nw, k, "nw")
    draw = flat_draw(k, alpha, corpus.n_terms * eta if eta_sum is None else eta_sum, totals, first)
    met = spread_join(part, nw, [word], hot, word, "doc_id", "left")
    met = spread_join(met, nd, ["doc_id"], corpus.hot_docs, "doc_id", "term", "left")
    z = draw(F.coalesce("nw", zeros(k)), F.coalesce("nd", zeros(k)), "z", F.lit(float(eta)), u)
    return met.withColumn("z", z).select(*part.columns)


def slot_lists(part: DataFrame, node_terms: DataFrame, full: DataFrame, corpus: Corpus,
               few: bool = False):
    """Tokens with their slots' counts as lists in slot order.

    Of few nodes a token takes its term's counts along and meets its document's lists once, with
    no row per slot. Of many, the (document, term) pairs, not the tokens, meet (node, term)
    counts; tokens of one pair share the answer.
    """
    reject = F.col("node_id").startswith("REJECT").cast("int").alias("reject")
    if few:
        per_doc = (full.groupBy("doc_id").agg(F.sort_array(F.collect_list(
            F.struct("slot", "nd", "nwsum", "alpha", reject, "node_id"))).alias("d"))
            .select("doc_id", *[F.col(f"d.{c}").alias(c) for c in ("nd", "nwsum", "alpha", "reject")],
                    F.col("d.node_id").alias("_nodes")))
        met = spread_join(with_node_maps(part.where("term IS NOT NULL"), node_terms, corpus.hot), per_doc,
                          ["doc_id"], corpus.hot_docs, "doc_id", "term")
        return met.withColumn("nw", node_counts("_nodes")).drop("_nodes", "_map")
    pairs = part.select("doc_id", "term").distinct()
    per_slot = full.select("doc_id", "slot", "node_id")
    met = spread_join(pairs, per_slot, ["doc_id"], corpus.hot_docs, "doc_id", "term")
    met = spread_join(met, node_terms, ["node_id", "term"], corpus.hot, "term", "doc_id", "left")
    nw = (met.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list(
        F.struct("slot", F.coalesce("nw", F.lit(0).cast("long")).alias("nw")))).alias("s"))
        .select("doc_id", "term", F.col("s.nw").alias("nw")))
    per_doc = (full.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("slot", "nd", "nwsum", "alpha", reject))).alias("d"))
        .select("doc_id", *[F.col(f"d.{c}").alias(c) for c in ("nd", "nwsum", "alpha", "reject")]))
    return spread_join(part.join(nw, ["doc_id", "term"]), per_doc, ["doc_id"], corpus.hot_docs,
                       "doc_id", "term")


def redraw_slots(part: DataFrame, tokens: DataFrame, slots: DataFrame, eta: float, corpus: Corpus,
                 u, k: int | None = None, alpha=None, first: int = 0, stick=None,
                 eta_sum: float | None = None, eta_table: DataFrame | None = None) -> DataFrame:
    """New slots for the tokens of ``part``; with ``k`` every document has k slots.

    ``eta_table(term, eta)`` replaces the common prior by one per term.
    """
    eta_sum = corpus.n_terms * eta if eta_sum is None else eta_sum
    node_terms, full = slot_state(tokens, slots)
    met = slot_lists(part, node_terms, full, corpus, few_nodes(slots))
    prior = F.lit(float(eta))
    if eta_table is not None:
        met = spread_join(met, eta_table.withColumnRenamed("eta", "_eta"), ["term"], corpus.hot,
                          "term", "doc_id")
        prior = F.col("_eta")
    if k is None:
        draw = list_draw(eta_sum, corpus.n_terms)
        z = draw("nw", "nwsum", "nd", "alpha", "reject", "z", prior, u)
    else:
        draw = flat_draw(k, alpha, eta_sum, first=first, stick=stick)
        z = draw("nw", "nwsum", "nd", "z", prior, u)
    return met.withColumn("z", z).select(*part.columns)
