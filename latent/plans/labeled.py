"""Models in which each document brings its own topic list."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.functions.mathx import lgamma_sql, sql
from latent.functions.sites import (DOC, Key, POS, TERM, sample_site, site_gaussian, site_integer, site_uniform)
from latent.operators.corpus import Corpus, batch_of, check_eta_sum, expand_tokens
from latent.operators.likelihood import ll_labeled
from latent.operators.structure import (add_reject, ancestor_topics, as_slots, contract_tree,
                                        cull_unique_topics, nodes_naming_docs, sense_paths,
                                        tree_edges_to_tree, with_noise_topics)
from latent.plans.arrival import TokenModel
from latent.plans.flat import redraw_slots, token_uniform
from latent.plans.loop import Fitted, Model, Run, State, fit, whole
from latent.session import Workspace


def draw_in_list(tokens: DataFrame, slots: DataFrame, seed: int) -> DataFrame:
    """Uniform first slot within each document's own list."""
    sizes = slots.groupBy("doc_id").agg(F.count("*").cast("int").alias("_size"))
    z = site_integer(Key("_size"), seed, "init", DOC, TERM, POS)
    return tokens.drop("z").join(sizes, "doc_id").withColumn("z", z).drop("_size")


def learn_eta(node_terms: DataFrame, eta: DataFrame, seed: int, it: int
              ) -> tuple[DataFrame, float, float]:
    """One joint Metropolis step on per-term priors over all nodes.

    A term moves with probability 0.005 by N(0,1)/10, not below 1e-4. Returns the proposed
    table, its log acceptance ratio and the proposed sum; the caller keeps or drops it.
    """
    moves = site_uniform(seed, it, "eta", TERM) < 0.005
    step = F.col("eta") + site_gaussian(seed, it, "eta-step", TERM) / 10.0
    both = eta.withColumn("new_eta", F.when(moves, F.greatest(F.lit(1e-4), step))
                          .otherwise(F.col("eta")))
    prior = both.agg(F.sum(F.expr(f"{lgamma_sql('eta')} - {lgamma_sql('new_eta')}")),
                     F.sum("eta"), F.sum("new_eta")).first()
    moved = both.where(F.col("eta") != F.col("new_eta"))
    data = (node_terms.join(moved, "term").agg(F.sum(
        F.expr(f"{lgamma_sql('new_eta + n')} - {lgamma_sql('eta + n')}")))
        .first()[0]) or 0.0
    sums = node_terms.groupBy("node_id").agg(F.sum("n").alias("nwsum")).agg(
        F.count("*"), F.sum(F.expr(f"{lgamma_sql(f'nwsum + {sql(prior[1])}')} - "
                                  f"{lgamma_sql(f'nwsum + {sql(prior[2])}')}"))).first()
    per_node = prior[0] + math.lgamma(prior[2]) - math.lgamma(prior[1])
    proposed = both.select("term", F.col("new_eta").alias("eta"))
    return proposed, sums[0] * per_node + data + (sums[1] or 0.0), prior[2]


class LabeledLDA(TokenModel):
    """Tokens choose among ``doc_topics(doc_id, topic)``; documents without a list sit out."""

    kind = "labeled"
    learned_names = ("eta",)

    def learned(self):
        return {} if self.eta_table is None else {"eta": self.eta_table}

    def restore(self, learned, numbers):
        if "eta" in learned:
            self.eta_table = learned["eta"]
            self.eta_sum = self.eta_table.agg(F.sum("eta")).first()[0]

    def __init__(self, corpus: Corpus, run: Run, workspace: Workspace, doc_topics: DataFrame,
                 alpha: float = 0.1, eta: float = 0.1, learn: bool = False):
        super().__init__(corpus, run, workspace, alpha=alpha, eta=eta)
        self.alpha, self.eta, self.learn = alpha, eta, learn
        self.slots = workspace.cut(as_slots(doc_topics.distinct(), alpha), "slots", pin=True)
        self.eta_sum = check_eta_sum(corpus.n_terms, eta)
        self.eta_table: DataFrame | None = None

    def token_cells(self):
        return self.corpus.cells.join(self.slots.select("doc_id").distinct(), "doc_id",
                                      "left_semi")

    def first_slot(self, tokens):
        return draw_in_list(tokens, self.slots, self.run.seed)

    def redraw(self, part, tokens, u):
        return redraw_slots(part, tokens, self.slots, self.eta, self.corpus, u,
                            eta_sum=self.eta_sum, eta_table=self.eta_table)

    def sweep(self, state: State, it: int) -> State:
        state = super().sweep(state, it)
        return self._renew_eta(state, it) if self.learn else state

    def _renew_eta(self, state: State, it: int) -> State:
        table = self.eta_table
        if table is None:
            table = self.corpus.vocab.select("term", F.lit(float(self.eta)).alias("eta"))
        at = self.slots.select("doc_id", F.col("slot").alias("z"), "node_id")
        node_terms = self.ws.cut(whole(state["tokens"]).join(at, ["doc_id", "z"])
                                 .groupBy("node_id", "term").agg(F.count("*").alias("n")),
                                 "node_terms")
        proposed, log_ratio, new_sum = learn_eta(node_terms, table, self.run.seed, it)
        u = self.ws.spark.range(1).select(site_uniform(self.run.seed, it, "eta-accept")).first()[0]
        if math.log(max(u, 1e-300)) < log_ratio:
            self.eta_table = self.ws.cut(proposed, "eta", pin=True)
            self.eta_sum = new_sum
        return state

    def log_likelihood(self, state: State) -> float:
        return ll_labeled(whole(state["tokens"]), self.slots, self.eta, self.eta_sum,
                          self.corpus.n_terms, self.eta_table).first()[0]

    def tables(self, state: State):
        return {**super().tables(state), "doc_topics": self.slots}


def fit_labeled_lda(cells: DataFrame, doc_topics: DataFrame, alpha: float = 0.1,
                    eta: float = 0.1, noise: int = 0, cull: bool = False,
                    run: Run = Run(), learn: bool = False) -> Fitted:
    """Labeled topics. ``doc_topics(doc_id, topic)``; culling also needs name and pos."""
    ws = Workspace(cells.sparkSession)
    topics = cull_unique_topics(doc_topics)[0] if cull else doc_topics
    topics = topics.select("doc_id", "topic")
    if noise:
        topics = with_noise_topics(topics, noise)
    return fit(LabeledLDA(Corpus.build(ws, cells), run, ws, topics, alpha, eta, learn))


def fit_fixed_tree(cells: DataFrame, docs: DataFrame, edges: DataFrame, alpha: float = 0.1,
                   eta: float = 0.1, use_dag: bool = False, fold_non_wn: bool = False,
                   reject: bool = False, contract: bool = True, run: Run = Run(),
                   learn: bool = False) -> Fitted:
    """A document may use the topics of its node and all its ancestors in a given hierarchy.

    ``docs(doc_id, name)`` are found in the hierarchy by name.
    """
    ws = Workspace(cells.sparkSession)
    links = tree_edges_to_tree(edges, use_dag)
    if contract:
        links = contract_tree(links, ws)[1]
    links = ws.cut(links, "edges", pin=True)
    topics = ancestor_topics(nodes_naming_docs(links, docs), links, fold_non_wn, ws)
    if reject:
        topics = add_reject(topics)
    return fit(LabeledLDA(Corpus.build(ws, cells), run, ws, topics, alpha, eta, learn))


class SenseSelection(Model):
    """One of a document's sense paths is active each sweep.

    The levels of the idle senses are redrawn before senses are scored, each as if it were the
    active one, so that all compete with levels that suit them.
    """

    kind = "senses"
    state_names = ("tokens", "chosen")

    def __init__(self, corpus: Corpus, run: Run, workspace: Workspace, senses: DataFrame,
                 alpha: float = 0.1, eta: float = 0.1):
        super().__init__(corpus, run, workspace, alpha=alpha, eta=eta)
        self.alpha, self.eta = alpha, eta
        self.eta_sum = check_eta_sum(corpus.n_terms, eta)
        self.senses = workspace.cut(senses, "senses", pin=True)
        self.n_senses = (self.senses.agg(F.max("sense")).first()[0] or 0) + 1

    def start(self) -> State:
        run = self.run
        batch = batch_of(run.batches, run.seed, DOC)
        depths = self.senses.groupBy("doc_id", "sense").agg(F.count("*").cast("int").alias("_d"))
        z = site_integer(Key("_d"), run.seed, "init", DOC, Key("sense"),
                         TERM, POS)
        tokens = (expand_tokens(self.corpus.cells).join(depths, "doc_id")
                  .withColumn("z", z).withColumn("batch", batch).drop("_d"))
        chosen = (self.senses.select("doc_id").distinct().withColumn("sense", F.lit(0))
                  .withColumn("batch", batch))
        return {"tokens": self.split(tokens, "tokens"), "chosen": self.split(chosen, "chosen")}

    def active(self, state: State) -> DataFrame:
        return whole(state["tokens"]).join(whole(state["chosen"]).select("doc_id", "sense"),
                                           ["doc_id", "sense"])

    def active_slots(self, state: State) -> DataFrame:
        return (self.senses.join(whole(state["chosen"]).select("doc_id", "sense"),
                                 ["doc_id", "sense"])
                .select("doc_id", F.col("level").alias("slot"), "node_id",
                        F.lit(float(self.alpha)).alias("alpha")))

    def sense_scores(self, state: State, docs: DataFrame) -> DataFrame:
        """Scores of every sense of ``docs``, the document's tokens counted under that sense.

        Counts of other documents are those of their active senses.
        """
        at = self.senses.select("doc_id", "sense", F.col("level").alias("z"), "node_id")
        placed = whole(state["tokens"]).join(at, ["doc_id", "sense", "z"])
        now = placed.join(whole(state["chosen"]).select("doc_id", "sense"), ["doc_id", "sense"])
        counts = now.groupBy("node_id", "term").agg(F.count("*").alias("nw"))
        sums = counts.groupBy("node_id").agg(F.sum("nw").alias("nwsum"))
        mine = placed.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy(
            "doc_id", "sense", "node_id", "term").agg(F.count("*").alias("own"))
        mine = self.ws.cut(mine, "own-senses")
        home = docs.select("doc_id", F.col("sense").alias("now"))
        live = (mine.join(home, "doc_id").where(F.col("sense") == F.col("now"))
                .select("doc_id", "node_id", "term", F.col("own").alias("live")))

        def rest(total: str) -> str:
            return f"(coalesce({total}, 0) - coalesce(live, 0) + coalesce(own, 0))"

        nodes = self.senses.join(docs.select("doc_id"), "doc_id", "left_semi")
        own_sum = mine.groupBy("doc_id", "sense", "node_id").agg(F.sum("own").alias("own"))
        live_sum = live.groupBy("doc_id", "node_id").agg(F.sum("live").alias("live"))
        length = self.corpus.docs.select("doc_id", "n_doc")
        e = lgamma_sql(float(self.eta))
        base = (nodes.join(length, "doc_id").join(sums, "node_id", "left")
                .join(own_sum, ["doc_id", "sense", "node_id"], "left")
                .join(live_sum, ["doc_id", "node_id"], "left")
                .groupBy("doc_id", "sense")
                .agg(F.sum(F.expr(f"n_doc * ({e} - "
                                  f"{lgamma_sql(sql(self.eta_sum) + ' + ' + rest('nwsum'))})"))
                     .alias("base"),
                    F.max("log_freq").alias("log_freq")))
        near = (self.corpus.cells.join(nodes.select("doc_id", "sense", "node_id"), "doc_id")
                .join(counts, ["node_id", "term"], "left")
                .join(mine, ["doc_id", "sense", "node_id", "term"], "left")
                .join(live, ["doc_id", "node_id", "term"], "left")
                .withColumn("_n", F.expr(rest("nw")))
                .where(F.col("_n") > 0))
        gain = near.groupBy("doc_id", "sense").agg(F.sum(
            F.expr(f"n * ({lgamma_sql(sql(self.eta) + ' + _n')} - {e})")).alias("gain"))
        return (base.join(gain, ["doc_id", "sense"], "left")
                .select("doc_id", "sense", (F.col("base") + F.coalesce("gain", F.lit(0.0))
                                            + F.col("log_freq")).alias("log_weight")))

    def sweep(self, state: State, it: int) -> State:
        seed = self.run.seed

        def choose(s: State, part: DataFrame, b: int) -> DataFrame:
            u = site_uniform(seed, it, "sense", DOC)
            picked = sample_site(self.sense_scores(s, part), ["doc_id"], "sense", u)
            to = picked.select("doc_id", F.col("sense").alias("_to"))
            # A document whose senses all have weight zero keeps the one it has.
            return (part.join(to, "doc_id", "left")
                    .withColumn("sense", F.coalesce("_to", "sense")).drop("_to"))

        def prepare(s: State, part: DataFrame, b: int) -> DataFrame:
            """New levels for the idle senses: each in turn stands in for the active one."""
            chosen = s["chosen"][b].select("doc_id", "sense")
            idle = part.join(chosen, ["doc_id", "sense"], "left_anti")
            drawn = [part.join(chosen, ["doc_id", "sense"]).select(*part.columns)]
            active, slots = self.active(s), self.active_slots(s)
            for k in range(self.n_senses):
                mine = self.ws.cut(idle.where(F.col("sense") == k), "idle")
                docs = mine.select("doc_id").distinct()
                tokens = active.select("doc_id", "term", "pos", "z").join(
                    docs, "doc_id", "left_anti").unionByName(
                    mine.select("doc_id", "term", "pos", "z"))
                theirs = self.senses.where(F.col("sense") == k).join(docs, "doc_id").select(
                    "doc_id", F.col("level").alias("slot"), "node_id",
                    F.lit(float(self.alpha)).alias("alpha"))
                known = slots.join(docs, "doc_id", "left_anti").unionByName(theirs)
                drawn.append(redraw_slots(mine, tokens, known, self.eta, self.corpus, token_uniform(
                    seed, it, f"idle{k}")).select(*part.columns))
            return whole(drawn)

        state = self.each_batch(state, "tokens", prepare)
        state = self.each_batch(state, "chosen", choose)

        def relevel(s: State, part: DataFrame, b: int) -> DataFrame:
            chosen = s["chosen"][b].select("doc_id", "sense")
            live = part.join(chosen, ["doc_id", "sense"])
            idle = part.join(chosen, ["doc_id", "sense"], "left_anti")
            drawn = redraw_slots(live, self.active(s), self.active_slots(s), self.eta,
                                 self.corpus, token_uniform(seed, it, "z"))
            return drawn.unionByName(idle)

        return self.each_batch(state, "tokens", relevel)

    def log_likelihood(self, state: State) -> float:
        return ll_labeled(self.active(state), self.active_slots(state), self.eta, self.eta_sum,
                          self.corpus.n_terms).first()[0]


def fit_sense_selection(cells: DataFrame, doc_nodes: DataFrame, edges: DataFrame,
                        alpha: float = 0.1, eta: float = 0.1, run: Run = Run()) -> Fitted:
    """Choose, sweep by sweep, under which parent of its node each document stands.

    ``doc_nodes(doc_id, node)``, ``edges(child, parent[, freq])``.
    """
    ws = Workspace(cells.sparkSession)
    senses = sense_paths(doc_nodes, edges, ws)
    listed = cells.join(doc_nodes.select("doc_id"), "doc_id", "left_semi")
    return fit(SenseSelection(Corpus.build(ws, listed), run, ws, senses, alpha, eta))
