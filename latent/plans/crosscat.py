"""Multi-view clusterings: features split into views, documents clustered in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.functions.mathx import polya_gain
from latent.functions.sites import DOC, POS, TERM, site_integer
from latent.operators.buckets import bucket_draw, polya_base, polya_fresh
from latent.operators.clusters import (cluster_sizes, cluster_terms, mh_accept_feature,
                                       move_feature, open_views, propose_views, shared_gain,
                                       sites_of, view_cells)
from latent.operators.corpus import Corpus, batch_of, binarize, check_eta_sum, expand_tokens
from latent.operators.likelihood import ll_crosscat, ll_soft_crosscat
from latent.plans.arrival import doc_waves, wave_count
from latent.plans.flat import redraw_slots, redraw_topics, token_uniform
from latent.plans.loop import Fitted, Model, Run, State, fit, whole
from latent.plans.rounds import draw_clusters, replace_members
from latent.session import Workspace


def views_of(n_views: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n_views - 1)).cast("array<long>"))


class ViewModel(Model):
    """Shared parts of the hard and the soft form."""

    def __init__(self, corpus: Corpus, run: Run, workspace: Workspace, views: int, kmax: int,
                 noise_view: bool, alpha: float, eta: float, xi: float, **more):
        super().__init__(corpus, run, workspace, views=views, kmax=kmax, noise_view=noise_view,
                         alpha=alpha, eta=eta, xi=xi, **more)
        self.views, self.kmax, self.noise_view = views, kmax, noise_view
        self.alpha, self.eta, self.xi = alpha, eta, xi
        self.eta_sum = check_eta_sum(corpus.n_terms, eta)

    def sites(self, members: DataFrame, pending: DataFrame, vcells: DataFrame,
              sizes: DataFrame) -> DataFrame:
        """Sites that draw, with ``may_found`` where they may ask for a new cluster."""
        return pending_sites(members, pending, vcells).withColumn("may_found", F.lit(True))

    def drawer(self, vcells: DataFrame):
        def draw(members: DataFrame, pending: DataFrame, u) -> DataFrame:
            terms = self.ws.cut(cluster_terms(vcells, members), "terms")
            sizes = self.ws.cut(cluster_sizes(members, terms), "sizes")
            sites = self.ws.cut(self.sites(members, pending, vcells, sizes), "sites")
            gain = shared_gain(sites, vcells, terms, polya_gain(self.eta, "_rest", "n"),
                               self.corpus.hot, self.corpus.hot_docs)
            # One row a view, and views are a parameter.
            free = [r[0] for r in open_views(sizes, self.kmax, self.noise_view).collect()]
            fresh = F.when(F.col("may_found") & F.col("view").isin(free),
                           F.expr(polya_fresh(self.alpha, self.eta_sum)))
            return bucket_draw(self.ws, sites, gain, sizes, polya_base(self.eta_sum), fresh, u)
        return draw

    def arrive(self, vcells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members placed wave by wave, the first document alone in cluster 0 of every view."""
        run = self.run
        waves = self.ws.cut(doc_waves(self.corpus.docs, run.seed, self.corpus.n_docs), "waves")
        sites = waves.select("doc_id", "wave", views_of(self.views).alias("view"))
        first = sites.where(F.col("wave") == 0).select("doc_id", "view",
                                                       F.lit(0).cast("long").alias("cluster"))
        placed, draws = [self.ws.cut(first, "wave-0")], []
        for w in range(1, wave_count(self.corpus.n_docs) + 1):
            pending = sites.where(F.col("wave") == w).select("doc_id", "view")
            drawn = draw_clusters(self.ws, whole(placed), pending, self.drawer(vcells),
                                  self.kmax, run.seed, 0, w)
            drawn = self.ws.cut(drawn, f"wave-{w}")
            draws.append(drawn)
            placed.append(self.unplaced(pending, drawn))
        members = whole(placed).withColumn("batch", batch_of(run.batches, run.seed,
                                                             DOC))
        return members, whole(draws) if draws else None

    def unplaced(self, pending: DataFrame, drawn: DataFrame) -> DataFrame:
        """Sites without a token in the view draw nothing; they start in cluster 0."""
        return (pending.join(drawn.select("doc_id", "view", "cluster"), ["doc_id", "view"], "left")
                .withColumn("cluster", F.coalesce("cluster", F.lit(0).cast("long"))))

    def renew_members(self, state: State, vcells: DataFrame, it: int, keep=None) -> State:
        def move(s: State, part: DataFrame, b: int) -> DataFrame:
            drawn = draw_clusters(self.ws, whole(s["members"]), part.select("doc_id", "view"),
                                  self.drawer(vcells), self.kmax, self.run.seed, it, b)
            if keep is not None:
                keep.append(drawn)
            return replace_members(part, drawn)
        return self.each_batch(state, "members", move)

    def numbers(self, state: State) -> dict:
        rows = (whole(state["members"]).select("view", "cluster").distinct()
                .groupBy("view").count().collect())
        return {f"clusters_{r[0]}": r[1] for r in rows}


def pending_sites(members: DataFrame, pending: DataFrame, vcells: DataFrame) -> DataFrame:
    """Sites about to draw, with their present cluster if they have one."""
    placed = pending.join(members, ["doc_id", "view"], "left")
    mine = vcells.join(pending, ["doc_id", "view"], "left_semi")
    return sites_of(placed, mine)


class CrossCat(ViewModel):
    """Hard form: each term in one view; state members and term_views."""

    kind = "crosscat"
    state_names = ("members", "term_views")

    def __init__(self, corpus: Corpus, run: Run, workspace: Workspace, views: int = 2,
                 kmax: int = -1, noise_view: bool = False, alpha: float = 1.0, eta: float = 0.1,
                 xi: float = 1.0, feature_move_rate: float = 1.0):
        super().__init__(corpus, run, workspace, views, kmax, noise_view, alpha, eta, xi,
                         feature_move_rate=feature_move_rate)
        self.rate = feature_move_rate

    def start(self) -> State:
        views = site_integer(self.views, self.run.seed, "view", TERM).cast("long")
        term_views = self.ws.cut(self.corpus.vocab.select("term", views.alias("view")),
                                 "term_views")
        vcells = self.ws.cut(view_cells(self.corpus.cells, term_views), "vcells")
        members, _ = self.arrive(vcells)
        return {"members": self.split(members, "members"), "term_views": [term_views]}

    def sweep(self, state: State, it: int) -> State:
        state = self.move_features(state, it)
        vcells = self.ws.cut(view_cells(self.corpus.cells, state["term_views"][0]), "vcells")
        return self.renew_members(state, vcells, it)

    def move_features(self, state: State, it: int) -> State:
        """A Metropolis pass over terms in hash batches; every tenth sweep only a tenth of them."""
        if self.views < 2:
            return state
        rate = 0.1 if it % 10 == 0 else self.rate
        members, run = whole(state["members"]), self.run
        views = state["term_views"][0]
        for b in range(run.batches):
            vcells = view_cells(self.corpus.cells, views)
            terms = self.ws.cut(cluster_terms(vcells, members), "terms")
            sizes = self.ws.cut(cluster_sizes(members, terms), "sizes")
            mine = views.where(batch_of(run.batches, run.seed, TERM) == b)
            tried = propose_views(mine, self.views, rate, run.seed, it)
            tried = mh_accept_feature(self.ws.cut(tried, "tried"), self.corpus.cells, members,
                                      terms, sizes, views, self.eta, self.eta_sum, self.xi,
                                      self.corpus.n_terms, self.views, run.seed, it)
            views = self.ws.cut(move_feature(views, tried), "term_views")
        return {**state, "term_views": [views]}

    def log_likelihood(self, state: State) -> float:
        return ll_crosscat(self.corpus.cells, whole(state["members"]), state["term_views"][0],
                           self.alpha, self.eta, self.eta_sum, self.corpus.n_docs,
                           self.corpus.n_terms, self.xi, self.views).first()[0]


class SoftCrossCat(ViewModel):
    """Soft form: each token picks a view; needs a binarised corpus."""

    kind = "soft"
    state_names = ("tokens", "members")

    def __init__(self, corpus: Corpus, run: Run, workspace: Workspace, views: int = 2,
                 kmax: int = -1, noise_view: bool = False, alpha: float = 1.0, eta: float = 0.1,
                 xi: float = 1.0, implementation: str = "normal",
                 fixed_views: DataFrame | None = None):
        if implementation not in ("normal", "marginal"):
            raise ValueError("implementation is 'normal' or 'marginal'")
        super().__init__(corpus, run, workspace, views, kmax, noise_view, alpha, eta, xi,
                         implementation=implementation)
        self.marginal, self.fixed_views = implementation == "marginal", fixed_views
        self.draw_ll = 0.0

    def sites(self, members: DataFrame, pending: DataFrame, vcells: DataFrame,
              sizes: DataFrame) -> DataFrame:
        """Sites without a token in the view don't draw; a document alone founds no cluster."""
        held = sizes.select("view", F.col("cluster").alias("home"), F.col("ndsum").alias("_held"))
        return (pending_sites(members, pending, vcells).where(F.col("k") > 0)
                .join(held, ["view", "home"], "left")
                .withColumn("may_found", F.coalesce(F.col("_held") > 1, F.lit(True))).drop("_held"))

    def view_counts(self, state: State) -> DataFrame:
        return (whole(state["tokens"]).groupBy("doc_id", "term", F.col("z").cast("long")
                                               .alias("view"))
                .agg(F.count("*").alias("n")))

    def start(self) -> State:
        run = self.run
        batch = batch_of(run.batches, run.seed, DOC, TERM, POS)
        z = site_integer(self.views, run.seed, "init", DOC, TERM,
                         POS)
        if self.fixed_views is not None:
            tokens = self.fixed_views.select("doc_id", "term", "pos", F.col("view").cast("int")
                                             .alias("z"))
        else:
            tokens = expand_tokens(self.corpus.cells).withColumn("z", z)
        parts = self.split(tokens.withColumn("batch", batch), "tokens")
        zero = F.lit(0).cast("long")
        by_doc = batch_of(run.batches, run.seed, DOC)
        members = self.corpus.docs.select("doc_id", views_of(self.views).alias("view"),
                                          zero.alias("cluster"), by_doc.alias("batch"))
        state = {"tokens": parts, "members": self.split(members, "members")}
        return self.sweep(state, 0)

    def sweep(self, state: State, it: int) -> State:
        draws: list[DataFrame] = []
        vcells = self.ws.cut(self.view_counts(state), "vcells")
        state = self.renew_members(state, vcells, it, keep=draws)
        self.draw_ll = ll_soft_crosscat(whole(draws)).first()[0] or 0.0
        if self.fixed_views is not None:
            return state
        u = token_uniform(self.run.seed, it, "z")

        def redraw(s: State, part: DataFrame, b: int) -> DataFrame:
            tokens = whole(s["tokens"])
            if self.marginal:
                return redraw_topics(part, tokens, self.views, self.xi, self.eta, self.corpus, u,
                                     self.ws)
            slots = whole(s["members"]).select(
                "doc_id", F.col("view").cast("int").alias("slot"),
                F.concat_ws("/", F.col("view").cast("string"), F.col("cluster").cast("string"))
                .alias("node_id"), F.lit(float(self.xi)).alias("alpha"))
            return redraw_slots(part, tokens, slots, self.eta, self.corpus, u, k=self.views,
                                alpha=self.xi)
        return self.each_batch(state, "tokens", redraw)

    def log_likelihood(self, state: State) -> float:
        return self.draw_ll


def fit_crosscat(cells: DataFrame, views: int = 2, run: Run = Run(), **hyper) -> Fitted:
    """Cross-cutting clusterings; ``hyper`` as in :class:`CrossCat`."""
    ws = Workspace(cells.sparkSession)
    return fit(CrossCat(Corpus.build(ws, cells), run, ws, views, **hyper))


def fit_soft_crosscat(cells: DataFrame, views: int = 2, run: Run = Run(), **hyper) -> Fitted:
    """Soft cross-cutting clusterings of binarised cells.

    ``fixed_views(doc_id, term, pos, view)`` freezes token views and restarts all clusters.
    """
    ws = Workspace(cells.sparkSession)
    return fit(SoftCrossCat(Corpus.build(ws, binarize(cells)), run, ws, views, **hyper))


