"""One sweep as a query, whole fits, saved samples and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (CELLS, PATHS, brand_cells, doc_cells, docs_in, nation_edges,
                              part_features, paths_of, shop_cells, table, tokens_of, tokens_sql, u_sql)
from catalog.models import (LABEL_TOKENS, MIX, MIX_DATA, V_SUM, flat_slots, label_state, mix_scores,
                            slot_scores)
from latent.functions.sites import DOC, sample_site, site_uniform
from latent.operators import counts, structure, windows
from latent.operators.corpus import Corpus
from latent.operators.structure import as_slots
from latent.plans import crosscat, labeled, lda, mixture, ncrp, vmf
from latent.plans.flat import redraw_slots, redraw_topics, token_uniform
from latent.plans.loop import Run
from latent.session import Workspace
from latent.sources import docify, samples, sinks
from latent.streaming import fold

Q: dict = {}
SQL: dict = {}
ONE = Run(seed=3, batches=1, max_sweeps=1)


def entry(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


U = u_sql("'3'", "'1'", "'z'", "doc_id", "term", "pos")


def sweep_sql(scored: str) -> str:
    """From token scores, the inverse-CDF draw of every token."""
    return f"""{scored}, w as (select *, exp(lw - max(lw) over (partition by doc_id, term, pos)) as w from scored),
cum as (select *, sum(w) over (partition by doc_id, term, pos order by slot rows unbounded preceding) as c,
  sum(w) over (partition by doc_id, term, pos) as tot from w),
drawn as (select doc_id, term, pos, min(slot) filter (where c > {U} * tot) as z from cum group by all)"""


FOLD = "select doc_id, z, count(*) as n, sum(pos * length(term)) as mark from drawn group by all"


def folded(drawn):
    return drawn.groupBy("doc_id", "z").agg(F.count("*").alias("n"),
                                            F.sum(F.col("pos") * F.length("term")).alias("mark"))


def one_sweep(s, d, k=10):
    ws = Workspace(s)
    corpus = Corpus.build(ws, doc_cells(s, d))
    tokens = ws.cut(tokens_of(corpus.cells, k), "tokens")
    return redraw_topics(tokens, tokens, k, 0.1, 0.1, corpus, token_uniform(3, 1, "z"), ws)


LDA_SWEEP = sweep_sql(slot_scores(tokens_sql(10, CELLS) + ", " + flat_slots(10, 0.1)))


@entry("lda_sweep", f"with {LDA_SWEEP} {FOLD}")
def _(s, d):
    return folded(one_sweep(s, d))


@entry("lda_sweep_top_terms", f"""with {LDA_SWEEP}, nt as (select cast(z as varchar) as node_id, term, count(*) as n from drawn group by all),
r as (select *, row_number() over (partition by node_id order by n desc, term) as rank from nt)
select node_id, rank, term, n from r where rank <= 10""")
def sweep_top_terms(s, d):
    drawn = one_sweep(s, d).withColumn("node_id", F.col("z").cast("string"))
    return windows.top_terms(counts.node_term_counts(drawn), 10)


LABEL_WORD = """case when node_id like 'REJECT%' then -ln(v)
  else ln(0.1 + coalesce(nw, 0) - own) - ln(0.1 * v + coalesce(nwsum, 0) - own) end"""


@entry("labeled_sweep", f"with {sweep_sql(slot_scores(LABEL_TOKENS, word=LABEL_WORD))} {FOLD}")
def _(s, d):
    cells, tokens, slots = label_state(s, d)
    corpus = Corpus.build(Workspace(s), cells)
    return folded(redraw_slots(tokens, tokens, slots, 0.1, corpus, token_uniform(3, 1, "z")))


@entry("mixture_sweep", f"""with {MIX}, scored as (select doc_id, cluster, ln(0.7 + ndsum) - ln(4 * 0.7 + d) + {MIX_DATA} as lw from old, vs, ds),
w as (select *, exp(lw - max(lw) over (partition by doc_id)) as w from scored),
cum as (select *, sum(w) over (partition by doc_id order by cluster rows unbounded preceding) as c, sum(w) over (partition by doc_id) as tot from w)
select doc_id, min(cluster) filter (where c > {u_sql("'3'", "'c'", "doc_id")} * tot) as cluster from cum group by doc_id""")
def _(s, d):
    scores = mix_scores(s, d, "dirichlet")
    return sample_site(scores, ["doc_id"], "cluster", site_uniform(3, "c", DOC)).select(
        "doc_id", "cluster")


# -- whole fits: rows only ----------------------------------------------------------------

def traced(fitted):
    return fitted.trace().select("iter", "ll", "best_ll", "best_iter")


@entry("fit_lda")
def _(s, d):
    return traced(lda.fit_lda(doc_cells(s, d), 10, run=Run(seed=3, batches=2, max_sweeps=2)))


@entry("fit_lda_proposals")
def _(s, d):
    """Many topics by Metropolis proposals, whose cost does not depend on their number."""
    return traced(lda.fit_lda(doc_cells(s, d), 300, run=Run(seed=3, batches=2, max_sweeps=2), proposals=3))


@entry("fit_lda_preassigned")
def _(s, d):
    cells = brand_cells(s, d)
    return traced(lda.fit_lda(cells, 5, run=ONE, preassigned=tokens_of(cells, 5)))


@entry("fit_labeled_lda")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("topic"))
    return traced(labeled.fit_labeled_lda(doc_cells(s, d), t, noise=2, run=ONE))


@entry("fit_fixed_tree")
def _(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    docs = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("name"),
        "n_name")
    edges = docs.select((F.col("doc_id") + 10_000).alias("line_no"), F.col("name").alias("child"),
                        F.col("n_name").alias("parent")).unionByName(nation_edges(s, d))
    return traced(labeled.fit_fixed_tree(brand_cells(s, d), docs.select("doc_id", "name"), edges,
                                         reject=True, run=ONE, learn=True))


@entry("contract_tree")
def _(s, d):
    e = nation_edges(s, d).select(F.concat(F.lit("wn_"), "child").alias("child"),
                                  F.concat(F.lit("wn_"), "parent").alias("parent"))
    leaves = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col(
        "n_nationkey")).select("s_name", F.concat(F.lit("wn_"), "n_name"))
    return structure.contract_tree(e.union(leaves), Workspace(s))[0]


@entry("fit_sense_selection")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"),
                                       F.concat(F.lit("c"), "c_custkey").alias("node"),
                                       "c_mktsegment", "c_nationkey")
    pairs = c.select(F.col("node").alias("child"), F.explode(F.array(
        "c_mktsegment", F.concat(F.lit("nation"), "c_nationkey"))).alias("parent"))
    top = pairs.select(F.col("parent").alias("child"), F.lit("all").alias("parent")).distinct()
    return traced(labeled.fit_sense_selection(brand_cells(s, d), c.select("doc_id", "node"),
                                              pairs.unionByName(top), run=ONE))


@entry("fit_ncrp")
def _(s, d):
    return traced(ncrp.fit_ncrp(brand_cells(s, d), 3, run=ONE, gamma=0.5))


@entry("fit_tiered")
def _(s, d):
    return traced(ncrp.fit_tiered(brand_cells(s, d), 3, run=ONE))


@entry("fit_dp_mixture")
def _(s, d):
    return traced(ncrp.fit_dp_mixture(brand_cells(s, d), run=ONE))


@entry("fit_gem_tree")
def _(s, d):
    return traced(ncrp.fit_gem_tree(brand_cells(s, d), 0.5, 10.0, 3, run=ONE))


@entry("fit_crosscat")
def _(s, d):
    return traced(crosscat.fit_crosscat(brand_cells(s, d), 2, run=ONE, noise_view=True))


@entry("fit_soft_crosscat")
def _(s, d):
    return traced(crosscat.fit_soft_crosscat(brand_cells(s, d), 2, run=ONE))


@entry("fit_soft_crosscat_marginal")
def _(s, d):
    return traced(crosscat.fit_soft_crosscat(brand_cells(s, d), 2, run=ONE, kmax=4,
                                             implementation="marginal"))


@entry("fit_clustered_lda")
def _(s, d):
    return traced(mixture.fit_clustered_lda(shop_cells(s, d), part_features(s, d), 5, 4, run=ONE,
                                            type_dependent=True))


@entry("fit_mixture")
def _(s, d):
    return traced(mixture.fit_mixture(doc_cells(s, d), "dirichlet", 4, 1, run=ONE))


@entry("fit_mixture_dp")
def _(s, d):
    return traced(mixture.fit_mixture(brand_cells(s, d), "dp", 4, 0, run=ONE))


@entry("fit_vmf_dp")
def _(s, d):
    return traced(vmf.fit_vmf_dp(table(s, d, "embeddings"), run=ONE, k=10))


# -- sources, sinks and streams over the given tables -------------------------------------------

@entry("docify_round_trip", f"with {tokens_sql(5, CELLS)} select doc_id, z, count(*) as n, count(distinct term) as terms from tokens group by all")
def _(s, d):
    """Documents written as annotated lines and read back."""
    ws = Workspace(s)
    tokens = tokens_of(doc_cells(s, d), 5)
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"))
    path = f"{ws.path}/docify"
    sinks.export_annotated_docify(tokens, docs, path)
    named, back = docify.read_docify(s, path, preassigned=True)
    return (back.join(named, "doc_id")
            .withColumn("doc_id", F.expr("CAST(substring(name, 4) AS BIGINT)"))
            .groupBy("doc_id", "z").agg(F.count("*").alias("n"),
                                        F.count_distinct("term").alias("terms")))


@entry("dictionary_round_trip", "select 'doc' || doc_id as name, doc_id, source as topic from documents")
def _(s, d):
    """Documents with their source as topic, written as a dictionary and read back."""
    ws = Workspace(s)
    docs = table(s, d, "documents")
    slots = as_slots(docs.select("doc_id", F.col("source").alias("topic")), 0.1)
    names = docs.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"))
    sinks.export_dictionary(slots, names, sinks.term_ids(doc_cells(s, d).select("term").distinct()),
                            f"{ws.path}/dictionary")
    back = samples.read_dictionary(s, f"{ws.path}/dictionary")
    return (back["doc_topics"].join(back["topic_labels"], "topic")
            .select("name", "doc_id", F.col("label").alias("topic")))


@entry("tree_sample_round_trip", f"""with {tokens_sql(3)}, {PATHS}
select node_id, term, count(*) as n from tokens t join paths p on t.doc_id = p.doc_id and t.z = p.level
group by node_id, term""")
def _(s, d):
    """Customers' tokens on the levels of a tree, written as a sample of several lines a large node
    and read back."""
    ws = Workspace(s)
    cells = brand_cells(s, d)
    names = docs_in(cells).withColumn("name", F.concat(F.lit("c"), "doc_id"))
    sinks.export_tree_sample(tokens_of(cells, 3), paths_of(cells), names, sinks.header_line(
        -1.0, -1.0, 0, 10, 0.1, 0.1, 1.0, 3), f"{ws.path}/tree", line_items=400)
    return samples.read_tree_samples(s, f"{ws.path}/tree")["node_terms"].select("node_id", "term", "n")


FOLD_IN = f"""with recursive {tokens_sql(5, CELLS)}, {V_SUM},
nw as (select term, z, count(*) as nw from tokens group by all), tot as (select z, count(*) as nwsum from tokens group by z),
bt as (select item_id as doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as term,
  unnest(range(len(regexp_extract_all(lower(text), '\\p{{L}}+')))) as pos from benchmark),
site as (select doc_id, b.term, pos, {u_sql("'0'", "'fold'", "doc_id", "b.term", "pos")} as u,
  list((0.1 + coalesce(nw, 0)) / (0.1 * v + nwsum) order by t.z) as w
  from bt b, tot t left join nw on nw.term = b.term and nw.z = t.z, vs group by all),
walk as (select doc_id, -1 as pos, null::varchar as term, null::bigint as z, [0.1, 0.1, 0.1, 0.1, 0.1]::double[] as nd
  from (select distinct doc_id from site)
  union all
  select doc_id, pos, term, z, [nd[i] + if(i = z + 1, 1, 0) for i in range(1, 6)] from (
    select *, len([i for i in range(1, 6) if list_sum(p[1:i]) <= u * list_sum(p)]) as z from (
      select s.doc_id, s.pos, s.term, u, nd, [s.w[i] * nd[i] for i in range(1, 6)] as p
      from walk join site s on s.doc_id = walk.doc_id and s.pos = walk.pos + 1)))
select doc_id, term, pos, z from walk where pos >= 0"""


def frozen_of(s, d, ws):
    tokens = tokens_of(doc_cells(s, d), 5)
    return fold.Frozen.of(tokens, 5, 0.1, 0.1, tokens.select("term").distinct().count(), ws)


@entry("fold_in", FOLD_IN)
def _(s, d):
    """Benchmark items placed against topics of the documents, each token given those before it."""
    return frozen_of(s, d, Workspace(s)).place(table(s, d, "benchmark"), doc_id="item_id")


def stream_path(sf: str, name: str) -> str:
    """A table as a stream's path: a pattern, since a stream takes a plain path for a folder, and
    the table may be one file or a folder of files."""
    return f"{sf}/{name}.parque[t]"


@entry("stream_fold_in", FOLD_IN)
def _(s, d):
    """The same as a stream: the table is read as files, micro-batches are placed as they come."""
    ws = Workspace(s)
    stream = s.readStream.schema(table(s, d, "benchmark").schema).parquet(stream_path(d, "benchmark"))
    fold.stream_fold_in(stream, frozen_of(s, d, ws), f"{ws.path}/out", f"{ws.path}/cp",
                        doc_id="item_id").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{ws.path}/out").drop("batch")


@entry("stream_fit")
def _(s, d):
    ws = Workspace(s)
    stream = (s.readStream.schema(table(s, d, "documents").schema)
              .parquet(stream_path(d, "documents")).select("doc_id", "text"))
    model = fold.WindowFit(s, 5, window=500, path=f"{ws.path}/window")
    fold.stream_fit(stream, model, f"{ws.path}/cp").trigger(availableNow=True).start().awaitTermination()
    return counts.node_totals(model.state(s).withColumn("node_id", F.col("z").cast("string")))
