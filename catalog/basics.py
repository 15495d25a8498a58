"""Corpus, counting, ranking and special-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (BRANDS, CELLS, CLUSTERS, EDGES, LABELS, PATHS, SHOP, VIEWS,
                              brand_cells, brand_tokens, cluster_members, customer_topics,
                              doc_cells, nation_edges, part_features, paths_of,
                              shop_tokens, table, term_views_of, tokens_of,
                              tokens_sql, u_sql, view_members)
from latent.functions import mathx
from latent.functions.sites import (DOC, POS, TERM, Key, chosen_probability, sample_site,
                                    site_gaussian, site_integer, site_uniform)
from latent.operators import corpus, counts, structure, summary, windows

Q: dict = {}
SQL: dict = {}


def entry(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def node_tokens(s, d, k=10):
    return tokens_of(doc_cells(s, d), k).withColumn("node_id", F.col("z").cast("string"))


NODE_TOKENS = tokens_sql(10, CELLS) + ", nt as (select cast(z as varchar) as node_id, doc_id, term, pos from tokens)"
NODE_TERMS = NODE_TOKENS + ", node_terms as (select node_id, term, count(*) as n from nt group by all)"


@entry("cells_from_text", f"with {CELLS} select doc_id, term, n from cells")
def _(s, d):
    return doc_cells(s, d)


@entry("cells_from_text_min_df", f"""with {CELLS} select doc_id, term, n from cells
where term in (select term from cells group by term having count(*) >= 5)""")
def _(s, d):
    return corpus.cells_from_text(table(s, d, "documents"), "doc_id", "text", min_df=5)


@entry("binarize", f"""with {CELLS} select doc_id, count(*) as kept, sum(n) as n_raw from cells group by doc_id""")
def _(s, d):
    cells = doc_cells(s, d)
    return (corpus.binarize(cells).groupBy("doc_id").agg(F.sum("n").alias("kept"))
            .join(corpus.doc_lengths(cells), "doc_id").withColumnRenamed("n_doc", "n_raw"))


@entry("expand_tokens", f"""with {CELLS}, t as (select doc_id, term, unnest(range(1, n + 1)) as pos from cells)
select doc_id, count(*) as n_tokens, sum(pos) as sum_pos from t group by doc_id""")
def _(s, d):
    return corpus.expand_tokens(doc_cells(s, d)).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.sum("pos").alias("sum_pos"))


@entry("vocab_counts", f"with {CELLS} select term, sum(n) as n_corpus, count(*) as df from cells group by term")
def _(s, d):
    return corpus.vocab_counts(doc_cells(s, d))


@entry("spread_join", f"""with {CELLS}, v as (select term, count(*) as df from cells group by term)
select doc_id, count(*) as terms, sum(df) as sum_df from cells join v using (term) group by doc_id""")
def _(s, d):
    """Every term of more than a thousandth of the cells is hot here, however few they are."""
    cells = doc_cells(s, d)
    v = corpus.vocab_counts(cells).select("term", "df")
    hot = corpus.hot_keys(v, "term", "df", cells.count(), least=1)
    return corpus.spread_join(cells, v, ["term"], hot, "term", "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("df").alias("sum_df"))


@entry("doc_lengths", f"with {CELLS} select doc_id, sum(n) as n_doc from cells group by doc_id")
def _(s, d):
    return corpus.doc_lengths(doc_cells(s, d))


@entry("corpus_totals", f"""with {CELLS} select count(distinct term) as n_terms,
count(distinct doc_id) as n_docs, sum(n) as n_tokens from cells""")
def _(s, d):
    return corpus.corpus_totals(doc_cells(s, d))


@entry("symmetric_eta", f"""with {CELLS} select round(sum(0.1), 6) as eta_sum, count(*) as n_terms
from (select distinct term from cells)""")
def _(s, d):
    v = corpus.symmetric_eta(corpus.vocab_counts(doc_cells(s, d)), 0.1)
    return v.agg(F.round(F.sum("eta"), 6).alias("eta_sum"), F.count("*").alias("n_terms"))


@entry("rank_eta_prior", f"""with {SHOP} select feature, round(0.1 * pow(0.5, avg(n)), 9) as eta
from features group by feature""")
def _(s, d):
    return corpus.rank_eta_prior(part_features(s, d), 0.1, 0.5).select(
        "feature", F.round("eta", 9).alias("eta"))


@entry("depth_eta", f"""with {BRANDS}, {PATHS} select node_id, round(0.1 * pow(0.5, level), 9) as eta
from (select distinct node_id, level from paths)""")
def _(s, d):
    nodes = paths_of(brand_cells(s, d)).select("node_id", "level").distinct()
    return nodes.select("node_id", F.round(corpus.depth_eta(0.1, 0.5, "level"), 9).alias("eta"))


@entry("drop_unknown_words", f"""with {SHOP} select doc_id, count(*) as n_tokens from tokens
where term in (select word from features where type <> 'ECONOMY') group by doc_id""")
def _(s, d):
    known = part_features(s, d).where(F.col("type") != "ECONOMY")
    return corpus.drop_unknown_words(shop_tokens(s, d), known).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"))


@entry("node_term_counts", f"with {NODE_TERMS} select node_id, term, n from node_terms")
def _(s, d):
    return counts.node_term_counts(node_tokens(s, d))


@entry("node_doc_counts", f"with {NODE_TOKENS} select node_id, doc_id, count(*) as n from nt group by all")
def _(s, d):
    return counts.node_doc_counts(node_tokens(s, d))


@entry("node_totals", f"""with {NODE_TOKENS} select node_id, count(*) as nwsum,
count(distinct doc_id) as ndsum from nt group by node_id""")
def _(s, d):
    return counts.node_totals(node_tokens(s, d))


@entry("path_doc_counts", f"with {BRANDS}, {PATHS} select node_id, count(*) as ndsum from paths group by node_id")
def _(s, d):
    return counts.path_doc_counts(paths_of(brand_cells(s, d)))


@entry("nonzero_docs", f"""with {tokens_sql(3)}, {CLUSTERS}
select cluster, z, count(distinct doc_id) as n_docs, count(*) as n_tokens
from tokens join members using (doc_id) group by cluster, z""")
def _(s, d):
    cells = brand_cells(s, d)
    return counts.nonzero_docs(tokens_of(cells, 3).join(cluster_members(cells), "doc_id"),
                               ["cluster", "z"])


@entry("cluster_term_presence", f"""with {CELLS}, {CLUSTERS}
select cluster, term, count(*) as n_docs from cells join members using (doc_id) group by all""")
def _(s, d):
    cells = doc_cells(s, d)
    return counts.cluster_term_presence(cells, cluster_members(cells))


@entry("view_sizes", f"""with {CELLS}, {VIEWS} select view, count(distinct cluster) as clusters,
(select count(*) from term_views t where t.view = m.view) as features from members m group by view""")
def _(s, d):
    cells = doc_cells(s, d)
    return counts.view_sizes(view_members(cells), term_views_of(cells))


TOP = """ranked as (select node_id, term, n,
  row_number() over (partition by node_id order by n desc, term) as rank from node_terms)"""
PAIRS = f"""{NODE_TERMS}, {TOP},
pairs as (select distinct a.term as w1, b.term as w2 from ranked a join ranked b
  on a.node_id = b.node_id and a.term < b.term and a.rank <= 10 and b.rank <= 10),
joint as (select w1, w2, count(*) as n_nodes from pairs
  join node_terms x on x.term = w1 join node_terms y on y.term = w2 and y.node_id = x.node_id group by all),
marginal as (select term, sum(2 * k) as m from node_terms
  join (select node_id, count(*) as k from node_terms group by node_id) using (node_id) group by term)"""


@entry("top_terms", f"with {NODE_TERMS}, {TOP} select node_id, rank, term, n from ranked where rank <= 10")
def _(s, d):
    return windows.top_terms(counts.node_term_counts(node_tokens(s, d)), 10)


@entry("top_terms_limit", f"""with {NODE_TERMS} select term, sum(n) as n from node_terms group by term
order by n desc, term limit 10""")
def _(s, d):
    totals = counts.node_term_counts(node_tokens(s, d)).groupBy("term").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "term").limit(10)


@entry("term_pair_counts", f"with {PAIRS} select w1, w2, n_nodes from joint")
def _(s, d):
    nt = counts.node_term_counts(node_tokens(s, d))
    return counts.term_pair_counts(nt, windows.top_term_pairs(nt, 10))[0]


@entry("term_pair_marginals", f"with {PAIRS} select term, m as marginal from marginal")
def _(s, d):
    nt = counts.node_term_counts(node_tokens(s, d))
    return counts.term_pair_counts(nt, windows.top_term_pairs(nt, 10))[1]


@entry("term_pmi", f"""with {PAIRS} select w1, w2, round(ln(n_nodes) - ln(a.m::double * b.m), 6) as pmi, n_nodes
from joint join marginal a on a.term = w1 join marginal b on b.term = w2""")
def _(s, d):
    nt = counts.node_term_counts(node_tokens(s, d))
    return counts.term_pmi(nt, windows.top_term_pairs(nt, 10)).withColumn(
        "pmi", F.round("pmi", 6))


@entry("build_sort", f"""with {NODE_TERMS}, {TOP}
select node_id, sum(n) as total,
string_agg(term || ' ' || n, ';' order by rank) filter (where rank <= 20) as entries
from ranked group by node_id""")
def _(s, d):
    nt = counts.node_term_counts(node_tokens(s, d))
    return windows.build_sort(nt, "node_id", "term", 20).withColumn(
        "entries", F.array_join("entries", ";"))


LEVELS = f"""{tokens_sql(3)}, {PATHS}, dl as (select p.doc_id, p.level, count(t.z) as n
  from paths p left join tokens t on t.doc_id = p.doc_id and t.z = p.level group by all)"""


def doc_level_counts(s, d):
    cells = brand_cells(s, d)
    n = tokens_of(cells, 3).groupBy("doc_id", F.col("z").alias("level")).agg(
        F.count("*").alias("n"))
    return paths_of(cells).select("doc_id", "level").join(n, ["doc_id", "level"], "left").select(
        "doc_id", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@entry("tokens_at_or_below", f"""with {LEVELS} select doc_id, level, n,
sum(n) over (partition by doc_id order by level desc) as at_or_below from dl""")
def _(s, d):
    return windows.tokens_at_or_below(doc_level_counts(s, d))


STICK = f"""{LEVELS}, below as (select *, sum(n) over (partition by doc_id order by level desc) as a from dl),
steps as (select *, coalesce(ln((0.5 * 10 + a) / (10 + lag(a) over (partition by doc_id order by level))), 0) as step from below),
sticks as (select doc_id, level, n, a, sum(step) over (partition by doc_id order by level rows unbounded preceding) as stick from steps)"""


@entry("gem_stick_prefix", f"with {STICK} select doc_id, level, a as at_or_below, round(stick, 6) as stick from sticks")
def _(s, d):
    return windows.gem_stick_prefix(doc_level_counts(s, d), 0.5, 10.0).select(
        "doc_id", "level", "at_or_below", F.round("stick", 6).alias("stick"))


SCORES = f"""{tokens_sql(10, CELLS)}, scores as (
  select doc_id, z, sum(ln(1 + pos)) as log_weight from tokens group by all)"""


def doc_scores(s, d):
    return tokens_of(doc_cells(s, d), 10).groupBy("doc_id", "z").agg(
        F.sum(F.ln(1.0 + F.col("pos"))).alias("log_weight"))


WEIGHTS = f"""{SCORES}, w as (select doc_id, z, exp(log_weight - max(log_weight) over (partition by doc_id)) as w from scores)"""


@entry("sample_site", f"""with {WEIGHTS}, c as (select doc_id, z,
  sum(w) over (partition by doc_id order by z rows unbounded preceding) as cum,
  sum(w) over (partition by doc_id) as tot, {u_sql("'0'", "'draw'", "doc_id")} as u from w)
select doc_id, min(z) filter (where cum > u * tot) as z from c group by doc_id""")
def _(s, d):
    u = site_uniform(0, "draw", DOC)
    return sample_site(doc_scores(s, d), ["doc_id"], "z", u).select("doc_id", "z")


@entry("chosen_probability", f"""with {WEIGHTS} select doc_id, z,
round(w / sum(w) over (partition by doc_id), 6) as p from w""")
def _(s, d):
    return chosen_probability(doc_scores(s, d), ["doc_id"]).select("doc_id", "z", F.round("p", 6)
                                                                   .alias("p"))


@entry("logsumexp", f"""with {SCORES} select doc_id,
round(max(m) + ln(sum(exp(log_weight - m))), 6) as lse
from (select *, max(log_weight) over (partition by doc_id) as m from scores) group by doc_id""")
def _(s, d):
    return mathx.logsumexp(doc_scores(s, d), ["doc_id"], "log_weight").select(
        "doc_id", F.round("lse", 6).alias("lse"))


@entry("normalize_log", f"""with {WEIGHTS} select doc_id, z,
round(w / sum(w) over (partition by doc_id), 6) as p from w""")
def _(s, d):
    return mathx.normalize_log(doc_scores(s, d), ["doc_id"], "log_weight").select(
        "doc_id", "z", F.round("p", 6).alias("p"))


# Traces: each customer's orders in key order stand for sweeps, the price for the score.
TRACE = "trace as (select o_custkey as chain_id, o_orderkey as iter, -o_totalprice as ll, lower(o_orderpriority) as kind from orders)"


def trace_of(s, d):
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("iter"),
        (-F.col("o_totalprice")).alias("ll"))


BEST = f"""with {TRACE}, p as (select *, max(ll) over (partition by chain_id order by iter
  rows between unbounded preceding and 1 preceding) as prev,
  max(ll) over (partition by chain_id order by iter rows unbounded preceding) as best_ll from trace),
b as (select *, (prev is null or ll > prev) as is_best from p),
r as (select chain_id, iter, best_ll, max(case when is_best then iter end) over
  (partition by chain_id order by iter rows unbounded preceding) as best_iter from b)"""


@entry("best_so_far", BEST + " select chain_id, iter, best_ll, best_iter from r")
def _(s, d):
    return windows.best_so_far(trace_of(s, d), ["chain_id"]).select(
        "chain_id", "iter", "best_ll", "best_iter")


@entry("converged", BEST + " select chain_id, iter, iter - best_iter >= 3000 as converged from r")
def _(s, d):
    return windows.converged(trace_of(s, d), ["chain_id"], 3000).select(
        "chain_id", "iter", "converged")


@entry("select_samples", """with t as (select o_custkey as chain_id, o_orderkey as iter,
  case when o_orderstatus = 'F' then 'best' else 'sample' end as kind from orders),
r as (select *, row_number() over (partition by chain_id order by iter desc) as k from t where kind = 'sample')
select chain_id, iter, kind from r where k <= 3""")
def _(s, d):
    kind = F.when(F.col("o_orderstatus") == "F", "best").otherwise("sample")
    t = table(s, d, "orders").select(F.col("o_custkey").alias("chain_id"),
                                     F.col("o_orderkey").alias("iter"), kind.alias("kind"))
    return windows.select_samples(t, "bayes", 3)


@entry("tune_proposal", """select event_id, round(case when a < 0.001 then s * 0.1 when a < 0.05 then s * 0.5
  when a < 0.2 then s * 0.9 when a > 0.95 then s * 10 when a > 0.75 then s * 2 when a > 0.5 then s * 1.1 else s end, 6) as scale
from (select event_id, least(value * 200, 10000.0) as s, (event_id % 1000) / 1000.0::double as a from events)""")
def _(s, d):
    e = table(s, d, "events")
    rate = (F.col("event_id") % 1000) / F.lit(1000.0)
    return e.select("event_id", F.round(windows.tune_proposal(F.col("value") * 200, rate), 6)
                    .alias("scale"))


@entry("move_rates", f"""with {tokens_sql(5)} select count(*) as proposed,
sum(case when z <> z2 then 1 else 0 end) as moved from (select z,
cast(floor({u_sql("'1'", "'again'", "doc_id", "term", "pos")} * 5) as int) as z2 from tokens)""")
def _(s, d):
    before = brand_tokens(s, d, 5)
    after = before.withColumn("z", site_integer(5, 1, "again", DOC, TERM, POS))
    return windows.move_rates(before, after, ["doc_id", "term", "pos"], "z")


# -- scalar functions ---------------------------------------------------------------------

@entry("lgamma_col", f"with {CELLS} select term, round(lgamma(sum(n) * 0.37), 4) as lg from cells group by term")
def _(s, d):
    v = corpus.vocab_counts(doc_cells(s, d))
    return v.select("term", F.round(mathx.lgamma_col("n_corpus * 0.37D"), 4).alias("lg"))


@entry("factln_col", f"with {CELLS} select term, round(lgamma(sum(n) + 1.0), 4) as lf from cells group by term")
def _(s, d):
    v = corpus.vocab_counts(doc_cells(s, d))
    return v.select("term", F.round(mathx.factln_col("n_corpus"), 4).alias("lf"))


@entry("polya_ratio", f"""with {CELLS} select doc_id, round(sum(lgamma(0.1 + total + n) - lgamma(0.1 + total)), 3) as lp
from cells join (select term, sum(n) as total from cells group by term) using (term) group by doc_id""")
def _(s, d):
    cells = doc_cells(s, d)
    return cells.join(corpus.vocab_counts(cells), "term").groupBy("doc_id").agg(
        F.round(F.sum(mathx.polya_ratio(0.1, "n_corpus", "n")), 3).alias("lp"))


@entry("site_uniform", f"select event_id, {u_sql(chr(39) + '7' + chr(39), 'event_id', 'event_type')} as u from events")
def _(s, d):
    return table(s, d, "events").select(
        "event_id", site_uniform(7, Key("event_id"), Key("event_type")).alias("u"))


@entry("site_integer", f"select event_id, cast(floor({u_sql(chr(39) + '7' + chr(39), 'event_id')} * 100) as int) as i from events")
def _(s, d):
    return table(s, d, "events").select("event_id", site_integer(100, 7, Key("event_id")).alias("i"))


@entry("site_gaussian", f"""select event_id, round(sqrt(-2 * ln(1 - {u_sql("'7'", "event_id", "'a'")}))
* cos(2 * pi() * {u_sql("'7'", "event_id", "'b'")}), 6) as g from events""")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(site_gaussian(7, Key("event_id")), 6)
                                        .alias("g"))


@entry("l2_normalize", """with v as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
s as (select vec_id, sqrt(sum(x * x)) as norm from v group by vec_id)
select vec_id, i, round(x * 3 / (norm * 3), 6) as x from v join s using (vec_id)""")
def _(s, d):
    v = table(s, d, "embeddings").withColumn("embedding", F.transform(
        "embedding", lambda x: x.cast("double") * 3))
    return v.select("vec_id", F.posexplode(mathx.l2_normalize("embedding")).alias("i", "x")
                    ).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@entry("dot", """with v as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings)
select vec_id, round(sum(x / (i + 1)), 6) as d from v group by vec_id""")
def _(s, d):
    w = F.expr("transform(sequence(1, 64), i -> 1D / i)")
    return table(s, d, "embeddings").select("vec_id", F.round(mathx.dot(F.col("embedding"), w), 6)
                                            .alias("d"))


BESSEL = """(-0.5 * ln(2 * pi() * 31.0) + 31.0 * (root + ln(k / 31.0) - ln(1 + root)) - 0.5 * ln(root))"""


@entry("log_bessel_i", f"""select event_id, round({BESSEL}, 6) as lb
from (select event_id, value + 1 as k, sqrt(1 + pow((value + 1) / 31.0, 2)) as root from events)""")
def _(s, d):
    return table(s, d, "events").select(
        "event_id", F.round(mathx.log_bessel_i(31.0, F.col("value") + 1), 6).alias("lb"))


@entry("vmf_logp", f"""with v as (select vec_id, unnest(embedding)::double as x from embeddings),
k as (select 20.0 as k, sqrt(1 + pow(20.0 / 31.0, 2)) as root)
select vec_id, round(20 * sum(x / 8) + 32 * ln(20 / (2 * pi())) - ln(20) - max({BESSEL}), 6) as lp
from v, k group by vec_id""")
def _(s, d):
    mu = F.expr("array_repeat(0.125D, 64)")
    return table(s, d, "embeddings").select("vec_id", F.round(
        mathx.vmf_logp(F.col("embedding"), mu, 20.0, 64), 6).alias("lp"))


@entry("dp_size_logp", """with s as (select label, count(*) as n from embeddings group by label),
t as (select sum(n - 1.5) as s, count(*) as dim from s)
select round(greatest(-300, least(300, max(lgamma(1.5 * dim) - dim * lgamma(1.5))
+ sum(0.5 * ln(least(1 - 1e-6, greatest(1e-6, (n - 1.5) / s.s)))))), 6) as logp
from (select * from s, t) s""")
def _(s, d):
    sizes = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return mathx.dp_size_logp(sizes, "n", 1.5).select(F.round("logp", 6).alias("logp"))


# -- joins ------------------------------------------------------------------------------

@entry("docs_with_topic_file", """select c_custkey as doc_id, c_mktsegment as topic from customer
where c_custkey in (select o_custkey from orders)""")
def _(s, d):
    docs = table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).count().select(
        "doc_id", F.concat(F.lit("c"), "doc_id").alias("name"))
    rows = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("doc"),
                                          F.lit(0).alias("pos"), F.col("c_mktsegment").alias("topic"))
    return structure.topics_by_name(rows, docs).select("doc_id", "topic")


@entry("docs_without_topics", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(s, d):
    return structure.docs_without_topics(table(s, d, "documents").select("doc_id"),
                                         table(s, d, "labels"))


@entry("restrict_docs", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def _(s, d):
    return summary.restrict_docs(table(s, d, "documents").select("doc_id", "lang"),
                                 table(s, d, "labels"))


@entry("words_with_features", f"""with {SHOP} select feature, count(*) as n_tokens
from tokens join features on term = word group by feature""")
def _(s, d):
    f = part_features(s, d).withColumnRenamed("word", "term").select("term", "feature")
    return shop_tokens(s, d).join(f, "term").groupBy("feature").agg(F.count("*").alias("n_tokens"))


@entry("docs_with_paths", f"""with {tokens_sql(3)}, {PATHS} select node_id, count(*) as n_tokens
from tokens t join paths p on p.doc_id = t.doc_id and p.level = t.z group by node_id""")
def _(s, d):
    cells = brand_cells(s, d)
    from latent.operators.levels import located
    return located(tokens_of(cells, 3), paths_of(cells).withColumnRenamed("level", "slot")).groupBy(
        "node_id").agg(F.count("*").alias("n_tokens"))


@entry("distinct_nodes", f"with {BRANDS}, {PATHS} select distinct level, node_id, parent_id from paths")
def _(s, d):
    from latent.operators.paths import prune_empty
    return prune_empty(paths_of(brand_cells(s, d)))


# -- topic lists and hierarchies ------------------------------------------------------------

@entry("with_noise_topics", """select doc_id, topic from (
  select c_custkey as doc_id, c_mktsegment as topic from customer
  union all select c_custkey, 'nation' || c_nationkey from customer
  union all select c_custkey, 'NOISE_' || i from customer, range(3) r(i))""")
def _(s, d):
    return structure.with_noise_topics(customer_topics(s, d), 3)


@entry("add_reject", f"with {LABELS} select doc_id, topic from doc_topics")
def _(s, d):
    return structure.add_reject(customer_topics(s, d))


CULL = """t as (select o_custkey as doc_id, 'c' || o_custkey as name,
  cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as pos,
  cast(o_orderdate as date)::varchar || substr(o_orderpriority, 1, 1) as topic from orders),
h as (select topic, count(*) as holders from t group by topic),
m as (select t.*, holders = 1 and topic <> name as culled from t join h using (topic)),
kept as (select * from m where not culled),
first as (select doc_id, arg_min(topic, pos) as first_topic from kept group by doc_id)"""


def order_topics(s, d):
    from pyspark.sql import Window
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    topic = F.concat(F.to_date("o_orderdate").cast("string"), F.substring("o_orderpriority", 1, 1))
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("c"), "o_custkey").alias("name"),
        (F.row_number().over(w) - 1).alias("pos"), topic.alias("topic"))


@entry("cull_unique_topics", f"with {CULL} select doc_id, pos, topic from kept")
def _(s, d):
    return structure.cull_unique_topics(order_topics(s, d))[0].select("doc_id", "pos", "topic")


@entry("culled_labels", f"""with {CULL} select first_topic as topic, m.doc_id, pos, topic as culled
from m join first using (doc_id) where culled""")
def _(s, d):
    return structure.cull_unique_topics(order_topics(s, d))[1]


@entry("tree_edges_to_tree", """with e as (select o_orderkey as line_no, 'c' || o_custkey as child,
  o_orderpriority as parent from orders)
select child, arg_max(parent, line_no) as parent from e group by child""")
def _(s, d):
    e = table(s, d, "orders").select(F.col("o_orderkey").alias("line_no"),
                                     F.concat(F.lit("c"), "o_custkey").alias("child"),
                                     F.col("o_orderpriority").alias("parent"))
    return structure.tree_edges_to_tree(e)


@entry("find_root", f"with {EDGES} select distinct parent as node from edges where parent not in (select child from edges)")
def _(s, d):
    return structure.find_root(nation_edges(s, d))


