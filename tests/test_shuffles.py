"""Shapes that keep shuffles in proportion to the tokens, and equality with the plain forms."""

import math
import re
import time

from pyspark.sql import functions as F

from latent import session
from latent.functions.sites import DOC, POS, TERM, site_integer, site_uniform
from latent.operators import clusters as cl
from latent.operators import corpus as corpus_of
from latent.operators import levels, structure
from latent.operators.corpus import Corpus, expand_tokens
from latent.plans.flat import redraw_slots
from latent.session import Workspace

ROWS = [(d, w, 1 + (d * i) % 3) for d in range(12) for i, w in enumerate("abcdef"[d % 4:])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def state(spark):
    """Tokens in lists of two to four slots, one of them REJECT; one term is null."""
    cells = spark.createDataFrame([*ROWS, (3, None, 2)], "doc_id long, term string, n long")
    tokens = expand_tokens(cells).withColumn("z", site_integer(3, 0, "init", DOC, TERM, POS))
    rows = [(d, i, n) for d in range(11) for i, n in enumerate(["x", "y", "REJECT", f"n{d % 3}"][:2 + d % 3])]
    slots = spark.createDataFrame(rows, "doc_id long, slot int, node_id string").withColumn("alpha", F.lit(0.1))
    return cells, tokens.localCheckpoint(), slots.localCheckpoint()


def forms(spark, monkeypatch):
    cells, tokens, slots = state(spark)
    corpus = Corpus.build(Workspace(spark), cells.where("term IS NOT NULL"))
    senses = slots.select("doc_id", (F.col("slot") % 2).alias("sense"), "node_id", F.lit(0.0).alias("log_freq"))
    counts = tokens.join(slots, "doc_id").groupBy("node_id", "term").agg(F.count("*").alias("n"))
    u = site_uniform(1, "t", DOC, TERM, POS)
    for few in (64, 0):
        monkeypatch.setattr(levels, "FEW_NODES", few)
        yield [levels.score_levels(tokens, slots, 0.1, 0.6), levels.score_labels(tokens, slots, 0.1, 0.6, 6),
               redraw_slots(tokens.where("z < 2"), tokens, slots, 0.1, corpus, u),
               structure.score_senses(cells, senses, counts, 0.1, 0.6)]


def test_few_nodes_give_the_rows_of_many(spark, monkeypatch):
    def rows(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

    few, many = forms(spark, monkeypatch)
    for a, b in zip(few, many, strict=True):
        assert a.columns == b.columns and rows(a) == rows(b) and rows(a)


def test_few_nodes_list_no_slots_in_a_shuffle(spark, monkeypatch):
    """A row for each token and slot must not be dealt by (node, term)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = [[re.search(r"Join \[node_id#\d+, term#", plan(df)) is not None for df in each]
                     for each in forms(spark, monkeypatch)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(few) and all(many)


def test_a_null_node_is_met_by_the_plain_form(spark):
    slots = spark.createDataFrame([(1, 0, "x"), (1, 1, None)], "doc_id long, slot int, node_id string")
    assert not levels.few_nodes(slots) and levels.few_nodes(slots.where("slot = 0"))


def test_shared_gain_deals_cells_and_not_their_clusters(spark, monkeypatch):
    """Rows of a cell and a cluster are made and summed where a site's cells are together; lists that
    go on in further rows and hot documents give the same sums."""
    cells = spark.createDataFrame([(*r[:2], 0, r[2]) for r in ROWS], "doc_id long, term string, view long, n long")
    sites = spark.createDataFrame([(d, 0, d % 3) for d in range(12)], "doc_id long, view long, home long")
    terms = cl.cluster_terms(cells, sites.withColumnRenamed("home", "cluster"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most, hot in ((4096, []), (2, []), (1, [(1, 3), (2, 2)])):
            monkeypatch.setattr(corpus_of, "LIST_ITEMS", most)
            gain = cl.shared_gain(sites, cells, terms, cl.plugin_gain(0.1), (), hot)
            found.append(sorted((*r[:3], round(r[3], 9)) for r in gain.collect()))
            if not hot:
                assert "hashpartitioning(doc_id#" in plan(gain)
                assert not re.search(r"hashpartitioning\(doc_id#\d+L, view#\d+L, cluster#", plan(gain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nw, home = {(r["cluster"], r["term"]): r["nw"] for r in terms.collect()}, {d: d % 3 for d in range(12)}
    want = {}
    for d, term, n in ROWS:
        for c in range(3):
            if (left := nw.get((c, term), 0) - n * (home[d] == c)) > 0:
                want[d, 0, c] = want.get((d, 0, c), 0) + n * (math.log(left + 0.1) - math.log(0.1))
    assert found[0] == found[1] == found[2] == sorted((*k, round(v, 9)) for k, v in want.items())


def test_shuffles_of_a_cut_go_when_it_is_written(spark):
    """Their files would stay until the driver's garbage is collected."""
    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))

    before, set_to = files(), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    table = Workspace(spark).cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 7
    with session.short_shuffles(spark), session.short_shuffles(spark):
        assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == set_to


def test_few_nodes_terms_are_met_before_documents(spark, monkeypatch):
    """A document's lists must not be dealt by term with each of its terms."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells, tokens, slots = state(spark)
        senses = slots.select("doc_id", (F.col("slot") % 2).alias("sense"), "node_id", F.lit(0.0).alias("log_freq"))
        counts = tokens.join(slots, "doc_id").groupBy("node_id", "term").agg(F.count("*").alias("n")).localCheckpoint()
        few = next(forms(spark, monkeypatch))[2], structure.score_senses(cells, senses, counts, 0.1, 0.6)
        tokens, senses = ([re.sub(r"#\d+L?", "", j) for j in re.findall(r"Join (\[[^\]]*\])", plan(df))] for df in few)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tokens.index("[doc_id]") < tokens.index("[term]")
    assert "[doc_id]" not in senses[senses.index("[term]"):]
