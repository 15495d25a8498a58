import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, site_integer
from latent.operators.corpus import expand_tokens, vocab_counts
from latent.operators.paths import graft_paths
from latent.operators.structure import as_slots
from latent.sources import docify, samples, sinks

LINES = ("one\ta:2\t\tb c:1\tx:y:3\ta:1\n\nonlyname\none\tz:0\tq:5\n")


@pytest.mark.parametrize("suffix", ["txt", "gz", "bz2"])
def test_docify_edge_cases(spark, tmp_path, suffix):
    path = tmp_path / f"corpus.{suffix}"
    opener = {"txt": open, "gz": gzip.open, "bz2": bz2.open}[suffix]
    with opener(path, "wt") as f:
        f.write(LINES)
    docs, cells = docify.read_docify(spark, str(path))
    assert [r["name"] for r in docs.collect()] == ["one", "one"]
    second = cells.where("term = 'q'").first()["doc_id"]
    first = docs.where(F.col("doc_id") != second).first()["doc_id"]
    got = {(r["doc_id"], r["term"]): r["n"] for r in cells.collect()}
    assert got == {(first, "a"): 3, (first, "b c"): 1, (first, "x:y"): 3, (second, "q"): 5}
    raw = docify.read_docify(spark, str(path), parse_counts=False)[1]
    assert raw.count() == 6


def test_docify_bad_fields_fail(spark, tmp_path):
    (tmp_path / "bad").write_text("d\ta\n")
    with pytest.raises(Exception, match="no count"):
        docify.read_docify(spark, str(tmp_path / "bad"))[1].collect()
    (tmp_path / "pre").write_text("d\ta:2:0\n")
    with pytest.raises(Exception, match="term:1:topic"):
        docify.read_docify(spark, str(tmp_path / "pre"), preassigned=True)[1].collect()


def test_word_features(spark, tmp_path):
    (tmp_path / "f").write_text("w\tnoun\tf:1\tg:h:2\nv\tverb\tf:3\n")
    rows = {tuple(r) for r in docify.read_word_features(spark, str(tmp_path / "f")).collect()}
    assert rows == {("w", "noun", "f", 1), ("w", "noun", "gh", 2), ("v", "verb", "f", 3)}
    (tmp_path / "twice").write_text("w\tn\tf:1\nw\tn\tg:1\n")
    with pytest.raises(ValueError):
        docify.read_word_features(spark, str(tmp_path / "twice"))


def test_tree_edges_and_topics(spark, tmp_path):
    (tmp_path / "e").write_text("RPL_Arpl_b\tRoot\t0.25\nc\troot\n")
    rows = docify.read_tree_edges(spark, str(tmp_path / "e")).orderBy("line_no").collect()
    assert [(r["child"], r["parent"], r["freq"]) for r in rows] == [
        ("arpl_b", "root", 0.25), ("c", "root", None)]
    (tmp_path / "t").write_text("d1\tx\ty\nd2\tz\n")
    got = {tuple(r) for r in docify.read_topic_assignments(spark, str(tmp_path / "t")).collect()}
    assert got == {("d1", 0, "x"), ("d1", 1, "y"), ("d2", 0, "z")}


def test_part_files_of_any_size_keep_rows_and_order(spark, tmp_path):
    """A dictionary of several part files that Spark deals to tasks by size, not by name."""
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "doc_id long, name string")
    slots = as_slots(docs.select("doc_id", F.concat(F.lit("t"), F.col("doc_id") % 3).alias("topic")), 0.1)
    ids = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("term"),
                                     F.col("id").alias("term_id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sinks.export_dictionary(slots, docs, ids, str(tmp_path / "dict"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
        back = samples.read_dictionary(spark, str(tmp_path / "dict"))
        assert back["terms"].count() == 20_000 == back["terms"].join(ids, ["term_id", "term"]).count()
        assert back["doc_topics"].count() == 50 and back["topic_labels"].count() == 3
        for name, parent in (("a", "first"), ("b", "second"), ("c", "last")):
            (tmp_path / "edges").mkdir(exist_ok=True)
            more = "".join(f"n{i}\tx\n" for i in range(20_000 if name == "b" else 10))
            (tmp_path / "edges" / name).write_text(f"node\t{parent}\n" + more)
        edges = docify.read_tree_edges(spark, str(tmp_path / "edges"))
        assert edges.where("child = 'node'").orderBy("line_no").select("parent").collect() == [
            ("first",), ("second",), ("last",)]
        (tmp_path / "docs").write_text("".join(f"n{i % 90}\ta:{i % 7}\tb:2\n" for i in range(20_000)))
        split = {tuple(r) for r in docify.read_docify(spark, str(tmp_path / "docs"))[0].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = {tuple(r) for r in docify.read_docify(spark, str(tmp_path / "docs"))[0].collect()}
    assert split == whole and len(whole) == 20_000


def named(cells):
    return cells.select("doc_id").distinct().withColumn("name", F.concat(F.lit("d"), "doc_id"))


@pytest.mark.parametrize("most", [3, 100_000])
def test_tree_sample_round_trip(spark, planted, tmp_path, most):
    tokens = expand_tokens(planted).withColumn("z", site_integer(2, 0, DOC, TERM, POS))
    leaf = F.concat(F.lit("r/"), F.col("doc_id") % 2)
    paths = graft_paths(planted.select("doc_id").distinct().select(
        "doc_id", leaf.alias("node_id")), 2, F.lit("0"))
    header = sinks.header_line(-10.5, -9.25, 3, 3, 0.1, 0.2, 1.0, 2)
    sinks.export_tree_sample(tokens, paths, named(planted), header, str(tmp_path / "s"), most)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    held = [line.split("||") for line in lines if not line.startswith("ll")]
    assert max(f[4].count("@@@") // 2 for f in held) <= 16 and (len(held) > 3) == (most == 3)
    back = samples.read_tree_samples(spark, str(tmp_path / "s"))
    h = back["headers"].first()
    assert (h["ll"], h["best_ll"], h["best_iter"], h["alpha"], h["eta"], h["gamma"], h["depth"]) == (
        -10.5, -9.25, 3, 0.1, 0.2, 1.0, 2)
    want = tokens.join(paths.withColumnRenamed("level", "z"), ["doc_id", "z"]).groupBy(
        "node_id", "term").count()
    assert set(map(tuple, want.collect())) == set(map(tuple, back["node_terms"].select(
        "node_id", "term", "n").collect()))
    assert {tuple(r) for r in back["edges"].select("parent_id", "child_id").collect()} == {
        ("r", "r/0"), ("r", "r/1")}
    assert sorted((r["node_id"], r["ndsum"]) for r in back["nodes"].collect()) == [
        ("r", 16), ("r/0", 8), ("r/1", 8)]
    held = back["node_docs"].groupBy("node_id").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    assert held.agg(F.sum("n")).first()[0] == tokens.count()


@pytest.mark.parametrize("most", [2, 100_000])
def test_labeled_round_trip(spark, planted, tmp_path, most):
    topics = planted.select("doc_id").distinct().select("doc_id", F.explode(F.array(
        F.lit("all"), F.concat(F.lit("t"), F.col("doc_id") % 2))).alias("topic"))
    slots = as_slots(topics, 0.1)
    tokens = expand_tokens(planted).withColumn("z", site_integer(2, 0, DOC, TERM, POS))
    ids = sinks.term_ids(vocab_counts(planted))
    topic_ids = sinks.export_dictionary(slots, named(planted), ids, str(tmp_path / "dict"))
    sinks.export_labeled_sample(tokens, slots, topic_ids, ids, sinks.header_line(
        -1.0, -1.0, 1, 3, 0.1, 0.1, None, 2), str(tmp_path / "sample"), most)
    back = samples.read_labeled_samples(spark, samples.read_dictionary(spark, str(tmp_path / "dict")),
                                        str(tmp_path / "sample"))
    want = tokens.join(slots.withColumnRenamed("slot", "z"), ["doc_id", "z"]).groupBy(
        "node_id", "term").count()
    assert set(map(tuple, want.collect())) == set(map(tuple, back["node_terms"].select(
        "node_id", "term", "n").collect()))
    assert back["node_docs"].agg(F.sum("n")).first()[0] == tokens.count()


def test_table_exports(spark, planted, tmp_path):
    members = planted.select("doc_id").distinct().select(
        "doc_id", F.lit(0).alias("view"), (F.col("doc_id") % 2).alias("cluster"))
    views = planted.select("term").distinct().withColumn("view", F.lit(0))
    sinks.export_crosscat(members, views, str(tmp_path / "cc"))
    assert spark.read.csv(str(tmp_path / "cc/clusters"), sep="\t").count() == 16
    tokens = expand_tokens(planted).withColumn("z", F.lit(0))
    sinks.export_soft_crosscat(tokens, members, 4, 2, -3.5, str(tmp_path / "sc"))
    assert spark.read.csv(str(tmp_path / "sc/tokens"), sep="\t").count() == tokens.count()
    sinks.export_mixture(members, tokens, named(planted), str(tmp_path / "mx"))
    assert spark.read.text(str(tmp_path / "mx/noise")).count() == 16


def test_samples_are_chosen_by_name(spark, tmp_path):
    for i in (1, 2, 3, 10):
        (tmp_path / f"run-sample-{i:05d}").write_text(f"r||all||{i}||\ta@@@{i}||||\n")
    (tmp_path / "run-best").write_text("r||all||7||\ta@@@7||||\n")
    (tmp_path / "other-sample-00099").write_text("r||all||9||||||\n")
    last = samples.glob_samples(spark, f"{tmp_path}/run", "bayes", keep=2)
    assert [p.rsplit("-", 1)[1] for p in last] == ["00003", "00010"]
    read = samples.read_tree_samples(spark, last)["node_terms"]
    assert sorted(r["n"] for r in read.collect()) == [3, 10]
    assert len(samples.glob_samples(spark, f"{tmp_path}/run", "map")) == 1
    with pytest.raises(FileNotFoundError):
        samples.glob_samples(spark, f"{tmp_path}/none", "bayes")
