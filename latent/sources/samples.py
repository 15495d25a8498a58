"""Readers of saved samples in the text exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latent.sources.docify import numbered_lines

NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
HEADER = rf"^ll = {NUMBER} \({NUMBER} at (-?\d+)\) (-?\d+) alpha = {NUMBER} eta = {NUMBER}"
GAMMA = rf"gamma = {NUMBER}"
DEPTH = r"L = (\d+)"
FIELD = "||"
PART = "@@@"


def _header(lines: DataFrame) -> DataFrame:
    def group(i: int, kind: str, pattern: str = HEADER):
        return F.regexp_extract("value", pattern, i).try_cast(kind)

    return (lines.where(F.col("value").startswith("ll ="))
            .select("sample", group(1, "double").alias("ll"), group(2, "double").alias("best_ll"),
                    group(3, "int").alias("best_iter"), group(4, "int").alias("nodes"),
                    group(5, "double").alias("alpha"), group(6, "double").alias("eta"),
                    group(1, "double", GAMMA).alias("gamma"), group(1, "int", DEPTH)
                    .alias("depth")))


def _items(column):
    return F.filter(F.split(column, "\t"), lambda x: F.trim(x) != "")


def read_tree_samples(spark: SparkSession, paths) -> dict[str, DataFrame]:
    """headers, nodes, node_terms, node_docs and edges of saved tree samples.

    A node may have several lines; what they list is united.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("sample"), "value")
    body = (lines.where(~F.col("value").startswith("ll =") & (F.trim("value") != ""))
            .select("sample", F.split("value", r"\|\|").alias("f")).where(F.size("f") == 6)
            .select("sample", F.trim(F.regexp_replace(F.col("f")[0], "\t", "")).alias("node_id"),
                    F.trim(F.col("f")[1]).alias("label"),
                    F.trim(F.col("f")[2]).cast("long").alias("ndsum"),
                    F.col("f")[3].alias("terms"), F.col("f")[4].alias("docs"),
                    F.col("f")[5].alias("children")))

    def parts(column: str):
        return body.select("sample", "node_id", F.explode(_items(F.col(column))).alias("item"))

    terms = parts("terms").select("sample", "node_id", F.split("item", PART).alias("p"))
    docs = parts("docs").select("sample", "node_id", F.split("item", PART).alias("p"))
    return {
        "headers": _header(lines),
        "nodes": body.select("sample", "node_id", "label", "ndsum").distinct(),
        "node_terms": terms.select("sample", "node_id", F.col("p")[0].alias("term"),
                                   F.col("p")[1].cast("long").alias("n")),
        "node_docs": docs.select("sample", "node_id", F.col("p")[0].cast("long").alias("doc_id"),
                                 F.col("p")[1].alias("name"), F.col("p")[2].cast("long")
                                 .alias("n")),
        "edges": parts("children").select("sample", F.col("node_id").alias("parent_id"),
                                          F.trim("item").alias("child_id")),
    }


def read_dictionary(spark: SparkSession, path) -> dict[str, DataFrame]:
    """doc_topics, topic_labels and terms of a dictionary file.

    Document rows are ``doc<TAB>number<TAB>topic…``, topic rows ``topic<TAB>label`` with a
    hexadecimal id, and after a blank line come ``number<TAB>term`` rows.
    """
    lines = numbered_lines(spark, path)
    blank = lines.where(F.trim("value") == "").agg(F.min("line_no")).first()[0]
    blank = 2 ** 62 if blank is None else blank
    split = lines.where(F.trim("value") != "").select("line_no", F.split("value", "\t").alias("f"))
    above, below = split.where(F.col("line_no") < blank), split.where(F.col("line_no") > blank)
    is_topic = (F.size("f") == 2) & F.col("f")[0].startswith("0x")
    return {
        "doc_topics": above.where(~is_topic).select(
            F.col("f")[0].alias("name"), F.get("f", 1).try_cast("long").alias("doc_id"),
            F.posexplode(F.slice("f", F.lit(3), F.size("f") - 2)).alias("pos", "topic")),
        "topic_labels": above.where(is_topic).select(
            F.col("f")[0].alias("topic"), F.col("f")[1].alias("label")),
        # Tried casts: Spark may look at a row's fields before its line number.
        "terms": below.select(F.col("f")[0].try_cast("long").alias("term_id"),
                              F.get("f", 1).alias("term")),
    }


def read_labeled_samples(spark: SparkSession, dictionary: dict[str, DataFrame], paths
                         ) -> dict[str, DataFrame]:
    """headers, node_terms and node_docs of labeled samples, ids resolved by the dictionary."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("sample"), "value")
    body = (lines.where(~F.col("value").startswith("ll =") & (F.trim("value") != ""))
            .select("sample", F.split("value", r"\|\|").alias("f")))

    def parts(i: int):
        pair = F.split("item", ":")
        return body.select("sample", F.trim(F.regexp_replace(F.col("f")[0], "\t", ""))
                           .alias("topic"), F.explode(_items(F.get(F.col("f"), i))).alias("item")
                           ).select("sample", "topic", pair[0].cast("long").alias("id"),
                                    pair[1].cast("long").alias("n"))

    labels = dictionary["topic_labels"].withColumnRenamed("label", "node_id")
    terms = dictionary["terms"].withColumnRenamed("term_id", "id")
    docs = dictionary["doc_topics"].select(F.col("doc_id").alias("id"), "name").distinct()
    return {
        "headers": _header(lines),
        "node_terms": parts(2).join(labels, "topic").join(terms, "id").select(
            "sample", "node_id", "term", "n"),
        "node_docs": parts(3).join(labels, "topic").join(docs, "id").select(
            "sample", "node_id", F.col("id").alias("doc_id"), "name", "n"),
    }


def glob_samples(spark: SparkSession, prefix: str, mode: str, keep: int = 20) -> list[str]:
    """Paths of saved text samples whose names begin with ``prefix``: the best states (``map``) or
    the last ``keep`` periodic ones by name (``bayes``). None at all is an error.

    The list is bounded by ``keep``; the readers take it as their paths.
    """
    pattern = prefix + {"map": "*-best*", "bayes": "*-sample*"}[mode]
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath().toString()) for f in store.globStatus(target) or [])
    if not found:
        raise FileNotFoundError(f"no saved sample matches {pattern}")
    return found[-keep:]


def read_states(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of every saved state, with chain_id, kind and iter."""
    return spark.read.option("basePath", f"{path}/{table}").parquet(
        f"{path}/{table}").withColumn("kind", F.regexp_extract("kind", "^[a-z]+", 0))
