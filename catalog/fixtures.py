"""Corpora and starting states shared by the catalogue, in Spark and in SQL.

States come from keyed hashes of the rows themselves, so both engines start alike:
``documents`` as text, customers as documents over part brands, and parts as words
described by the words of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, Key, site_integer
from latent.operators.corpus import cells_from_text, expand_tokens
from latent.operators.paths import graft_paths


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- SQL side -------------------------------------------------------------------------

def u_sql(*keys: str) -> str:
    """The uniform of ``site_uniform``; constants come quoted, columns bare."""
    parts = ", ".join(f"cast({k} as varchar)" for k in keys)
    return (f"(cast(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) as bigint)::double"
            " / 4503599627370496.0)")


def int_sql(n, *keys: str) -> str:
    return f"cast(floor({u_sql(*keys)} * {n}) as int)"


CELLS = r"""cells as (
  select doc_id, term, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from documents)
  group by doc_id, term)"""

BRANDS = """cells as (
  select o_custkey as doc_id, p_brand as term, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  group by all)"""

TOKENS = "tokens0 as (select doc_id, term, unnest(range(1, n + 1)) as pos from cells)"


def tokens_sql(k: int, corpus: str = BRANDS) -> str:
    z = int_sql(k, "'0'", "'init'", "doc_id", "term", "pos")
    return f"{corpus}, {TOKENS}, tokens as (select doc_id, term, pos, {z} as z from tokens0)"


PATHS = f"""homes as (
  select doc_id, {int_sql(3, "'0'", "'c1'", "doc_id")} as a, {int_sql(2, "'0'", "'c2'", "doc_id")} as b
  from (select distinct doc_id from cells)),
paths as (
  select doc_id, 0 as level, 'r' as node_id, cast(null as varchar) as parent_id from homes
  union all select doc_id, 1, 'r/' || a, 'r' from homes
  union all select doc_id, 2, 'r/' || a || '/' || b, 'r/' || a from homes)"""

VIEWS = f"""term_views as (
  select term, {int_sql(2, "'0'", "'view'", "term")} as view from (select distinct term from cells)),
members as (
  select doc_id, view, {int_sql(4, "'0'", "'c'", "doc_id", "view")} as cluster
  from (select distinct doc_id from cells) d, (select 0 as view union all select 1) v)"""

CLUSTERS = f"""members as (
  select doc_id, {int_sql(4, "'0'", "'c'", "doc_id")} as cluster from (select distinct doc_id from cells))"""

LABELS = """doc_topics as (
  select c_custkey as doc_id, c_mktsegment as topic from customer
  union all select c_custkey, 'nation' || c_nationkey from customer
  union all select c_custkey, 'REJECT' from customer),
slots as (
  select doc_id, row_number() over (partition by doc_id order by topic) - 1 as slot,
         topic as node_id, 0.1::double as alpha from doc_topics)"""

SHOP = f"""cells as (
  select o_custkey as doc_id, 'p' || l_partkey as term, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey group by all),
features as (
  select 'p' || p_partkey as word, p_type as type, feature, count(*) as n
  from (select p_partkey, p_type, unnest(string_split(p_name, ' ')) as feature from part) group by all),
{TOKENS},
tokens as (
  select doc_id, term, pos, {int_sql(5, "'0'", "'init'", "doc_id", "term", "pos")} as z,
         {int_sql(6, "'0'", "'cluster'", "doc_id", "term", "pos")} as cluster from tokens0)"""

EDGES = """edges as (
  select n_nationkey as line_no, n_name as child, r_name as parent from nation join region on n_regionkey = r_regionkey
  union all select 1000 + r_regionkey, r_name, 'world' from region)"""

DAG = """edges as (
  select row_number() over (order by child, parent) as line_no, child, parent from (
    select distinct source as child, 'lang_' || lang as parent from documents
    union select distinct 'lang_' || lang, 'all' from documents
    union select distinct source, 'origin' from documents))"""


# -- Spark side -----------------------------------------------------------------------

def doc_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_from_text(table(spark, sf, "documents"), "doc_id", "text")


def brand_cells(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
            .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("doc_id"), F.col("p_brand").alias("term"))
            .agg(F.count("*").alias("n")))


def tokens_of(cells: DataFrame, k: int) -> DataFrame:
    return expand_tokens(cells).withColumn("z", site_integer(k, 0, "init", DOC, TERM, POS))


def brand_tokens(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return tokens_of(brand_cells(spark, sf), k)


def docs_in(cells: DataFrame) -> DataFrame:
    return cells.select("doc_id").distinct()


def paths_of(cells: DataFrame) -> DataFrame:
    leaf = F.concat(F.lit("r/"), site_integer(3, 0, "c1", DOC), F.lit("/"),
                    site_integer(2, 0, "c2", DOC))
    return graft_paths(docs_in(cells).select("doc_id", leaf.alias("node_id")), 3, F.lit("0"))


def term_views_of(cells: DataFrame) -> DataFrame:
    return cells.select("term").distinct().withColumn(
        "view", site_integer(2, 0, "view", TERM).cast("long"))


def view_members(cells: DataFrame) -> DataFrame:
    return docs_in(cells).select("doc_id", F.explode(F.expr("array(0L, 1L)")).alias("view")
                                 ).withColumn("cluster", site_integer(4, 0, "c", DOC, Key("view"))
                                              .cast("long"))


def cluster_members(cells: DataFrame) -> DataFrame:
    return docs_in(cells).withColumn("cluster", site_integer(4, 0, "c", DOC).cast("long"))


def customer_topics(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    nation = F.concat(F.lit("nation"), "c_nationkey")
    return c.select(F.col("c_custkey").alias("doc_id"),
                    F.explode(F.array("c_mktsegment", nation)).alias("topic"))


def shop_cells(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
            .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("doc_id"),
                     F.concat(F.lit("p"), "l_partkey").alias("term"))
            .agg(F.count("*").alias("n")))


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "part")
            .select(F.concat(F.lit("p"), "p_partkey").alias("word"), F.col("p_type").alias("type"),
                    F.explode(F.split("p_name", " ")).alias("feature"))
            .groupBy("word", "type", "feature").agg(F.count("*").alias("n")))


def shop_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens_of(shop_cells(spark, sf), 5).withColumn(
        "cluster", site_integer(6, 0, "cluster", DOC, TERM, POS))


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    below = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").cast("long").alias("line_no"), F.col("n_name").alias("child"),
        F.col("r_name").alias("parent"))
    return below.unionByName(r.select((1000 + F.col("r_regionkey")).cast("long").alias("line_no"),
                                      F.col("r_name").alias("child"),
                                      F.lit("world").alias("parent")))


def source_edges(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", F.concat(F.lit("lang_"), "lang")
                                             .alias("lang")).distinct()
    pairs = d.select(F.col("source").alias("child"), F.col("lang").alias("parent")).union(
        d.select("lang", F.lit("all"))).union(d.select("source", F.lit("origin")))
    return pairs.distinct()
