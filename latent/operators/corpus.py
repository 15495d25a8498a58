"""Corpus shaping: sparse cells, tokens, vocabulary, priors, and the hot-term list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latent.functions.mathx import sql
from latent.functions.sites import site_uniform

WORD = r"\p{L}+"


# Up to this many ids of several rows are listed, the rows of all others are cells by themselves.
REPEATED_IDS = 10_000


def _run_lengths(words: Column) -> Column:
    """(term, n) of every distinct word of an array, by its sorted runs."""
    def runs(a: Column) -> Column:
        first = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)),
                         lambda i: i.isNotNull())
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(a, i).alias("term"),
            (F.coalesce(F.get(at, j + 1), F.size(a)) - i).cast("long").alias("n"))))[0]

    # An array of one binds what the functions above name several times.
    return F.transform(F.array(F.sort_array(words)), runs)[0]


def cells_from_text(df: DataFrame, doc_id: str, text: str, min_df: int = 1) -> DataFrame:
    """Lower-cased letter runs of whole texts, counted per (doc, term).

    Words are counted within their row, and rows meet by (doc, term) only where several have
    the same id, so texts of their own id need no shuffle. Ids are read when this is called.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("_words"))
    repeated = (rows.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
                .limit(REPEATED_IDS + 1).collect())

    def counted(some: DataFrame) -> DataFrame:
        return some.select("doc_id", F.explode(_run_lengths(F.col("_words"))).alias("_cell")
                           ).select("doc_id", "_cell.term", "_cell.n")

    def met(some: DataFrame) -> DataFrame:
        return (some.select("doc_id", F.explode("_words").alias("term"))
                .groupBy("doc_id", "term").agg(F.count("*").alias("n")))

    if not repeated:
        cells = counted(rows)
    elif len(repeated) > REPEATED_IDS:
        cells = met(rows)
    else:
        again = F.broadcast(df.sparkSession.createDataFrame(repeated, "_id long"))
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        cells = counted(rows.join(again, same, "left_anti")).unionByName(
            met(rows.join(again, same, "left_semi")))
    if min_df > 1:
        kept = cells.groupBy("term").count().where(F.col("count") >= min_df).select("term")
        cells = cells.join(kept, "term", "left_semi").select("doc_id", "term", "n")
    return cells


def binarize(cells: DataFrame) -> DataFrame:
    return cells.withColumn("n", F.lit(1).cast("long"))


def expand_tokens(cells: DataFrame) -> DataFrame:
    """One row per occurrence, numbered from 1 within its (doc, term)."""
    return (cells.where(F.col("n") > 0)
            .withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            .drop("n"))


def vocab_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("term").agg(F.sum("n").alias("n_corpus"), F.count("*").alias("df"))


def doc_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("doc_id").agg(F.sum("n").alias("n_doc"))


def corpus_totals(cells: DataFrame) -> DataFrame:
    """One row (n_terms, n_docs, n_tokens), from per-term and per-doc partial sums."""
    by_term = cells.groupBy("term").agg(F.sum("n").alias("n"))
    by_doc = cells.groupBy("doc_id").agg(F.sum("n").alias("n"))
    sides = (by_term.select(F.lit(1).alias("t"), F.lit(0).alias("d"), "n")
             .unionByName(by_doc.select(F.lit(0).alias("t"), F.lit(1).alias("d"),
                                        F.lit(0).cast("long").alias("n"))))
    return sides.agg(F.sum("t").alias("n_terms"), F.sum("d").alias("n_docs"),
                     F.sum("n").alias("n_tokens"))


def symmetric_eta(vocab: DataFrame, eta: float) -> DataFrame:
    """The same prior weight on every term."""
    return vocab.withColumn("eta", F.lit(float(eta)))


def check_eta_sum(n_terms: int, eta: float, limit: float | None = None) -> float:
    """Sum of a symmetric prior over the vocabulary; an error from ``limit`` on, if one is set."""
    total = n_terms * eta
    if limit is not None and not total < limit:
        raise ValueError(f"eta sums to {total:g} over the vocabulary; it must stay under {limit:g}")
    return total


def rank_eta_prior(features: DataFrame, eta: float, b: float) -> DataFrame:
    """eta_f = eta · b^(mean count of f over the words listing it)."""
    return (features.groupBy("feature").agg(F.avg("n").alias("mean_n"))
            .select("feature", (eta * F.pow(F.lit(float(b)), F.col("mean_n"))).alias("eta")))


def depth_eta_sql(eta: float, scale: float, level: str):
    return f"{sql(eta)} * power({sql(scale)}, CAST({level} AS DOUBLE))" if scale < 1 else eta


def depth_eta(eta: float, scale: float, level: str) -> Column:
    """eta · scale^level for path scores; only a scale below 1 has an effect."""
    return F.expr(sql(depth_eta_sql(eta, scale, level)))


def drop_unknown_words(tokens: DataFrame, features: DataFrame, word: str = "term") -> DataFrame:
    known = features.select(F.col("word").alias(word))
    return tokens.join(known, word, "left_semi")


def batch_of(n: int, seed, *keys) -> Column:
    return F.floor(site_uniform(seed, "batch", *keys) * n).cast("int")


# A key with more than this share of all rows is spread over several tasks.
HOT_SHARE = 1 / 1000
HOT_MIN_ROWS = 50_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int,
             least: int = HOT_MIN_ROWS) -> list[tuple]:
    """(key, fan) of every key holding over HOT_SHARE of the rows: at most 1/HOT_SHARE of them.

    A key of fewer than ``least`` rows is not worth spreading.
    """
    floor = max(total * HOT_SHARE, least)
    return [(r[0], int(r[1] // floor) + 1)
            for r in counts.where(F.col(n) > floor).select(key, n).collect()]


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot: list[tuple], key: str,
                by: str, how: str = "inner") -> DataFrame:
    """Equi join whose hot keys are salted: ``big`` rows by ``by``, ``small`` rows repeated.

    ``hot`` is the bounded list from :func:`hot_keys`; without hot keys this is a plain join.
    """
    if not hot:
        return big.join(small, on, how)
    spark = big.sparkSession
    fans = F.broadcast(spark.createDataFrame(hot, big.select(key, F.lit(0).alias("_fan")).schema))
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    left = (big.join(fans, key, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(by), fan).cast("int")).drop("_fan"))
    right = (small.join(fans, key, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# A list of counts longer than this goes on in further rows of its key.
LIST_ITEMS = 4096


def count_lists(counts: DataFrame, by: list[str], of: str, n: str = "nw") -> DataFrame:
    """Rows (by, of, n) as two lists ``_of`` and ``_n`` side by side, of at most LIST_ITEMS in a row."""
    lists = counts.groupBy(*by).agg(F.collect_list(F.struct(of, n)).alias("_in"))
    last = F.floor((F.size("_in") - 1) / LIST_ITEMS).cast("int")
    some = lists.withColumn("_in", F.explode(F.when(last == 0, F.array("_in")).otherwise(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("_in", i * LIST_ITEMS + 1, F.lit(LIST_ITEMS))))))
    return some.select(*by, F.col(f"_in.{of}").alias("_of"), F.col(f"_in.{n}").alias("_n"))


def from_lists(rows: DataFrame, of: str, n: str = "nw") -> DataFrame:
    """A row for each entry of the lists that ``count_lists`` made."""
    rest = [c for c in rows.columns if c not in ("_of", "_n")]
    return rows.select(*rest, "_n", F.posexplode("_of").alias("_at", of)).select(
        *rest, of, F.expr("_n[_at]").alias(n))


def dealt_by(rows: DataFrame, keys: list[str], hot_docs: list[tuple], by: str) -> DataFrame:
    """``rows`` dealt out by ``keys``. With ``hot_docs``, from :func:`hot_keys`, also by a column
    ``_part``, a number by a hash of ``by`` that is 0 for all but the hot documents."""
    if not hot_docs:
        return rows.repartition(*keys)
    fans = rows.sparkSession.createDataFrame(list(hot_docs), rows.select("doc_id", F.lit(0).alias("_fan")).schema)
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    return (rows.join(F.broadcast(fans), "doc_id", "left")
            .withColumn("_part", F.pmod(F.xxhash64(by), fan).cast("int")).drop("_fan")
            .repartition(*keys, "_part"))


@dataclass
class Corpus:
    """Materialised cells with the scalars every model needs."""

    cells: DataFrame
    vocab: DataFrame
    docs: DataFrame
    n_terms: int
    n_docs: int
    n_tokens: int
    hot: list[tuple] = field(default_factory=list)
    hot_docs: list[tuple] = field(default_factory=list)

    @property
    def sparkSession(self) -> SparkSession:
        return self.cells.sparkSession

    @classmethod
    def build(cls, workspace, cells: "DataFrame | Corpus") -> "Corpus":
        """The corpus of ``cells``; one that is built already stays as it is, in its own workspace."""
        if isinstance(cells, cls):
            return cells
        cells = workspace.cut(cells.where(F.col("n") > 0), "cells", pin=True)
        vocab = workspace.cut(vocab_counts(cells), "vocab", pin=True)
        docs = workspace.cut(cells.groupBy("doc_id").agg(
            F.sum("n").alias("n_doc"), F.count("*").alias("terms")), "docs", pin=True)
        v = vocab.agg(F.count("*"), F.sum("n_corpus"), F.sum("df")).first()
        if not v[0]:
            raise ValueError("the corpus holds no terms")
        rows = v[2]
        return cls(cells, vocab, docs, v[0], docs.count(), v[1],
                   hot_keys(vocab, "term", "df", rows), hot_keys(docs, "doc_id", "terms", rows))
