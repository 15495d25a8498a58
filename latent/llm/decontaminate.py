"""Benchmark decontamination: size-partitioned MinHash containment search.

An item leaks into a document if the document holds at least ``threshold`` of the item's
distinct word shingles. Items are partitioned by the number m of their shingles. All items of
a partition share one sketch size k: more than the share 1 − threshold of the largest m of the
partition. An item's sketch is its k smallest shingle hashes (a bottom-k MinHash). A document
that holds the threshold share misses fewer than k of the item's shingles, so it holds one of
the sketch: candidates are complete, however long the document is, and the sketch, not the
item, is what the corpus is probed with. Candidates are verified on the exact shingle strings.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latent.session import Workspace

TOKEN = r"[\p{L}\p{N}]+"


def words(text: str) -> Column:
    lowered = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def shingles(words: str, width: int, of) -> Column:
    """``of(word, …)`` of all word shingles, repeats included. A text of fewer words is one
    shingle (words beyond its end are null), one without words has none."""
    w = F.col(words)
    last = F.greatest(F.size(w) - width, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last),
                       lambda i: of(*(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(w) > 0, each)


def text_of(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def hash_of(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def query_set(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(item_id, m, shingles, sketch) of every distinct item that has words: its m distinct
    shingles, and the smallest hashes, as many as its size partition [2^c, 2^(c+1)) asks."""
    rows = (items.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("w"))
            .distinct())
    sized = rows.select("item_id", F.array_distinct(shingles("w", width, text_of)).alias("shingles"),
                        F.array_distinct(shingles("w", width, F.xxhash64)).alias("hashes"))
    sized = sized.withColumn("m", F.size("shingles").cast("long")).where("m > 0")
    largest = F.pow(F.lit(2.0), F.floor(F.log2("m")) + 1) - 1
    k = F.floor((1 - threshold) * largest + 1e-9) + 1
    return sized.select("item_id", "m", "shingles",
                        F.slice(F.array_sort("hashes"), F.lit(1), k.cast("int")).alias("sketch"))


def leaks(docs: DataFrame, items: DataFrame, width: int = 5,
          threshold: float = 0.8) -> DataFrame:
    """One row per (document, item) that leaks: doc_id, text_hash, item_id, item_shingles,
    shared, containment.

    Documents are told apart by ``doc_id`` and the hash of their text, so nulls and repeated
    ids don't mix; rows that repeat both are one document. Texts without words hold nothing;
    items without words never leak. An item of fewer than ``width`` words leaks only into a document
    of just those words. Different items of one id give a row each.
    """
    ws = Workspace(docs.sparkSession)
    asked = ws.cut(query_set(items, width, threshold)
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    sketch = ws.cut(asked.select("item", F.explode("sketch").alias("h")), "sketches")
    known = ws.cut(asked.select("item", F.explode("shingles").alias("shingle")), "shingles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       hash_of().alias("text_hash"), "text")
    probes = (rows.select("doc_id", "text_hash", words("text").alias("w"))
              .select("doc_id", "text_hash", F.explode(shingles("w", width, F.xxhash64)).alias("h")))
    # Tables of the query set carry no hint: Spark broadcasts them while their size allows.
    candidates = ws.cut(probes.join(sketch, "h").select("doc_id", "text_hash", "item").distinct(),
                        "candidates")
    found = candidates.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    texts = rows.join(found, rows.doc_id.eqNullSafe(found["_id"])
                      & (rows.text_hash == found["_hash"]), "left_semi")
    held = (texts.select("doc_id", "text_hash", words("text").alias("w"))
            .select("doc_id", "text_hash", F.explode(shingles("w", width, text_of)).alias("shingle"))
            .join(known, "shingle").distinct())
    shared = held.groupBy("doc_id", "text_hash", "item").agg(F.count("*").alias("shared"))
    pairs = shared.join(candidates.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}),
                        shared.doc_id.eqNullSafe(F.col("_id"))
                        & (shared.text_hash == F.col("_hash"))
                        & (shared.item == candidates.item), "left_semi")
    return (pairs.join(asked.select("item", "item_id", "m"), "item")
            .where(F.col("shared") >= threshold * F.col("m") - 1e-9)
            .select("doc_id", "text_hash", "item_id", F.col("m").alias("item_shingles"), "shared",
                    (F.col("shared") / F.col("m")).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item leaks."""
    ws = Workspace(docs.sparkSession)
    bad = ws.cut(leaks(docs, items, width, threshold)
                 .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
                 .distinct(), "leaks")
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad["_id"])
                     & (hash_of() == bad["_hash"]), "left_anti")
