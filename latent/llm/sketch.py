"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k smallest distinct hashes of a text's word shingles; one
that is shorter holds them all. Sketches of parts merge into that of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.

DataFrame operations only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latent.llm.common import WORD
from latent.session import Workspace

LOWEST = -(1 << 63)


def with_sketch(df: DataFrame, text: str, out: str, k: int, width: int = 5) -> DataFrame:
    """Add the sketch of a text column. A text of fewer than ``width`` words is one shingle,
    one without words has the empty sketch.

    Of a long text only hashes below a value under which four times k are to be expected are
    sorted; if too few of them are distinct, all are.
    """
    words, hashes, low = f"_{out}_words", f"_{out}_hashes", f"_{out}_low"
    w, h = F.col(words), F.col(hashes)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
                       lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    bound = (F.lit(float(LOWEST)) + F.lit(2.0 ** 64) * 4 * k / F.size(h)).cast("long")
    few = F.when(F.size(h) > 8 * k, F.array_distinct(F.filter(h, lambda x: x <= bound)))
    return (df.withColumn(words, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
            .withColumn(hashes, F.when(F.size(w) > 0, each).otherwise(
                F.array().cast("array<bigint>")))
            .withColumn(low, few)
            .withColumn(out, F.slice(F.sort_array(
                F.when(F.size(low) >= k, F.col(low)).otherwise(F.array_distinct(hashes))), 1, k))
            .drop(words, hashes, low))


def merge(a: Column, b: Column, k: int) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated Jaccard similarity of two texts: the share of common hashes in the merged
    sketch. Two empty sketches are alike, an empty one is like no other."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    all_ = F.size(merge(a, b, k))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def distinct_shingles(a: Column, k: int) -> Column:
    """Number of distinct shingles, exact below k."""
    last = F.element_at(a, -1).cast("double") - LOWEST
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * 2.0 ** 64 / last)


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 if ``a`` has none."""
    together = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * together / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(sketch: str) -> Column:
    """Hashes as 16 hex digits each, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


# -- neighbours in the order of ids ---------------------------------------------------

def _below(x: Column, bounds: np.ndarray) -> Column:
    """How many of the sorted bounds are smaller than x, by two levels of search."""
    if not len(bounds):
        return F.lit(0)
    step = max(int(len(bounds) ** 0.5), 1)
    top = F.lit(np.ascontiguousarray(bounds[::step]))
    block = F.greatest(F.size(F.filter(top, lambda b: b < x)) - 1, F.lit(0))
    part = F.slice(F.lit(bounds), block * step + 1, F.lit(step))
    return block * step + F.size(F.filter(part, lambda b: b < x))


def with_predecessor(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, before): each row with the text of the next smaller id; the smallest id
    gets the text of the largest.

    Rows are ordered by id (null first), then by the hash of their text, and dealt to ranges
    of that order by quantiles of the id; an id that spans several quantiles is split by hash.
    Each range's last row is given to the following range as well, so no row needs more than
    its range, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(LOWEST)))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("_id", shares, 50 * ranges)).first()[0] if shares else []
    bounds = np.array(found or [], np.int64)
    unit = F.shiftright(F.xxhash64("text"), 11) / F.lit(2.0 ** 53) + 0.5
    below, upto = _below(F.col("_id"), bounds), _below(F.col("_id") + 1, bounds)
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn(
        "_range", (below + F.floor(unit * (upto - below + 1))).cast("int"))
    # One row a range: at most ``ranges`` of them reach the driver.
    lasts = sorted((r["_range"], r["m"]["_id"], r["m"]["_hash"]) for r in
                   rows.groupBy("_range").agg(F.max(F.struct("_id", "_hash")).alias("m")).collect())
    to = [(i, h, lasts[(k + 1) % len(lasts)][0]) for k, (_, i, h) in enumerate(lasts)]
    given = spark.createDataFrame(to, "_id long, _hash long, _to int")
    halo = (rows.join(F.broadcast(given), ["_id", "_hash"])
            .select("doc_id", "text", "_id", "_hash", F.col("_to").alias("_range"),
                    F.lit(0).alias("_own")))
    every = rows.select("doc_id", "text", "_id", "_hash", "_range",
                        F.lit(1).alias("_own")).unionByName(halo)
    order = W.partitionBy("_range").orderBy("_own", "_id", "_hash")
    return every.withColumn("before", F.lag("text").over(order))


def fingerprints(docs: DataFrame, k: int = 128, width: int = 5) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text ends with the beginning of the next document in descending order of ids.
    Null texts count as empty, a null id is the smallest one; rows that repeat id and text
    stay, each next to its copy; a single row is next to itself; an empty table gives none.
    """
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_predecessor(docs, ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = (rows.withColumn("n_chars", n.cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half),
                                           F.substring(F.coalesce("before", "text"), F.lit(1), half)))
            .drop("before"))
    rows = with_sketch(rows, "text", "sketch", k, width).drop("text")
    rows = with_sketch(rows.withColumn("edited_sha256", F.sha2("edited", 256)),
                       "edited", "edited_sketch", k, width).drop("edited")
    order = W.partitionBy("_range").orderBy("_own", "_id", "_hash")
    rows = rows.withColumn("next_sketch", F.lag("sketch").over(order)).where("_own = 1")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", "sketch"), k).alias("near_next"))
