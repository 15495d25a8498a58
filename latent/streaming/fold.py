"""Topic models over streams of documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, flat, site_integer, site_uniform
from latent.operators.corpus import WORD, Corpus, batch_of, expand_tokens
from latent.operators.counts import topic_array
from latent.plans.flat import redraw_topics, topic_totals, zeros
from latent.plans.loop import whole
from latent.session import Workspace, delete, shared_root, subfolders


def stream_cells(stream: DataFrame, doc_id: str, text: str, *kept: str) -> DataFrame:
    """Occurrences (doc_id, term, pos, columns ``kept``) of whole texts, without an aggregate
    over the stream.

    Each document arrives whole, so its occurrences are numbered inside its own row.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return (stream.select(F.col(doc_id).cast("long").alias("doc_id"), *kept, F.posexplode(words)
                          .alias("pos", "term")).select("doc_id", "term", "pos", *kept))


def _walk(k: int, alpha: float, eta: float, eta_sum: float, totals: list[int]):
    """Kernel over tokens in the order of (row, pos): draws them one by one, and carries a
    document's counts from each token to the next, from batch to batch too."""
    below = eta_sum + np.asarray(totals, dtype=float)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nd = None, np.full(k, float(alpha))
        for batch in batches:
            row, doc_id, term, pos, u, nw = batch.columns
            word = (eta + flat(nw, k)) / below
            rows, us = row.to_numpy(), u.to_numpy()
            z = np.empty(len(rows), np.int32)
            for i in range(len(rows)):
                if rows[i] != last:
                    last, nd = rows[i], np.full(k, float(alpha))
                upto = np.cumsum(word[i] * nd)
                z[i] = at = min(int(np.searchsorted(upto, us[i] * upto[-1], "right")), k - 1)
                nd[at] += 1
            yield pa.RecordBatch.from_arrays([doc_id, term, pos, pa.array(z)],
                                             ["doc_id", "term", "pos", "z"])
    return walk


def fold_in(docs: DataFrame, term_topics: DataFrame, totals: list[int], k: int, alpha: float,
            eta: float, n_terms: int, seed: int = 0, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Topics (doc_id, term, pos, z) for the tokens of new documents against frozen counts.

    ``term_topics(term, nw)`` holds one count array per term. A token sees the topics of the
    tokens before it in its document. Each row is a document of its own, also where ids repeat;
    null and empty texts have no tokens; terms without counts weigh the same in all topics but
    for their totals. A task holds the counts of one document at a time, whatever its length.
    """
    rows = stream_cells(docs.select(doc_id, text, F.monotonically_increasing_id().alias("_row")),
                        doc_id, text, "_row")
    sites = rows.join(term_topics, "term", "left").select(
        "_row", "doc_id", "term", "pos", site_uniform(seed, "fold", DOC, TERM, POS).alias("u"),
        F.coalesce("nw", zeros(k)).alias("nw"))
    return (sites.repartition("_row").sortWithinPartitions("_row", "pos")
            .mapInArrow(_walk(k, alpha, eta, n_terms * eta, totals),
                        "doc_id long, term string, pos int, z int"))


@dataclass
class Frozen:
    """The counts of a fitted flat model, against which documents are placed."""

    term_topics: DataFrame
    totals: list[int]
    k: int
    alpha: float
    eta: float
    n_terms: int

    @classmethod
    def of(cls, tokens: DataFrame, k: int, alpha: float, eta: float, n_terms: int,
           ws: Workspace) -> "Frozen":
        nw = ws.cut(tokens.groupBy("term").agg(topic_array(k).alias("nw")), "frozen", pin=True)
        return cls(nw, topic_totals(nw, k, "nw"), k, alpha, eta, n_terms)

    def place(self, docs: DataFrame, seed: int = 0, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
        return fold_in(docs, self.term_topics, self.totals, self.k, self.alpha, self.eta,
                       self.n_terms, seed, doc_id, text)


def stream_fold_in(stream: DataFrame, frozen: Frozen, out: str, checkpoint: str, seed: int = 0,
                   doc_id: str = "doc_id", text: str = "text"):
    """Place arriving documents; each micro-batch is a table of its own under ``out``, as
    ``batch=<id>``, which a replay of the batch writes again."""
    def hook(docs: DataFrame, batch_id: int) -> None:
        frozen.place(docs, seed, doc_id, text).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint)


class WindowFit:
    """A flat model over at most ``window`` documents of a stream.

    Each micro-batch adds its documents, evicts uniformly random ones (least keyed hash) once
    the window is full, and runs one sweep. State is a parquet table per batch id under
    ``path``, read from the last complete batch before, so a replayed batch writes the same
    table again and a new process goes on where the last one stopped. Older tables than the
    one before are deleted.
    """

    BUCKETS = 4096  # of the hash by which documents are evicted

    def __init__(self, spark: SparkSession, k: int, window: int, alpha: float = 0.1,
                 eta: float = 0.1, seed: int = 0, batches: int = 1, path: str | None = None):
        self.k, self.window, self.alpha, self.eta = k, window, alpha, eta
        self.seed, self.batches = seed, batches
        self.path = path or f"{shared_root(spark)}/window-{uuid.uuid4().hex}"

    def saved(self, spark: SparkSession) -> list[int]:
        """Batches whose tables are complete, in order."""
        found = [int(n[6:]) for n in subfolders(spark, self.path) if n.startswith("batch=")]
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        marks = {b: done(f"{self.path}/batch={b}/_SUCCESS") for b in found}
        return sorted(b for b, mark in marks.items() if mark.getFileSystem(conf).exists(mark))

    def state(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        batch_id = self.saved(spark)[-1] if batch_id is None else batch_id
        return spark.read.parquet(f"{self.path}/batch={batch_id}")

    def evicted(self, docs: DataFrame, excess: int, batch_id: int) -> DataFrame:
        """The ``excess`` documents of the least hashes: whole buckets of the hash, and the
        least of the one bucket in which the number is reached."""
        u = site_uniform(self.seed, batch_id, "evict", DOC)
        dealt = docs.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * self.BUCKETS))
        sizes = dict(map(tuple, dealt.groupBy("_b").count().collect()))
        edge, before = 0, 0
        while before + sizes.get(edge, 0) < excess:
            before += sizes.get(edge, 0)
            edge += 1
        last = dealt.where(F.col("_b") == edge).orderBy("_u", "doc_id").limit(excess - before)
        return dealt.where(F.col("_b") < edge).unionByName(last).select("doc_id")

    def on_batch(self, cells: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` hook over cells (doc_id, term, n)."""
        spark = cells.sparkSession
        ws = Workspace(spark)
        site = (DOC, TERM, POS)
        cells = cells.where(F.col("n") > 0)
        arrived = ws.cut(cells.select("doc_id").distinct(), "arrived")
        before = [b for b in self.saved(spark) if b < batch_id]
        old = self.state(spark, before[-1]) if before else None
        docs = arrived
        if old is not None:
            old = old.join(arrived, "doc_id", "left_anti")
            docs = ws.cut(old.select("doc_id").unionByName(arrived).distinct(), "docs")
        excess = docs.count() - self.window
        if excess > 0:
            # Documents go before their tokens are listed, so a large batch costs one look at its ids.
            out = self.evicted(docs, excess, batch_id)
            kept = ws.cut(docs.join(out, "doc_id", "left_anti").withColumnRenamed("doc_id", "_kept"), "kept")
            stays = F.col("doc_id").eqNullSafe(F.col("_kept"))
            cells = cells.join(kept, stays, "left_semi")
            old = None if old is None else old.join(kept, stays, "left_semi")
        new = expand_tokens(cells).select(
            "doc_id", "term", "pos",
            site_integer(self.k, self.seed, "init", *site).alias("z"))
        held = ws.cut(new if old is None else old.unionByName(new), "held")
        corpus = Corpus.build(ws, held.groupBy("doc_id", "term").agg(F.count("*").alias("n")))
        parts = [ws.cut(held.where(batch_of(self.batches, self.seed, *site) == b), "part")
                 for b in range(self.batches)]
        for b in range(self.batches):
            u = site_uniform(self.seed, batch_id, "z", *site)
            parts[b] = ws.cut(redraw_topics(parts[b], whole(parts), self.k, self.alpha, self.eta,
                                            corpus, u, ws), "part")
        whole(parts).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for b in before[:-1]:
            delete(spark, f"{self.path}/batch={b}")
        ws.close()


def stream_fit(stream_cells_: DataFrame, model: WindowFit, checkpoint: str):
    """Start the windowed fit over a stream of (doc_id, term, n) cells or raw text rows."""
    def hook(df: DataFrame, batch_id: int) -> None:
        cells = df
        if "n" not in df.columns:
            cells = stream_cells(df, "doc_id", "text").groupBy("doc_id", "term").agg(
                F.count("*").alias("n"))
        model.on_batch(cells, batch_id)

    return (stream_cells_.writeStream.foreachBatch(hook)
            .option("checkpointLocation", checkpoint))
