import numpy as np
import pytest
from pyspark.sql import functions as F

from latent.functions.sites import DOC, POS, TERM, site_uniform
from latent.session import Workspace
from latent.streaming import fold

K, ALPHA, ETA = 3, 0.2, 0.1
TEXTS = [(1, "a b a c a a"), (2, "zz a zz"), (2, "c c b c"), (3, None), (4, ""), (None, "b b"),
         (5, " ".join("abc"[i * i % 3] for i in range(700)))]


@pytest.fixture(scope="module")
def frozen(spark):
    rows = [(d, w, 1, (d + ord(w)) % K if d % 4 else 0) for d in range(30) for w in "aabccc"[d % 3:]]
    tokens = spark.createDataFrame(rows, "doc_id long, term string, pos int, z int")
    return fold.Frozen.of(tokens, K, ALPHA, ETA, 3, Workspace(spark))


def replay(spark, frozen):
    """Every document token by token, in plain Python."""
    nw = {r.term: list(r.nw) for r in frozen.term_topics.collect()}
    out = []
    for doc_id, text in TEXTS:
        nd = [0] * K
        words = (text or "").split()
        sites = spark.createDataFrame([(doc_id, w, i) for i, w in enumerate(words)],
                                      "doc_id long, term string, pos int")
        us = [r.u for r in sites.orderBy("pos").select(
            site_uniform(0, "fold", DOC, TERM, POS).alias("u")).collect()]
        for i, (w, u) in enumerate(zip(words, us, strict=True)):
            counts = nw.get(w, [0] * K)
            upto = np.cumsum([(ETA + counts[t]) / (3 * ETA + frozen.totals[t]) * (ALPHA + nd[t])
                              for t in range(K)])
            z = int((upto <= u * upto[-1]).sum())
            nd[z] += 1
            out.append((str(doc_id), w, i, z))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.term, r.pos, r.z) for r in df.collect())


def test_tokens_see_their_document_so_far(spark, frozen):
    docs = spark.createDataFrame([(t, d, "x") for d, t in TEXTS], "text string, doc_id long, term string")
    want = replay(spark, frozen)
    for size in ("10000", "7"):  # documents go on from one Arrow batch to the next
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert rows_of(frozen.place(docs.repartition(3))) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert frozen.place(docs.limit(0)).count() == 0


def test_stream_equals_table_and_replays(spark, frozen, tmp_path):
    docs = spark.createDataFrame([(d, t) for d, t in TEXTS], "doc_id long, text string")
    for i, part in enumerate(docs.randomSplit([1.0, 1.0], 1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    for checkpoint in ("cp", "cp2"):  # all batches come a second time: nothing is doubled
        fold.stream_fold_in(stream, frozen, out, f"{tmp_path}/{checkpoint}").trigger(
            availableNow=True).start().awaitTermination()
        placed = spark.read.parquet(out)
        assert placed.agg(F.count_distinct("batch")).first()[0] == 2
        assert rows_of(placed) == replay(spark, frozen)
