import hashlib

from pyspark.sql import functions as F

from latent.llm import sketch
from tests.llm.conftest import prose, rows_of, texts


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, none):
    found = {i: t or "" for i, t in texts().items() if i != 45}
    got = {r.doc_id: r for r in sketch.fingerprints(rows_of(spark, found)).collect()}
    order = sorted(found, reverse=True)
    assert set(got) == set(found)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = found[i], len(found[i])
        edited = t[:n - n // 2] + found[after][:n // 2]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, found[after])):
            a, b = shingles(t), shingles(other)
            assert abs(near - alike(a, b)) < (0.2 if len(a | b) > 128 else 1e-9)
        assert len(r.fingerprint) == 16 * min(128, len(shingles(t)))
    assert got[3].fingerprint == got[20].fingerprint == got[25].fingerprint
    assert sketch.fingerprints(none).count() == 0


def test_nulls_and_repeats(odd):
    rows = sketch.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)


def test_one_hot_id_is_split(spark):
    docs = rows_of(spark, {}, [(prose(i, 30), 1 if i % 2 else None, "", "", 0, 0, "", 0)
                               for i in range(200)])
    dealt = sketch.with_predecessor(docs, 8).where("_own = 1")
    assert dealt.count() == 200 and dealt.where("before IS NULL").count() == 0
    assert dealt.select("_range").distinct().count() >= 4


def test_estimates_and_merge(spark):
    a, b = prose(1, 3000), prose(2, 1500)
    docs = spark.createDataFrame([(a, b, a + " " + b, b[:len(b) // 2])], "a string, b string, c string, d string")
    k = 256
    for name in "abcd":
        docs = sketch.with_sketch(docs, name, f"s_{name}", k)
    c = F.col
    r = docs.select(
        sketch.distinct_shingles(c("s_a"), k).alias("n"),
        sketch.containment(c("s_b"), c("s_c"), k).alias("in"),
        sketch.containment(c("s_c"), c("s_b"), k).alias("of"),
        sketch.merge(c("s_a"), c("s_b"), k).alias("m"), c("s_c").alias("s")).first()
    assert abs(r.n - len(shingles(a))) < 0.2 * len(shingles(a))
    assert r["in"] > 0.85 and abs(r["of"] - 1 / 3) < 0.12
    assert len(set(r.m) & set(r.s)) >= k - 4  # only shingles across the seam differ
