import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from latent.functions import kernels, mathx, sites
from latent.functions.sites import Key


def test_lgamma_matches_math(spark):
    xs = [10 ** e for e in np.linspace(-4, 5, 200)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for x, got, fact in df.select("x", mathx.lgamma_col("x"), mathx.factln_col("x")).collect():
        assert abs(got - math.lgamma(x)) <= 1e-12 * max(1, abs(got))
        assert abs(fact - math.lgamma(x + 1)) <= 1e-12 * max(1, abs(fact))


def test_polya_forms_agree(spark):
    df = spark.range(1, 40).select((F.col("id") % 5 + 1).alias("k"), "id")
    row = df.select(F.max(F.abs(mathx.polya_gain(0.1, "id", "k") + mathx.polya_empty(0.1, "k")
                                - mathx.polya_ratio(0.1, "id", "k")))).first()
    assert row[0] < 1e-10


def test_uniform_is_the_md5(spark):
    got = spark.range(5).select(sites.site_uniform(3, "x", Key("id"))).collect()
    for i, row in enumerate(got):
        want = int(hashlib.md5(f"3|x|{i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        assert row[0] == want


def test_logsumexp_without_keys(spark):
    df = spark.createDataFrame([(-1000.0,), (-1001.0,)], "v double")
    assert abs(mathx.logsumexp(df, [], "v").first()[0]
               - (-1000 + math.log(1 + math.exp(-1)))) < 1e-9


def test_sample_site_frequencies(spark):
    weights = {0: 0.1, 1: 0.6, 2: 0.3}
    rows = [(c, math.log(w) - 700) for c, w in weights.items()]
    scores = spark.range(4000).withColumnRenamed("id", "s").select(
        "s", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("log_weight"))
                                 for c, w in rows])).alias("x")).select("s", "x.*")
    drawn = sites.sample_site(scores, ["s"], "c", sites.site_uniform(1, Key("s")))
    counts = {r["c"]: r["count"] for r in drawn.groupBy("c").count().collect()}
    assert sum(counts.values()) == 4000
    for c, w in weights.items():
        assert abs(counts[c] / 4000 - w) < 0.04


def test_segment_draw_equals_row_draw():
    rng = np.random.default_rng(0)
    w, u = rng.random((500, 7)), rng.random(500)
    offsets = np.arange(0, 3501, 7)
    assert (sites.draw_rows(w, u) == sites.draw_segments(w.ravel(), offsets, u)).all()


def test_stick_weights_sum_to_one():
    """The last level takes what the levels above have left of the stick."""
    w = kernels.stick_weights(np.array([[3.0, 2.0, 1.0], [0.0, 0.0, 4.0]]), 0.5, 10.0)
    assert (w > 0).all() and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(w[:, -1], 1 - w[:, :-1].sum(axis=1))


def test_gaussian_moments(spark):
    m, s = spark.range(20000).select(sites.site_gaussian(1, Key("id")).alias("g")).agg(
        F.avg("g"), F.stddev("g")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03
