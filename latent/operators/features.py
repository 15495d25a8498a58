"""Word-cluster scores: words stand for feature bundles, clusters for latent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_types(features: DataFrame, type_dependent: bool) -> DataFrame:
    kind = F.col("type") if type_dependent else F.lit("")
    return features.select("word", kind.alias("type")).distinct()


def cluster_feature_counts(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """Feature counts per cluster, from the (word, cluster) use counts of the tokens."""
    uses = tokens.groupBy("term", "cluster").agg(F.count("*").alias("uses"))
    listed = features.select(F.col("word").alias("term"), "feature", "n")
    return (uses.join(listed, "term").groupBy("cluster", "feature")
            .agg(F.sum(F.col("uses") * F.col("n")).alias("nw")))


def score_word_clusters(tokens: DataFrame, features: DataFrame, clusters: DataFrame,
                        eta: DataFrame, xi: float, type_dependent: bool = False) -> DataFrame:
    """Scores of every cluster of a word's type, per distinct (term, z, own cluster).

    Tokens that agree on word, topic and present cluster share their weights, so the table
    has one row per such combination and candidate. ``clusters(type, cluster)`` lists the
    candidates, ``eta(feature, eta)`` the feature priors; Σξ runs over all clusters.
    """
    totals = (eta.agg(F.sum("eta"))).first()[0]
    xi_sum = xi * clusters.select("cluster").distinct().count()
    counts = cluster_feature_counts(tokens, features)
    sums = counts.groupBy("cluster").agg(F.sum("nw").alias("nwsum"))
    listed = features.join(eta, "feature").select("word", "feature", F.col("n").alias("c"), "eta")
    plain = listed.groupBy("word").agg(F.sum(F.ln("eta")).alias("plain"),
                                       F.count("*").alias("n_features"), F.sum("c").alias("size"))
    words = word_types(features, type_dependent).join(plain, "word")
    cand = words.join(clusters, "type").select(F.col("word").alias("term"), "cluster", "plain",
                                               "n_features", "size")
    gains = (listed.join(counts, "feature").groupBy(F.col("word").alias("term"), "cluster").agg(
        F.sum(F.ln(F.col("eta") + F.col("nw")) - F.ln("eta")).alias("gain"),
        F.sum(F.ln(F.col("eta") + F.col("nw") - F.col("c")) - F.ln("eta")).alias("own_gain")))
    zero = F.lit(0).cast("long")
    scored = (cand.join(gains, ["term", "cluster"], "left").join(sums, "cluster", "left")
              .withColumn("nwsum", F.coalesce("nwsum", zero)))
    spots = tokens.groupBy("term", "z", F.col("cluster").alias("own")).agg(
        F.count("*").alias("n"))
    topic = tokens.groupBy("z", "cluster").agg(F.count("*").alias("nw_topic"))
    topic_sum = tokens.groupBy("z").agg(F.count("*").alias("n_topic"))
    met = (spots.join(scored, "term").join(topic, ["z", "cluster"], "left")
           .join(topic_sum, "z"))
    own = F.col("cluster") == F.col("own")
    mine = own.cast("long")
    feature_part = (F.col("plain")
                    + F.coalesce(F.when(own, F.col("own_gain")).otherwise(F.col("gain")),
                                 F.lit(0.0))
                    - F.col("n_features") * F.ln(totals + F.col("nwsum") - mine * F.col("size")))
    topic_part = (F.ln(xi + F.coalesce("nw_topic", zero) - mine)
                  - F.ln(xi_sum + F.col("n_topic") - 1))
    return met.select("term", "z", "own", "cluster", (topic_part + feature_part)
                      .alias("log_weight"))
