"""Contiguous shards of nearly equal byte sizes from global prefix sums.

Rows are ordered by (hash of the text, id) in ranges; the totals of the ranges give each range
its offset, a running sum within the range gives each row its global position, and cuts at
equal targets give the shards. Rows of equal texts stand side by side: a cut inside such a
group moves to the group's nearer end. Groups above a sixteenth of a shard would then tilt
sizes; there are at most 16 of them for each shard, and each is put whole into the lightest
shard first, which the other rows fill up to the common level. Only a group that outweighs a
whole shard is cut.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latent.session import Workspace

RESULT = ("doc_id long, size long, text_crc32 long, law string, shard int, slot long, "
          "grown_shard int")
HEAVY = 16  # groups above 1/HEAVY of a shard are placed one by one


def place(heavy: list[tuple[int, int]], light: int, n: int) -> tuple[dict[int, int], list[float]]:
    """Shard of each heavy (group, bytes), and the positions of the light rows' n − 1 cuts."""
    load, home = [0] * n, {}
    for group, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        home[group] = load.index(min(load))
        load[home[group]] += size
    level, rest = 0.0, sorted(load)
    for i in range(1, n + 1):  # the level to which the i lightest shards can be filled
        level = (light + sum(rest[:i])) / i
        if i == n or level <= rest[i]:
            break
    cuts, at = [], 0.0
    for used in load[:-1]:
        at += max(level - used, 0.0)
        cuts.append(at)
    return home, cuts


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes and belongs to the group of the empty ones; a null id comes
    first in its group; repeated rows each take a slot; an empty table gives an empty result.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = ws.cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")), "rows")
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], RESULT)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    # Fewer than n · HEAVY groups can be so large, and reach the driver.
    large = [(r[0], r[1]) for r in groups.where(F.col("bytes") > total / n / HEAVY).collect()]
    heavy = [g for g in large if g[1] <= total / n]
    home, cuts = place(heavy, total - sum(b for _, b in heavy), n)
    whole = F.broadcast(spark.createDataFrame(list(home.items()), "group long, home int"))

    # -- positions of the light rows ---------------------------------------------------
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ws.cut(rows.repartitionByRange(ranges, "group", "doc_id")
                   .withColumn("range", F.spark_partition_id()), "ranges")
    dealt = dealt.join(whole, "group", "left").withColumn(
        "light", F.when(F.col("home").isNull(), F.col("size")).otherwise(0))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    offsets = (dealt.groupBy("range").agg(F.sum("light").alias("sum"))
               .select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")))
    inside = W.partitionBy("range").orderBy("group", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = ws.cut(dealt.join(F.broadcast(offsets), "range").select(
        "range", "group", "doc_id", "size", "text_crc32", "home",
        (F.col("offset") + F.coalesce(F.sum("light").over(inside), F.lit(0))).alias("start"),
        (F.col("offset") + F.coalesce(F.sum("light").over(inside), F.lit(0)) + F.col("light"))
        .alias("end")), "placed")

    # -- cuts, moved to the ends of the groups in which they fall ----------------------
    split = {g for g, b in large if b > total / n}
    inner = F.lit(False)
    for cut in cuts:
        inner = inner | ((F.col("start") < cut) & (F.col("end") >= cut))
    hit = [r[0] for r in placed.where("home IS NULL").where(inner).select("group").distinct().collect()]
    spans = (placed.where("home IS NULL").where(F.col("group").isin(hit)).groupBy("group")
             .agg(F.min("start"), F.max("end")).collect()) if hit else []
    moved = []
    for cut in cuts:
        for group, start, end in spans:
            if start < cut < end and group not in split:
                cut = start if cut - start <= end - cut else end
        moved.append(cut)
    by_cuts = sum((F.col("start") >= cut).cast("int") for cut in moved) if moved else F.lit(0)
    shard = F.coalesce("home", by_cuts).cast("int")

    # -- slots ------------------------------------------------------------------------
    at = placed.select("range", "group", "doc_id", "size", "text_crc32", shard.alias("shard"))
    earlier = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = at.groupBy("range", "shard").agg(F.count("*").alias("n"))
    counts = counts.select("range", "shard",
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = W.partitionBy("range", "shard").orderBy("group", "doc_id")
    # One row for each range and shard is broadcast: ranges · n.
    return at.join(F.broadcast(counts), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(own) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
