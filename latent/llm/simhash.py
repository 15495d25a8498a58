"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints at distance ``radius`` or less agree in at least two of ``radius + 2`` blocks of
bits, so equal values of a block pair make the buckets in which all neighbours meet. Within a
bucket, bit planes are stored one after the other and the distances of many pairs grow
together: each plane is added to a bitwise counter with carry-save logic, and words of 64
pairs are left out once all of them exceed the radius. A bucket beyond ``block`` fingerprints
is split into blocks, and each pair of blocks is a group of its own, so no group is unbounded.

A group gives a spanning forest of its links, never all pairs: reachability is kept.

``one_of_each`` asks for texts whose sets of five-word shingles have a similarity of 0.8 or
more. Candidates are the links of bit-sliced comparison of fingerprints over distinct
shingles, and, as such texts may differ in ten bits and more, texts that share one of
``BANDS`` keys of four shingle minima (similarity s shares a key with probability s⁴, so a pair
at 0.8 is missed in 0.59^28, four of ten million cases). Only keys move. Texts that candidates
connect are one class; its whole shingle sets meet once and all its pairs that links don't
connect yet are compared exactly, so no link is wrong. A class too large for one task is cut
into pairs of blocks, of the class or of its buckets, whichever moves less.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latent.llm.common import map_batches, words_of
from latent.llm.components import components
from latent.session import Workspace

BITS = 64


# -- fingerprints ---------------------------------------------------------------------

def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if over half of the shingle hashes have it; no words give zero."""
    from xxhash import xxh64_intdigest
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    shingles = zip(*(words[i:] for i in range(width)), strict=False)
    return majority(np.fromiter((xxh64_intdigest(join(s), seed) for s in shingles), np.uint64,
                                len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 1 << 15):
        part = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def start():
        def step(batch):
            prints = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()],
                              np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": prints}
        return step

    return map_batches(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"),
                       start, "doc_id long, text_hash long, fp long")


# -- bit-sliced comparison ------------------------------------------------------------

def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all fingerprints, 64 of them a word."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((BITS, -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def within(a: np.ndarray, b: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Which of ``n`` pairs, given by their bit planes, differ in at most ``radius`` bits.

    ``b`` has as many words as ``a``, or one for each plane (a single fingerprint against
    many). Counters start so that they run over just when a distance exceeds the radius.
    """
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    live, words = None, a.shape[1]
    count = [np.full(words, ~np.uint64(0) if start >> k & 1 else 0, np.uint64)
             for k in range(size)]
    over = np.zeros(words, np.uint64)
    beyond = np.full(words, ~np.uint64(0))
    full = ~np.uint64(0)
    for i in range(BITS):
        carry = (a[i] if live is None else a[i, live]) ^ (
            b[i] if live is None or b.shape[1] == 1 else b[i, live])
        for k in range(size):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if i % 8 == 7:
            kept = np.flatnonzero(over != full)
            if len(kept) < 0.7 * len(over):  # abandon the words in which all exceed it
                live = kept if live is None else live[kept]
                count, over = [c[kept] for c in count], over[kept]
                if not len(kept):
                    break
    if live is None:
        beyond = over
    else:
        beyond[live] = over
    return np.unpackbits(~beyond.view(np.uint8))[:n].astype(bool)


def forest(ids: np.ndarray, fps: np.ndarray, radius: int, small: int = 64) -> np.ndarray:
    """Links (m × 2 positions) that span every group's components; ``ids`` are sorted."""
    links, sizes = [], np.diff(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]))
    size = np.repeat(sizes, sizes)
    few = np.flatnonzero(size <= small)
    pairs = []
    for shift in range(1, small):  # neighbours at this distance in the order, in all groups
        few = few[few + shift < len(ids)]
        few = few[ids[few] == ids[few + shift]]
        if not len(few):
            break
        near = few[within(planes(fps[few]), planes(fps[few + shift]), len(few), radius)]
        pairs.append(np.stack([near, near + shift], 1))
    if pairs:
        links.append(_spanning(np.concatenate(pairs)))
    starts = np.cumsum(sizes) - sizes
    for start, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        links.append(_spread(np.arange(start, start + n), fps, radius))
    return np.concatenate(links) if links else np.empty((0, 2), np.int64)


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join two parts when taken in order."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append(i)
    return pairs[kept]


def _spread(rest: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links of one large group: each member is compared with the unreached rest."""
    links = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            bits = planes(fps[one:one + 1]).any(axis=1)[:, None] * ~np.uint64(0)
            near = within(planes(fps[rest]), bits, len(rest), radius)
            found = rest[near]
            links += [(one, f) for f in found]
            queue += found.tolist()
            rest = rest[~near]
    return np.array(links, np.int64).reshape(-1, 2)


# -- search ---------------------------------------------------------------------------

def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of ``radius + 2`` blocks of bits, as signed longs."""
    n = radius + 2
    cuts = [i * BITS // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [(a | b) - (1 << BITS if (a | b) >> 63 else 0) for a, b in combinations(blocks, 2)]


def links(ws: Workspace, prints: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` of ``prints`` within the radius."""
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"),
                                       F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                              for i, m in enumerate(block_masks(radius)))))
    keyed = prints.select("fp", key.alias("k")).select("fp", "k.mask", "k.key")
    large = ws.cut(keyed.groupBy("mask", "key").agg(F.count("*").alias("n"))
                   .where(F.col("n") > block), "large")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # A fingerprint of part i goes to the pairs (i, j) and (j, i) of parts, one group each.
    groups = (keyed.join(large, ["mask", "key"], "left")
              .select("fp", "mask", "key", own.alias("i"), parts.alias("parts"))
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("fp", "mask", "key", F.least("i", "j").alias("i"),
                      F.greatest("i", "j").alias("j")))
    at = ["mask", "key", "i", "j"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give(rows):
            ids = np.cumsum(np.r_[0, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            found = rows[:, 4][forest(ids, rows[:, 4].copy().view(np.uint64), radius)]
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])],
                                              ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in batch.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            cut = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            whole = len(rows) and (len(cut) or (held[0][0, :4] != rows[-1, :4]).any())
            if whole:  # all groups but the last one are complete
                every = np.concatenate(held)
                last = np.flatnonzero((every[:, :4] != every[-1, :4]).any(axis=1))[-1] + 1
                held = [every[last:]]
                yield give(every[:last])
        if held:
            yield give(np.concatenate(held))

    dealt = groups.repartition(*at).sortWithinPartitions(*at, "fp").select(*at, "fp")
    return dealt.mapInArrow(find, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3,
                    block: int = 2048) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` that links reach. Null texts count as empty;
    texts without words share the fingerprint zero. A null ``doc_id`` is larger than all
    others, so it names a component only if that has no other id, and is null then. Repeated
    rows stay, each with its component; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    prints = ws.cut(fingerprints(docs, width), "prints")
    unique = ws.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    roots = components(ws, links(ws, unique, radius, block))
    rooted = unique.join(roots, unique.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    parts = ws.cut(rooted.join(named, "root").select("fp", "component_id"), "parts")
    return prints.join(parts, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- texts of similar shingle sets ----------------------------------------------------

BANDS, ROWS = 28, 4


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text in order; a text without words has that of
    no words at all."""
    from xxhash import xxh64_intdigest
    words = words_of(text)
    join, n = b" ".join, max(len(words) - width + 1, 1)
    return np.unique(np.fromiter((xxh64_intdigest(join(words[i:i + width]), 42)
                                  for i in range(n)), np.uint64, n))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """A key hashes ``ROWS`` shingle minima, each under an order of its own."""
    from xxhash import xxh64_intdigest
    odd = (np.random.default_rng(7).integers(0, 1 << 62, BANDS * ROWS, np.uint64) * np.uint64(2)
           + np.uint64(1))
    least = [int((hashes * m ^ (hashes * m >> np.uint64(29))).min()) for m in odd]
    keys = [xxh64_intdigest(repr(least[b * ROWS:(b + 1) * ROWS])) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def similar_sets(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that span the parts of sets with a Jaccard similarity of ``threshold`` or more.
    Similarities are exact: each member is counted against all sets not reached so far."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        if sizes.min() < threshold * sizes.max() - 1e-9:
            return []
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both >= threshold * (sizes.sum() - both) - 1e-9 else []
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [codes[e - n:e] for e, n in zip(ends, sizes, strict=True)]
    mark, found = np.zeros(len(values), bool), []
    order = np.argsort(sizes, kind="stable")  # sets of like size are a range of the order
    rest = order
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        flat = np.concatenate([own[i] for i in rest]) if len(rest) else codes[:0]
        while queue and len(rest):
            one = queue.pop()
            size, at = sizes[rest], np.r_[0, np.cumsum(sizes[rest])]
            low = np.searchsorted(size, threshold * sizes[one] - 1e-9)
            high = np.searchsorted(size, sizes[one] / threshold + 1e-9, "right")
            if low >= high:
                continue
            mark[own[one]] = True
            both = np.add.reduceat(mark[flat[at[low]:at[high]]], at[low:high] - at[low],
                                   dtype=np.int64)
            mark[own[one]] = False
            near = np.zeros(len(rest), bool)
            near[low:high] = both >= threshold * (sizes[one] + size[low:high] - both) - 1e-9
            if near.any():
                found += [(one, i) for i in rest[near]]
                queue += rest[near].tolist()
                flat, rest = flat[np.repeat(~near, size)], rest[~near]
    return found


def marked(ws: Workspace, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n, fp, keys) of every row: distinct shingles, their fingerprint, and
    the keys of their minima."""
    rows = _texts_of(docs)

    def start():
        def step(batch):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            return {"doc_id": batch.column(0), "text_hash": batch.column(1),
                    "n": [len(s) for s in sets], "keys": [bucket_keys(s) for s in sets],
                    "fp": np.array([majority(s) for s in sets], np.uint64).view(np.int64)}
        return step

    return ws.cut(map_batches(rows, start, "doc_id long, text_hash long, n long, fp long, "
                              "keys array<bigint>"), "marks")


def _texts_of(docs: DataFrame) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))


def candidate_classes(ws: Workspace, unique: DataFrame, keyed: DataFrame, radius: int = 3):
    """Classes (node, root) of texts that candidates connect, and the buckets with several texts.

    A bucket's or fingerprint's texts hang on the least of them, so links are as many as
    memberships, however large a bucket is.
    """
    shared = ws.cut(keyed.groupBy("band", "key").agg(
        F.count("*").alias("texts"), F.sum("n").alias("size"), F.min("text_hash").alias("hub"),
        F.sum(F.col("text_hash").cast("decimal(38,0)")).alias("mark")).where("texts > 1"), "shared")
    stars = keyed.join(shared.select("band", "key", "hub"), ["band", "key"]).select(
        F.col("text_hash").alias("a"), F.col("hub").alias("b"))
    prints = ws.cut(unique.groupBy("fp").agg(F.min("text_hash").alias("hub")), "prints")
    equal = unique.join(prints, "fp").select(F.col("text_hash").alias("a"), F.col("hub").alias("b"))
    near = links(ws, prints.select("fp"), radius)
    ends = [prints.select(F.col("fp").alias(side), F.col("hub").alias(f"{side}_hub")) for side in "ab"]
    close = near.join(ends[0], "a").join(ends[1], "b").select(
        F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    found = components(ws, stars.unionByName(equal).unionByName(close))
    tops = found.select(F.col("root").alias("node"), "root").distinct()
    return ws.cut(found.unionByName(tops), "classes"), shared


def similar_classes(ws: Workspace, docs: DataFrame, marks: DataFrame, width: int, threshold: float,
                    block: int, hashes: int) -> DataFrame:
    """(node, root) of every text hash that a link of similar shingle sets reaches."""
    unique = ws.cut(marks.select("text_hash", "n", "fp", "keys").dropDuplicates(["text_hash"]), "unique")
    keyed = unique.select("text_hash", "n", F.posexplode("keys").alias("band", "key"))
    classes, shared = candidate_classes(ws, unique, keyed)

    def parts(texts, size):
        return F.ceil(F.greatest(F.col(texts) / block, F.col(size) / hashes)).cast("int")

    sized = unique.join(classes, unique.text_hash == classes.node).select("text_hash", "n", "root")
    whole = ws.cut(sized.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("size"))
                   .withColumn("parts", parts("texts", "size")), "class-sizes")
    # Buckets of the same texts need comparing once.
    buckets = (shared.groupBy("texts", "size", "hub", "mark").agg(F.min(F.struct("band", "key")).alias("at"))
               .select("at.band", "at.key", F.col("hub").alias("node"), "texts", parts("texts", "size").alias("parts")))
    dealt = ws.cut(buckets.join(classes, "node").join(whole.where("parts > 1").select("root"), "root")
                   .select("root", "band", "key", "texts", "parts"), "buckets")
    costs = dealt.groupBy("root").agg(F.sum(F.col("texts") * F.col("parts")).alias("cost"))
    split = whole.join(costs, "root").where(F.col("cost") < F.col("texts") * F.col("parts")).select("root")
    by_class = (sized.join(whole.join(split, "root", "left_anti").select("root", "parts"), "root")
                .select("text_hash", F.struct(F.lit(-1).alias("band"), F.col("root").alias("key"), "parts").alias("p")))
    by_bucket = (keyed.join(dealt.join(split, "root", "left_semi").select("band", "key", "parts"), ["band", "key"])
                 .select("text_hash", F.struct("band", "key", "parts").alias("p")))
    places = ws.cut(by_class.unionByName(by_bucket).groupBy("text_hash").agg(
        F.collect_list("p").alias("places")), "places")  # at most one, or one a band

    def build():
        def step(batch):
            return {"text_hash": batch.column(0), "places": batch.column(1),
                    "shingles": [shingle_set(t, width).tobytes()
                                 for t in batch.column(2).to_pylist()]}
        return step

    texts = _texts_of(docs).select("text_hash", "text").join(
        places.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = map_batches(texts.join(places, "text_hash").select("text_hash", "places", "text"), build,
                       "text_hash long, places array<struct<band:int,key:bigint,parts:int>>, "
                       "shingles binary")
    at = ["band", "key", "i", "j"]
    groups = (sets.select("text_hash", "shingles", F.explode("places").alias("p"))
              .select("text_hash", "shingles", F.col("p.band").cast("long").alias("band"), "p.key",
                      F.pmod(F.xxhash64("text_hash"), "p.parts").cast("int").alias("i"), "p.parts")
              .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("band", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
                      "text_hash", "shingles"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node, sets = None, [], []

        def links():
            found = similar_sets(sets, threshold) if len(sets) > 1 else []
            return [node[a] for a, _ in found], [node[b] for _, b in found]

        for batch in batches:
            place = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                              for n in at], 1)
            names, held, a, b = batch.column("text_hash").to_pylist(), batch.column("shingles"), [], []
            for k, here in enumerate(map(tuple, place.tolist())):
                if here != last:
                    more = links()
                    a, b = a + more[0], b + more[1]
                    last, node, sets = here, [], []
                node.append(names[k])
                sets.append(np.frombuffer(held[k].as_py(), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             ["a", "b"])
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                         ["a", "b"])

    sorted_groups = groups.repartition(*at).sortWithinPartitions(*at)
    return components(ws, sorted_groups.mapInArrow(find, "a long, b long").distinct())


def similar_texts(docs: DataFrame, width: int = 5, threshold: float = 0.8, block: int = 1024,
                  hashes: int = 1 << 21) -> DataFrame:
    """(doc_id, text_hash, root) of every row: rows have the same root if links of texts with
    similar shingle sets connect them. Equal texts are compared once. A class of more than
    ``block`` texts or ``hashes`` shingles is split."""
    ws = Workspace(docs.sparkSession)
    marks = marked(ws, docs, width)
    roots = similar_classes(ws, docs, marks, width, threshold, block, hashes)
    return marks.select("doc_id", "text_hash").join(
        roots, marks.text_hash == roots.node, "left").select(
        "doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, block: int = 1024,
                hashes: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` that represent their group of similar texts, with all columns.

    That is the row of the smallest ``doc_id`` (then text hash); of rows that repeat both,
    one stays. A row without ``doc_id`` stays only if its whole group has none. All texts
    without words are one group.
    """
    ws = Workspace(docs.sparkSession)
    found = marked(ws, docs, width)
    roots = similar_classes(ws, docs, found, width, threshold, block, hashes)
    # Copies of a text fold into one row before anything is joined on the text.
    texts = found.groupBy("text_hash").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("least"))
    rooted = texts.join(roots, texts.text_hash == roots.node, "left").select(
        F.coalesce("root", "text_hash").alias("root"),
        F.struct("least.last", "least.doc_id", "text_hash").alias("order"))
    kept = rooted.groupBy("root").agg(F.min("order").alias("best")).select(
        "best.doc_id", "best.text_hash")
    kept = ws.cut(kept, "kept")
    counts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stay = counts.join(kept, counts.doc_id.eqNullSafe(kept.doc_id)
                       & (counts.text_hash == kept.text_hash), "left_semi")
    drop = ws.cut(counts.join(kept, counts.doc_id.eqNullSafe(kept.doc_id)
                              & (counts.text_hash == kept.text_hash), "left_anti")
                  .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "drop")
    again = ws.cut(stay.where("n > 1").select(F.col("doc_id").alias("_id"),
                                              F.col("text_hash").alias("_hash")), "again")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def match(side):
        return docs.doc_id.cast("long").eqNullSafe(side["_id"]) & (key == side["_hash"])

    single = docs.join(drop, match(drop), "left_anti")
    if again.isEmpty():
        return single
    name = "_" * max(map(len, docs.columns)) + "_hash"  # no column is called so
    repeated = docs.join(again, match(again), "left_semi").withColumn(name, key)
    once = repeated.dropDuplicates(["doc_id", name]).drop(name)
    return single.join(again, match(again), "left_anti").unionByName(once)
