"""Spelling variants by a dictionary of trie-node pairs.

Words sorted forwards make a trie of their prefixes, words sorted backwards one of their
suffixes. A node is numbered when the first word of the sort order reaches it: a word adds one
node for each code point beyond what it shares with its predecessor. Ranges of the sorted
words are numbered apart; between ranges only the last word's nodes are handed on, so a
summary of one row a range fixes all offsets, and numbers are those of one pass over all.

A word then is the pair (prefix node, suffix node) at every place: skipping the code point of
a place gives one pair, inserting nothing another. Words that share a skipped pair differ in
that one code point; a word whose skipped pair is another's plain one has one code point more.
As numbers stand for whole prefixes and suffixes, the integer join is exact. Skipping any of
several like code points in a row gives the same text, so only the first of them meets plain
pairs. A pair holds at most one word for each letter and one plain word: no key can grow hot,
and counts and best neighbours come out of each pair without listing couples.

Nulls and ties: a null text has no runs, a null ``doc_id`` counts as the empty text in the
hash; repeated rows count again; equal counts fall to the smaller word in code-point order; an
empty table gives an empty one. A run of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.session import Workspace

# The letters of a run, as the words' definition names them.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SKIP, FIRST_SKIP, PLAIN = 0, 1, 2


def words(docs: DataFrame, least_chars: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters, each ``every``-th by hash less one code point."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A run shorter than the least length can only give shorter words.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.expr("CAST(_h % length(run) AS INT)")
    cut = F.concat(F.expr("substring(run, 1, _at)"), F.expr("substring(run, _at + 2)"))
    return (low.withColumn("_h", h).withColumn("_at", at)
            .select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= least_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n))


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def _walk(keys: list[str]) -> Iterator[list[int]]:
    """Nodes of each sorted key: −1 where the first key made it, else a serial number."""
    nodes, serial, last = [-1] * len(keys[0]), 0, keys[0]
    yield nodes
    for key in keys[1:]:
        c = _shared(last, key)
        nodes = nodes[:c] + list(range(serial, serial + len(key) - c))
        serial, last = serial + len(key) - c, key
        yield nodes


def _summary(group: pa.Table) -> pa.Table:
    keys = sorted(group.column("key").to_pylist())
    tail, made = [], 0
    for nodes in _walk(keys):
        tail, made = nodes, max(made, nodes[-1] + 1)
    return pa.table({"part": group.column("part").slice(0, 1), "first": [keys[0]],
                     "last": [keys[-1]], "rows": pa.array([len(keys)], pa.int64()),
                     "made": pa.array([made], pa.int64()),
                     "tail": pa.array([tail], pa.list_(pa.int64()))})


def _starts(rows: list) -> dict[int, tuple[int, list[int], int]]:
    """Per range: words before it, nodes of its first word, number of its next node."""
    out, carry, last, before, following = {}, [], "", 0, 1
    for r in sorted(rows, key=lambda r: r["part"]):
        c = _shared(last, r["first"])
        first = carry[:c] + list(range(following, following + len(r["first"]) - c))
        following += len(r["first"]) - c
        out[r["part"]] = (before, first, following)
        carry = [first[d] if t < 0 else following + t for d, t in enumerate(r["tail"])]
        last, before, following = r["last"], before + r["rows"], following + r["made"]
    return out


def numbered(ws: Workspace, rows: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """``rows`` (key distinct and not empty, more columns) with ``rank`` of the key in code-point
    order and ``nodes``, the numbers of its prefixes of 1, 2, … code points.

    The driver sees one row a range of about ``part_chars`` code points.
    """
    chars = rows.agg(F.sum(F.length("key"))).first()[0] or 0
    ranges = rows.repartitionByRange(int(chars // part_chars) + 1, "key").withColumn(
        "part", F.spark_partition_id())
    ranges = ws.cut(ranges, "ranges")  # bounds are drawn from a sample, so they're kept
    seen = ranges.select("part", "key").groupBy("part").applyInArrow(
        _summary, "part int, first string, last string, rows long, made long, tail array<long>")
    starts = _starts(seen.collect())

    def number(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        before, first, following = starts[group.column("part")[0].as_py()]
        keys = group.column("key").to_pylist()
        nodes = [[first[d] if t < 0 else following + t for d, t in enumerate(w)] for w in _walk(keys)]
        return (group.drop_columns(["part"])
                .append_column("rank", pa.array(range(before, before + len(keys)), pa.int64()))
                .append_column("nodes", pa.array(nodes, pa.list_(pa.int64()))))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranges.groupBy("part").applyInArrow(number, f"{shape}, rank long, nodes array<long>")


def pairs(tries: DataFrame) -> DataFrame:
    """(prefix, suffix, word, n, form) of each place of (rank, key, n, nodes, back)."""
    shape = "prefix long, suffix long, word long, n long, form int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "n")),
                       batch.column("nodes"), batch.column("back"), strict=True)
            out: list[list] = [[], [], [], [], []]
            for rank, key, n, nodes, back in rows:
                code = np.frombuffer(key.encode("utf-32-le"), "<u4")
                before = np.concatenate([[0], nodes.values.to_numpy()])
                after = np.concatenate([[0], back.values.to_numpy()])[::-1]
                first = np.concatenate([[True], code[1:] != code[:-1]]).astype(np.int32)
                size = 2 * len(code) + 1
                for column, values in zip(out, (
                        np.concatenate([before[:-1], before]), np.concatenate([after[1:], after]),
                        np.full(size, rank), np.full(size, n),
                        np.concatenate([first, np.full(len(code) + 1, PLAIN, np.int32)])), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), t) for c, t in zip(
                        out, [pa.int64()] * 4 + [pa.int32()], strict=True)],
                    names=["prefix", "suffix", "word", "n", "form"])
    return tries.select("rank", "key", "n", "nodes", "back").mapInArrow(run, shape)


def neighbours(found: DataFrame) -> DataFrame:
    """(word, n_near, best): number of words at one edit and the most frequent of them."""
    met = (found.groupBy("prefix", "suffix").agg(
        F.count("*").alias("_size"), F.collect_list(F.struct("word", "n", "form")).alias("m"))
        .where("_size > 1").select("m"))
    near = """transform(m, x -> named_struct('word', x.word, 'near', transform(
        filter(m, y -> y.word <> x.word AND ((x.form < 2 AND y.form < 2)
               OR (x.form = 1 AND y.form = 2) OR (x.form = 2 AND y.form = 1))),
        y -> named_struct('n', y.n, 'least', -y.word))))"""
    each = met.select(F.explode(F.expr(near)).alias("x")).select("x.word", "x.near").where(
        F.size("near") > 0)
    return each.groupBy("word").agg(F.sum(F.size("near")).cast("long").alias("n_near"),
                                    F.max(F.array_max("near")).alias("best"))


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """(word, to) followed to the end by doubling; a step multiplies the count, so 64 are enough
    for any count and the rounds at most six."""
    now = ws.cut(forms, "roots")
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        if now.join(ahead, "to", "left_semi").isEmpty():
            return now
        now = ws.cut(now.join(ahead, "to", "left").select(
            "word", F.coalesce("_next", "to").alias("to")), "roots")


def group(docs: DataFrame, ratio: int = 10, **kept) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): its count ``n``, how many words are one edit away,
    ``form`` (the most frequent of them, if at least ``ratio`` times as frequent) with its
    count, and ``root``, the end of the chain of forms. ``kept`` goes to :func:`words`."""
    ws = Workspace(docs.sparkSession)
    known = ws.cut(words(docs, **kept), "words")
    forward = ws.cut(numbered(ws, known.withColumnRenamed("word", "key")), "forward")
    back = numbered(ws, forward.select(F.reverse("key").alias("key"), F.col("rank").alias("id")))
    tries = forward.join(back.select(F.col("id").alias("rank"), F.col("nodes").alias("back")), "rank")
    near = ws.cut(neighbours(pairs(tries)), "near")
    names = forward.select(F.col("rank").alias("word_id"), F.col("key").alias("word"), "n")
    mine = names.join(near.withColumnRenamed("word", "word_id"), "word_id", "left")
    with_form = mine.where(F.col("best.n") >= ratio * F.col("n")).select(
        F.col("word_id").alias("word"), (-F.col("best.least")).alias("to"))
    forms = ws.cut(with_form, "forms")
    ends = roots(ws, forms)

    def spelled(links, name):
        return links.join(names.select(F.col("word_id").alias("to"), F.col("word").alias(name),
                                       F.col("n").alias(f"{name}_n")), "to").select(
            F.col("word").alias("word_id"), name, f"{name}_n")
    found = spelled(forms, "form").join(spelled(ends, "root"), "word_id")
    return mine.join(found, "word_id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
