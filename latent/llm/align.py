"""Alignment of two tokenizers, with pair counts by external spilling and heap merges.

Each text is encoded by both vocabularies. Where tokens of both end at one byte, the text is
cut into groups and the two tokens that end there are linked. Links of many documents fill a
buffer; a full one is spilled as a chunk: its pair-document records, and for each radix of the
second vocabulary's ids one zstd run of (pair, links) in side-major order (second id, then
first). Chunks and runs are rows of a table, so Spark moves them and makes them again when
executors are lost; a run holds each pair once, so no pair can grow hot.

Runs of a radix are merged ``fan_in`` at a time by a heap over their blocks until one is left.
In its order all pairs of a second id are neighbours, so the highest count of an id is known
once the id has passed. The final counts then go back along each group of runs, every chunk
turns those of its own pairs into sums of its documents, and pair-document records never leave
their chunk.

Nulls and ties: a null or empty text has no tokens, as has one whose joined token bytes differ
from a space and the text; such rows have zeros and an empty digest. A null ``doc_id`` stays
null, repeated rows count again and give repeated results; pairs of equal highest count are all
best; an empty table gives an empty one. One text of any length is aligned at once.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.llm.bpe import Codec
from latent.llm.common import ids_and_texts
from latent.session import Workspace

BLOCK = 16_384           # pairs in a block of a run, the unit of merging
SLOT_BITS = 20           # documents of a chunk are numbered in so many bits
SPACE = "▁"         # fixed value: how piece vocabularies write a space


class Pieces:
    """The second vocabulary: a model file whose entries are text, bytes standing as <0xHH>."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                       else self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Aligns texts by a byte-level file and a piece model."""

    def __init__(self, byte_path: str, piece_path: str):
        self.first = Codec(byte_path)
        self.first.tokenizer.encode_special_tokens = True
        self.first.special = []      # strings of special tokens are plain text here
        self.second = Pieces(piece_path)
        sides = (self.first.pieces, self.second.pieces)
        self.lengths = [np.array([len(p) for p in s], np.int64) for s in sides]
        # An id as text with what follows it: within a group, at its end.
        self.inner = [np.array([b"%d," % i for i in range(len(s))], object) for s in sides]
        self.last = [np.array([b"%d%s" % (i, end) for i in range(len(s))], object)
                     for s, end in zip(sides, (b"|", b";"), strict=True)]
        self.width = len(sides[0])

    def align(self, texts: list[str]):
        """(n_a, n_b, n_groups, digest) of each text, and of all links their pair and text number.

        A pair is the second id times ``width`` plus the first.
        """
        none = (0, 0, 0, "")
        out, ids, kept = [none] * len(texts), ([], []), []
        for k, (text, b) in enumerate(zip(texts, self.second.encode(texts), strict=True)):
            if not text:
                continue
            data = (" " + text).encode()
            a = self.first.encode(" " + text)
            if (b"".join([self.second.pieces[i] for i in b]) == data
                    and b"".join([self.first.pieces[i] for i in a.tolist()]) == data):
                ids[0].append(a.astype(np.int64))
                ids[1].append(np.array(b, np.int64))
                kept.append(k)
        if not kept:
            return out, np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = [np.array(list(map(len, s)), np.int64) for s in ids]
        a, b = (np.concatenate(s) for s in ids)
        ends = [np.cumsum(n[i]) for n, i in zip(self.lengths, (a, b), strict=True)]
        cut = []
        for mine, other in (ends, ends[::-1]):
            flag = np.zeros(int(ends[0][-1]) + 1, bool)
            flag[other] = True
            cut.append(flag[mine])
        at_a, at_b = map(np.flatnonzero, cut)
        text_a, text_b = (np.where(c, last[i], inner[i]) for c, last, inner, i in zip(
            cut, self.last, self.inner, (a, b), strict=True))
        # A token stands after all earlier groups, and a second one also after the first ones
        # of its own group.
        group_a, group_b = (np.cumsum(c) - c for c in cut)
        before_b = np.concatenate([[0], at_b + 1])
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_b[group_a]] = text_a
        parts[np.arange(len(b)) + at_a[group_b] + 1] = text_b
        stops = np.cumsum(sizes[0] + sizes[1])
        owner = np.repeat(np.arange(len(kept)), sizes[0])[at_a]
        groups = np.bincount(owner, minlength=len(kept))
        for j, k in enumerate(kept):
            start = stops[j] - sizes[0][j] - sizes[1][j]
            whole = b"".join(parts[start:stops[j]].tolist())[:-1]
            out[k] = (int(sizes[0][j]), int(sizes[1][j]), int(groups[j]),
                      hashlib.sha256(whole).hexdigest())
        return out, b[at_b] * self.width + a[at_a], np.array(kept)[owner]


@lru_cache(2)
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def pack(*columns: np.ndarray) -> bytes:
    """A run: columns of equal length in compressed blocks of at most ``BLOCK`` rows."""
    press, out = zstandard.ZstdCompressor(3), []
    for at in range(0, len(columns[0]), BLOCK):
        some = [c[at:at + BLOCK].astype("<i8") for c in columns]
        # Sorted keys are kept as steps, and bytes by their place in the number.
        some[0] = np.diff(some[0], prepend=0)
        raw = b"".join(s.view(np.uint8).reshape(-1, 8).T.tobytes() for s in some)
        body = press.compress(raw)
        out += [struct.pack("<II", len(some[0]), len(body)), body]
    return b"".join(out)


def blocks(run: bytes, n_columns: int = 2) -> Iterator[list[np.ndarray]]:
    """The blocks of a run, one decompressed at a time."""
    press, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        n, size = struct.unpack_from("<II", run, at)
        raw = np.frombuffer(press.decompress(run[at + 8:at + 8 + size]), np.uint8)
        columns = [np.ascontiguousarray(c.T).view("<i8").ravel()
                   for c in raw.reshape(n_columns, 8, n)]
        columns[0] = np.cumsum(columns[0])
        yield columns
        at += 8 + size


def unpack(run: bytes, n_columns: int = 2) -> list[np.ndarray]:
    found = list(blocks(run, n_columns))
    return [np.concatenate([b[c] for b in found] or [np.empty(0, np.int64)])
            for c in range(n_columns)]


def merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge sorted (pair, links) runs; pieces come in order, each pair once with its sum.

    A heap holds each run's next pair. A step takes all pairs up to the least end of the blocks
    in hand, so every pair taken is complete and memory holds one block a run.
    """
    heap: list[tuple[int, int]] = []
    tops: list[tuple[int, int]] = []        # last pair of each run's block in hand
    rest, hand = [blocks(r) for r in runs], {}

    def load(i: int) -> None:
        block = next(rest[i], None)
        if block is not None:
            hand[i] = block
            heapq.heappush(heap, (int(block[0][0]), i))
            heapq.heappush(tops, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        bound = tops[0][0]
        taken, spent = [], []
        while heap and heap[0][0] <= bound:
            i = heapq.heappop(heap)[1]
            keys, links = hand[i]
            n = int(np.searchsorted(keys, bound, "right"))
            taken.append((keys[:n], links[:n]))
            if n == len(keys):
                spent.append(i)
            else:
                hand[i] = [keys[n:], links[n:]]
                heapq.heappush(heap, (int(keys[n]), i))
        while tops and tops[0][0] <= bound:
            heapq.heappop(tops)
        for i in spent:
            load(i)
        keys, links = (np.concatenate(c) for c in zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield keys[starts], np.add.reduceat(links, starts)


def with_best(pieces: Iterator[tuple[np.ndarray, np.ndarray]], width: int):
    """Pieces of (pair, count, 1 where no pair of its second id counts more), whole ids at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done(keys, counts):
        side = keys // width
        starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        top = np.repeat(np.maximum.reduceat(counts, starts), np.diff([*starts, len(side)]))
        return keys, counts, (counts == top).astype(np.int64)

    for piece in pieces:
        held.append(piece)
        keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        n = int(np.searchsorted(keys, keys[-1] // width * width))   # the last id may go on
        held = [(keys[n:], counts[n:])]
        if n:
            yield done(keys[:n], counts[:n])
    if held:
        yield done(*held[0])


SPILL = ("kind int, chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, "
         "groups_sha256 string, radix int, run binary")
DOC, RECORDS, RUN = 0, 1, 2
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def spill(docs: DataFrame, byte_path: str, piece_path: str, radices: int, chunk_links: int,
          chunk_docs: int, block_chars: int = 1 << 20) -> DataFrame:
    """Rows of ``SPILL``: documents, and the records and runs of each chunk of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape, tool = to_arrow_schema(schema), aligner_of(byte_path, piece_path)
        chunk, found, pairs, slots, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def rows(**columns):
            n = max(len(c) for c in columns.values() if isinstance(c, list))
            full = {f.name: columns.get(f.name) for f in shape}
            return pa.RecordBatch.from_arrays(
                [pa.array(c if isinstance(c, list) else [c] * n, f.type)
                 for f, c in zip(shape, full.values(), strict=True)], schema=shape)

        def flush():
            ids, figures = zip(*found, strict=True)
            n_a, n_b, n_groups, digest = map(list, zip(*figures, strict=True))
            yield rows(kind=DOC, chunk=chunk, slot=list(range(len(ids))), doc_id=list(ids), n_a=n_a,
                       n_b=n_b, n_groups=n_groups, groups_sha256=digest)
            if not held:
                return
            both = np.sort(np.concatenate(pairs) << SLOT_BITS | np.concatenate(slots))
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            times = np.diff([*starts, len(both)])
            keys, slot = both[starts] >> SLOT_BITS, both[starts] & ((1 << SLOT_BITS) - 1)
            yield rows(kind=RECORDS, chunk=chunk, run=[pack(keys, slot, times)])
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, links = keys[at], np.add.reduceat(times, at)
            radix = keys // tool.width % radices
            used = np.unique(radix).tolist()
            yield rows(kind=RUN, chunk=chunk, radix=used, run=[
                pack(keys[radix == r], links[radix == r]) for r in used])

        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in (0, 1))
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= block_chars) \
                        and len(found) + stop - at < chunk_docs:
                    chars += len(texts[stop])
                    stop += 1
                figures, keys, owner = tool.align(texts[at:stop])
                pairs.append(keys)
                slots.append(owner + len(found))
                found += zip(ids[at:stop], figures, strict=True)
                held, at = held + len(keys), stop
                if held >= chunk_links or len(found) >= chunk_docs:
                    yield from flush()
                    chunk, found, pairs, slots, held = chunk + 1, [], [], [], 0
        if found:
            yield from flush()

    schema = docs.sparkSession.createDataFrame([], SPILL).schema
    return ids_and_texts(docs).mapInArrow(run, schema)


def _merged(group: pa.Table) -> pa.Table:
    pieces = list(merge(group.column("run").to_pylist()))
    run = b"".join(pack(*p) for p in pieces)
    return pa.table({"radix": group.column("radix").slice(0, 1),
                     "part": group.column("part").slice(0, 1), "run": pa.array([run], pa.binary())})


def counted(ws: Workspace, runs: DataFrame, n_chunks: int, width: int, fan_in: int) -> DataFrame:
    """(radix, counts): for each radix the merged run of (pair, count, best)."""
    now, left = runs.select("radix", F.col("chunk").alias("part"), "run"), n_chunks
    while left > fan_in:
        left = -(-left // fan_in)
        now = ws.cut(now.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(left)))
                     .groupBy("radix", "part")
                     .applyInArrow(_merged, "radix int, part long, run binary"), "merged")

    def last(group: pa.Table) -> pa.Table:
        runs = group.column("run").to_pylist()
        return pa.table({"radix": group.column("radix").slice(0, 1), "counts": pa.array(
            [b"".join(pack(*p) for p in with_best(merge(runs), width))], pa.binary())})
    return ws.cut(now.groupBy("radix").applyInArrow(last, "radix int, counts binary"), "counts")


def returned(runs: DataFrame, counts: DataFrame, n_groups: int) -> DataFrame:
    """(chunk, radix, run): of each run's pairs the pair, its count and whether it is best."""
    def back(mine: pa.Table, final: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows:
            keys, count, best = unpack(final.column("counts")[0].as_py(), 3)
            for run in mine.column("run").to_pylist():
                own = unpack(run)[0]
                at = np.searchsorted(keys, own)
                out.append(pack(own, count[at], best[at]))
        return pa.table({"chunk": mine.column("chunk"), "radix": mine.column("radix"),
                         "run": pa.array(out, pa.binary())})
    part = F.pmod(F.xxhash64("chunk"), F.lit(n_groups))
    spread = counts.withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    return (runs.select("chunk", "radix", "run", part.alias("part")).groupBy("radix", "part")
            .cogroup(spread.groupBy("radix", "part"))
            .applyInArrow(back, "chunk long, radix int, run binary"))


def _document_sums(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """Figures of a chunk's documents from its records and the counts of its pairs."""
    docs = docs.sort_by("slot")
    sums = np.zeros((2, docs.num_rows), np.int64)
    if parts.num_rows:
        kinds = parts.column("radix").to_pylist()
        runs = parts.column("run").to_pylist()
        keys, slot, times = unpack(runs[kinds.index(None)], 3)
        known = [unpack(r, 3) for k, r in zip(kinds, runs, strict=True) if k is not None]
        pair, count, best = (np.concatenate(c) for c in zip(*known, strict=True))
        order = np.argsort(pair)
        at = order[np.searchsorted(pair, keys, sorter=order)]
        np.add.at(sums[0], slot, times * best[at])
        np.add.at(sums[1], slot, times * count[at])
    names = [f.split()[0] for f in RESULT.split(", ")]
    columns = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
    columns |= {"n_links": docs.column("n_groups"), "n_best": sums[0], "count_sum": sums[1]}
    return pa.table({n: columns[n] for n in names})


def align(docs: DataFrame, byte_path: str, piece_path: str, radices: int = 32, fan_in: int = 256,
          chunk_links: int = 1 << 20, chunk_docs: int = 1 << 13) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens of both vocabularies, groups, links, how many
    links are of their second id's most frequent pair, and the sum of the links' pair counts.

    Tokens never are empty, so each group ends in one link. Both files must be on every executor.
    """
    if not 0 < chunk_docs <= 1 << SLOT_BITS:
        raise ValueError(f"chunk_docs must be 1 to {1 << SLOT_BITS}")
    tool = aligner_of(byte_path, piece_path)
    if not all(n.all() for n in tool.lengths):
        raise ValueError("a vocabulary holds an empty token")
    ws = Workspace(docs.sparkSession)
    spilled = spill(docs, byte_path, piece_path, radices, chunk_links, chunk_docs)
    rows, records, runs = ws.split(spilled, "spilled", "kind", 3)
    n_chunks = records.count()
    counts = counted(ws, runs, n_chunks, tool.width, fan_in)
    back = returned(runs, counts, max(1, -(-n_chunks // fan_in)))
    parts = records.select("chunk", F.lit(None).cast("int").alias("radix"), "run").unionByName(back)
    figures = rows.select("chunk", "slot", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return figures.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(
        lambda d, p: _document_sums(d, p), RESULT)
