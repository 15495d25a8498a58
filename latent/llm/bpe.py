"""BPE encoding and decoding of whole texts, exact by tree concatenation.

A text of at most ``leaf_chars`` code points is encoded at once. A longer one is cut in
halves, quarters, … whose leaves are rows of their own, encoded in parallel. Two neighbours
are then joined by encoding a window around the cut again. The window starts and ends at
token boundaries of the halves and grows until its first tokens are those of the left half
and its last ones those of the right half. Then every pair of neighbouring tokens stands in
some encoding of the same bytes, so the seams hold no merge that the whole text would make
(a token sequence is the BPE encoding of a text just when all its neighbouring pairs are).
In the end a window is the whole of both halves, which is right by definition.

Nulls and ties: a null text counts as empty, an empty one has no ids; a null ``doc_id`` stays
null; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.llm.common import ids_and_texts, map_batches

# The split pattern of byte-level BPE files, and the characters on which every
# regex engine agrees about letters, digits and white space (all assigned for decades).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]*")

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character → byte of byte-level vocabularies: printable bytes stand for themselves, the
    others take the characters from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one byte-level vocabulary file.

    Plain texts take a table of merge ranks made from the same file, which costs a third of
    the time; texts with other characters or special tokens go to the library itself.
    """

    def __init__(self, path: str, reach: int = 64, agree: int = 4):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reach, self.agree = reach, agree
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = (token.encode() if token in self.special
                              else bytes(alphabet[c] for c in token))
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        order = list(alphabet) + ["".join(m.split(" ") if isinstance(m, str) else m)
                                  for m in merges]
        self.id_of = np.array([vocab[t] for t in order], "<u4")
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=SPLIT, special_tokens={},
            mergeable_ranks={self.pieces[i]: r for r, i in enumerate(self.id_of.tolist())})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, encoded at once."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.id_of[np.array(self.plain.encode_ordinary(text), np.int64)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of many short texts end to end, and how many each has."""
        whole = "\n".join(words)
        if not PLAIN.fullmatch(whole) or any(s in whole for s in self.special):
            each = [self.encode(w) for w in words]
            return np.concatenate([np.empty(0, "<u4"), *each]), list(map(len, each))
        coded = list(map(self.plain.encode_ordinary, words))
        ids = np.fromiter(chain.from_iterable(coded), np.int64)
        return self.id_of[ids], list(map(len, coded))

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]):
        """The (text, ids) of two neighbours put together."""
        (a, x), (b, y) = left, right
        if not len(x) or not len(y):
            return a + b, x if len(x) else y
        starts = np.concatenate([[0], np.cumsum(self.lengths[x])])
        ends = np.concatenate([[0], np.cumsum(self.lengths[y])])
        reach = max(self.reach, 2 * max(map(len, self.special), default=0))
        while True:
            i = self._cut(a, starts, int(np.searchsorted(starts, len(a) - reach, "right")) - 1, -1)
            j = self._cut(b, ends, int(np.searchsorted(ends, reach)), 1)
            middle = self.encode((a[starts[i]:] + b[:ends[j]]).decode())
            before = self._same(middle, x[i:])
            after = self._same(middle[::-1], y[:j][::-1])
            if ((i == 0 or before >= min(self.agree, len(x) - i))
                    and (j == len(y) or after >= min(self.agree, j))):
                return a + b, np.concatenate([x[:i], middle, y[j:]])
            reach *= 2

    @staticmethod
    def _cut(text: bytes, at: np.ndarray, i: int, step: int) -> int:
        """The token boundary from ``i`` on, in the direction of ``step``, between characters."""
        i = min(max(i, 0), len(at) - 1)
        while 0 < i < len(at) - 1 and text[at[i]] & 0xC0 == 0x80:
            i += step
        return i

    @staticmethod
    def _same(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        unlike = np.flatnonzero(a[:n] != b[:n])
        return int(unlike[0]) if len(unlike) else n

    def concatenate(self, leaves: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Ids of the whole text from those of its leaves, joined pair by pair up the tree."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[i:i + 2]) for i in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(leaves) - len(leaves) % 2:]
        return leaves[0][1]

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(self.decode(ids).encode()).hexdigest())


@lru_cache(2)
def codec_of(path: str) -> Codec:
    """The codec of a file; a Python worker keeps it for all its tasks."""
    return Codec(path)


def halves(text: str, leaf_chars: int) -> list[str]:
    """The leaves of a text that is halved until none is longer than ``leaf_chars``."""
    n = 1
    while -(-len(text) // n) > leaf_chars:
        n *= 2
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [text[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, path: str, leaf_chars: int = 32_768, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): count and digest of its ids and of the decoded text.

    ``path`` is a byte-level BPE file that every executor has. With ``keep_ids`` the ids come
    too, as ``array<int>``. A task holds one text of any length.
    """
    rows = ids_and_texts(docs)
    shape = RESULT + (", ids array<int>" if keep_ids else "")

    def columns(codec, ids, coded):
        done = [codec.digest(c) for c in coded]
        n, a, b = zip(*done, strict=True) if done else ((), (), ())
        out = {"doc_id": ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        return out | ({"ids": [c.tolist() for c in coded]} if keep_ids else {})

    def at_once():
        codec = codec_of(path)
        return lambda batch: columns(codec, batch.column(0), [
            codec.encode(t) for t in batch.column(1).to_pylist()])

    short = map_batches(rows.where(F.length("text") <= leaf_chars), at_once, shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                part = halves(text, leaf_chars)
                for at in range(0, len(part), 64):
                    some = part[at:at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(some), "leaf": pa.array(
                            range(at, at + len(some)), pa.int32()), "text": some})

    def leaves():
        codec = codec_of(path)

        def step(batch):
            return {"key": batch.column(0), "leaf": batch.column(1), "text": batch.column(2),
                    "ids": [codec.encode(t).tobytes() for t in batch.column(2).to_pylist()]}
        return step

    def rejoin(group: pa.Table) -> pa.Table:
        codec = codec_of(path)
        group = group.sort_by("leaf")
        parts = [(t.encode(), np.frombuffer(i, "<u4")) for t, i in zip(
            group.column("text").to_pylist(), group.column("ids").to_pylist(), strict=True)]
        n, a, b = codec.digest(ids := codec.concatenate(parts))
        out = {"key": group.column("key").slice(0, 1), "n_tokens": pa.array([n], pa.int64()),
               "ids_sha256": [a], "decoded_sha256": [b]}
        return pa.table(out | ({"ids": pa.array([ids.tolist()], pa.list_(pa.int32()))}
                               if keep_ids else {}))

    # Rows that repeat both id and text are encoded once and given back as often as they came.
    long = (rows.where(F.length("text") > leaf_chars)
            .withColumn("key", F.sha2(F.concat_ws("|", F.coalesce(
                F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)))
    names = long.groupBy("key", "doc_id").agg(F.count("*").alias("copies"))
    pieces = long.dropDuplicates(["key"]).select("key", "text").mapInArrow(
        cut, "key string, leaf int, text string")
    coded = map_batches(pieces.repartition("key", "leaf"), leaves,
                        "key string, leaf int, text string, ids binary")
    whole = coded.groupBy("key").applyInArrow(rejoin, shape.replace("doc_id long", "key string"))
    joined = (names.join(whole, "key")
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
    return short.unionByName(joined.select(*short.columns))
