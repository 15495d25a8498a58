import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from latent.llm import align
from latent.llm.bpe import byte_alphabet
from tests.llm.conftest import rows_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(texts, libraries):
    """Every text's groups and links, then counts over all, one token at a time."""
    first, second = libraries
    alphabet, each = byte_alphabet(), []
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, second.id_to_piece(i)) for i in b)]
        data = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            each.append(([], [], [], []))
            continue
        ends = [list(np.cumsum([len(x) for x in s])) for s in (bytes_a, bytes_b)]
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in [
            (b[ends[1].index(e)], e) if e in set(ends[1]) else (None, None)] if f]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        each.append((a, b, groups, links))
    count = Counter(p for *_, links in each for p in links)
    top: dict = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(len(a), len(b), len(g), len(links), sum(count[p] == top[p[1]] for p in links),
             sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
            for a, b, g, links in each]


ODD = {1: "<|endoftext|> <s> </s> <unk> <0x41>", 2: "x▁y", 3: "é combining", 4: " lead  and trail ",
       5: "▁", 6: "tab\tnew\r\nline\x00", 7: "é ﬁ ½ 日本語 🙂🙂", 8: " ", 9: "a" * 3000}


@pytest.mark.parametrize("kept", [{}, {"radices": 3, "fan_in": 2, "chunk_links": 40, "chunk_docs": 4}])
def test_equals_one_token_at_a_time(odd, none, spark, libraries, kept):
    small = odd.where("doc_id is null or doc_id not in (50, 51)")
    docs = small.unionByName(rows_of(spark, {300 + k: t for k, t in ODD.items()}))
    rows = docs.collect()
    want = sorted((str(r.doc_id), *p) for r, p in zip(rows, plain([r.text for r in rows], libraries), strict=True))
    got = align.align(docs, BYTES, PIECES, **kept)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert align.align(none, BYTES, PIECES, **kept).count() == 0


def test_long_texts_keep_all_tokens(odd, libraries):
    got = {r.doc_id: r for r in align.align(odd.where("doc_id in (50, 51)"), BYTES, PIECES).collect()}
    for r in odd.where("doc_id in (50, 51)").collect():
        assert (got[r.doc_id].n_a, got[r.doc_id].n_b) == (
            len(libraries[0].encode(" " + r.text).ids), len(libraries[1].encode(r.text)))


def test_runs_merge_like_a_counter(monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 5)
    r, want, runs = random.Random(4), Counter(), []
    for _ in range(17):
        some = Counter({r.randrange(400): r.randint(1, 9) for _ in range(r.randint(0, 90))})
        want += some
        keys = sorted(some)
        runs.append(align.pack(np.array(keys, np.int64), np.array([some[k] for k in keys], np.int64)))
    pieces = list(align.merge(runs))
    assert [k for p in pieces for k in p[0]] == sorted(want)
    assert [n for p in pieces for n in p[1]] == [want[k] for k in sorted(want)]
    best = list(align.with_best(iter(pieces), 10))
    top = {s: max(n for k, n in want.items() if k // 10 == s) for s in {k // 10 for k in want}}
    assert [(k, n, f) for p in best for k, n, f in zip(*p, strict=True)] == [
        (k, want[k], int(want[k] == top[k // 10])) for k in sorted(want)]
    assert list(align.with_best(iter([]), 10)) == []
