import random
import re
import zlib
from collections import Counter

import pytest

from latent.llm import variants
from latent.session import Workspace
from tests.llm.conftest import rows_of


def plain_words(rows, least_chars=7, least_n=2, every=31):
    n = Counter()
    for doc, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group())
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % every == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += len(low) >= least_chars
    return {w: c for w, c in n.items() if c >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return (a[i + 1:] == b[i + 1:] and len(a) == len(b) and a != b) or (
        len(b) == len(a) + 1 and a[i:] == b[i + 1:])


def plain(n):
    form, near = {}, {}
    for w in n:
        them = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        near[w] = len(them)
        best = min(them, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def spelled(spark):
    """Words over two letters, whose neighbourhoods are dense, with counts of many sizes."""
    r, found = random.Random(3), {}
    pool = ["".join(r.choices("ab", k=r.randint(6, 9))) for _ in range(150)]
    pool += ["ÉclairsX", "éclairsx", "eclairsx", "strasseß", "A×B÷CdEfg", "aaaaaaaa", "aaaaaaa",
             "aaaaaaaaa", "x" * 9000, "x" * 9001]
    for d in range(60):
        some = r.choices(pool, weights=[1 / (i + 1) for i in range(len(pool))], k=120)
        found[100 + d] = " ".join(some) + " " + " ".join(pool[:3] * 20)
    return rows_of(spark, found)


def test_equals_brute_force(odd, none, spelled):
    docs = odd.unionByName(spelled)
    want = plain(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = variants.group(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == want and any(w[1] for w in want)
    assert rows(variants.group(none)) == []


def test_chains_of_forms_are_followed(spark):
    steps = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    text = " ".join(w for i, w in enumerate(steps) for _ in range(2 * 10 ** i))
    docs = rows_of(spark, {1: text})
    got = {r.word: r for r in variants.group(docs, every=10 ** 12).collect()}
    assert [got[w].form for w in steps] == [*steps[1:], None]
    assert {r.root for r in got.values()} == {steps[-1]}


def test_numbers_do_not_depend_on_ranges(spark):
    r = random.Random(8)
    keys = sorted({"".join(r.choices("abé", k=r.randint(1, 8))) for _ in range(300)} | {"a" * 400, "a" * 401})
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i long")
    ws = Workspace(spark)
    many = variants.numbered(ws, frame, part_chars=60).collect()
    assert [(r["key"], r["rank"]) for r in sorted(many, key=lambda r: r["rank"])] == list(zip(keys, range(len(keys)), strict=True))
    nodes = {}
    for row in many:
        for d, node in enumerate(row["nodes"]):
            assert nodes.setdefault(row["key"][:d + 1], node) == node
    assert sorted(nodes.values()) == list(range(1, len(nodes) + 1))
