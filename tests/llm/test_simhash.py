import random

import numpy as np
import xxhash

from latent.llm import simhash
from latent.llm.components import components
from latent.session import Workspace
from tests.llm.conftest import prose, rows_of, texts


def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(prints):
    """Smallest id that links of at most three bits reach, for (id, fingerprint) rows."""
    out, left = {}, sorted({f for _, f in prints})
    while left:
        part, queue = set(), [left[0]]
        while queue:
            one = queue.pop()
            near = [f for f in left if (f ^ one).bit_count() <= 3]
            left = [f for f in left if (f ^ one).bit_count() > 3]
            part |= {one, *near}
            queue += near
        least = min((i for i, f in prints if f in part and i is not None), default=None)
        out |= dict.fromkeys(part, least)
    return out


def test_equals_brute_force(odd, none):
    prints = [(r.doc_id, plain_print(r.text)) for r in odd.collect()]
    named = plain_components(prints)
    got = simhash.near_duplicates(odd).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got), key=key) == sorted(
        ((i, f, named[f]) for i, f in prints), key=key)
    assert simhash.near_duplicates(none).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 63, 1000).astype(np.uint64)
    for radius in (0, 1, 3, 5):
        flips = [sum(1 << b for b in rng.choice(64, n, replace=False).tolist())
                 for n in rng.integers(0, 9, 1000)]
        b = a ^ np.array(flips, np.uint64)
        want = np.array([int(x).bit_count() <= radius for x in a ^ b])
        assert (simhash.within(simhash.planes(a), simhash.planes(b), 1000, radius) == want).all()


def test_large_and_split_buckets(spark):
    """A chain of fingerprints, each near the next, in blocks far smaller than its bucket."""
    r = random.Random(2)
    chain = [r.getrandbits(64)]
    while len(chain) < 400:
        chain.append(chain[-1] ^ (1 << r.randrange(12)) ^ (1 << r.randrange(12)))
    other = [r.getrandbits(64) for _ in range(50)]
    prints = list({f: i for i, f in enumerate(chain + other)}.items())
    rows = spark.createDataFrame([(f - 2 ** 64 if f >> 63 else f,) for f, _ in prints], "fp long")
    want = plain_components([(i, f) for f, i in prints])
    for block in (40, 2048):
        ws = Workspace(spark)
        links = simhash.links(ws, rows, 3, block).collect()
        assert all(((a ^ b) % 2 ** 64).bit_count() <= 3 for a, b in links)
        top = dict(components(ws, spark.createDataFrame(links, "a long, b long")).collect())
        groups = {}
        for f, _ in prints:
            s = f - 2 ** 64 if f >> 63 else f
            groups.setdefault(top.get(s, s), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    small = np.sort(np.array([f for f, _ in prints], np.uint64))
    assert len(simhash.forest(np.zeros(len(small), int), small, 3)) < len(small)


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def plain_groups(texts, threshold=0.8):
    """Smallest id of each id's group, by comparing all texts."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    like = lambda a, b: len(a & b) >= threshold * len(a | b) if a | b else True
    out, left = {}, sorted(texts)
    while left:
        part, queue = set(), [left[0]]
        while queue:
            one = queue.pop()
            near = [i for i in left if i == one or like(sets[i], sets[one])]
            left = [i for i in left if i not in near]
            part |= set(near)
            queue += near
        out |= dict.fromkeys(part, min(part))
    return out


def test_similar_texts_equal_brute_force(spark):
    r, texts = random.Random(8), {}
    for i in range(120):  # copies with a few words changed, about the threshold and above
        words = prose(i // 4, 150).split()
        for at in r.sample(range(150), (i % 4) * 2):
            words[at] = f"new{i}"
        texts[i] = " ".join(words)
    texts |= {200 + i: prose(500, 160) + f" tail{i}" for i in range(150)}  # one large group
    texts |= {400: "", 401: None, 402: "a b", 403: "A  B"}
    for block in (1024, 20):
        rows = simhash.similar_texts(rows_of(spark, texts), block=block).collect()
        groups = {}
        for row in rows:
            groups.setdefault(row.root, set()).add(row.doc_id)
        want = {}
        for i, top in plain_groups(texts).items():
            want.setdefault(top, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_repeats_do_not_hide_equal_shingle_sets(spark):
    """Pairs with the same distinct shingles, one of which repeats a line 60 times."""
    texts = {}
    for i in range(40):
        body, line = prose(i, 150), " " + prose(700 + i, 10)
        texts |= {2 * i: body + line * 2, 2 * i + 1: body + line * 60}
        assert shingle_set(texts[2 * i]) == shingle_set(texts[2 * i + 1])
    rows = simhash.similar_texts(rows_of(spark, texts)).collect()
    root = {r.doc_id: r.root for r in rows}
    assert [i for i in range(40) if root[2 * i] != root[2 * i + 1]] == []


def test_long_texts_about_the_threshold(spark):
    """Pairs of 400 to 2000 words with similarities from 0.74 to 0.86."""
    texts = {}
    for i in range(120):
        words = prose(i, 400 + 13 * i).split()
        shift = len(words) * (0.74 + 0.12 * (i % 40) / 40)
        tail = prose(5000 + i, len(words)).split()[int(2 * shift / (1 + shift / len(words))):]
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(words[:len(words) - len(tail)] + tail)}
    like = [len(a & b) / len(a | b) for a, b in ((shingle_set(texts[2 * i]), shingle_set(texts[2 * i + 1]))
                                                 for i in range(120))]
    assert sum(0.78 < x < 0.8 for x in like) > 10 and sum(0.8 <= x < 0.82 for x in like) > 10
    rows = simhash.similar_texts(rows_of(spark, texts)).collect()
    root = {row.doc_id: row.root for row in rows}
    assert [root[2 * i] == root[2 * i + 1] for i in range(120)] == [x >= 0.8 for x in like]


def test_one_of_each(spark, odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert set(ids) >= set(plain_groups(texts()).values())
    assert not {20, 21, 25, 31, 34, 42, 41} & set(ids) and ids.count(5) == 1
    assert simhash.one_of_each(none).count() == 0
    twice = rows_of(spark, {1: "a b c d e", 2: "x y z u v"})
    assert simhash.one_of_each(twice.union(twice)).count() == 2
