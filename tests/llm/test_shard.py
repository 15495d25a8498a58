import zlib
from collections import defaultdict

from latent.llm import shard
from tests.llm.conftest import prose, rows_of, texts


def check(docs, n=16):
    rows = shard.shards(docs, n).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
        for r in docs.collect())
    slots, sizes, homes = defaultdict(list), [0] * n, defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, homes


def test_balance_and_whole_groups(spark, odd, none):
    check(odd)
    found = {i: prose(i % 700, 20 + i % 50) for i in range(2000)}
    found |= {5000 + i: prose(9999, 60) for i in range(90)}  # 0.8 of a shard
    sizes, homes = check(rows_of(spark, found))
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16
    assert all(len(h) == 1 for h in homes.values())
    assert shard.shards(none).count() == 0


def test_a_group_beyond_a_shard_is_cut(spark):
    found = {i: prose(1, 40) for i in range(3000)} | {5000 + i: prose(i, 30) for i in range(500)}
    sizes, homes = check(rows_of(spark, found))
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16


def test_few_rows(spark):
    check(rows_of(spark, {1: "a", 2: None}))
    check(rows_of(spark, texts()), 3)
