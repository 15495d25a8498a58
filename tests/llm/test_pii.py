import hashlib
import re

from latent.llm import pii
from tests.llm.conftest import rows_of, texts

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [x * 2 // 10 + x * 2 % 10 if i % 2 else x for i, x in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    spans = [(m.start(), i, m.end()) for i, k in enumerate(PLAIN)
             for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]
    return [f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def planted():
    cards = ["4111111111111111", "5500 0055 5555 5559", "4012-8888-8888-1881"]
    out = {}
    for i in range(60):
        out[100 + i] = (f"é🙂 mail a{i}.b@mail{i}.example.com and +1 (286) 555-51{i:02d} from 10.2.{i}.7 "
                        f"card {cards[i % 3]} end, number {i}-{i * 37} v1.{i} no {i * 7919:08d}")
    return out


ODD = {1: "x.y@a.b_c@d.e.f @@ a@b a@b.", 2: "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 1.2.3.256",
       3: "+1 (826) 555-4081 190.137.223.204 tail", 4: "4111111111111111 4012888888881881 x",
       5: "9" * 20000 + " " + "a" * 20000, 6: "1-" * 9000 + "1", 7: "+1" + " " * 9000 + "2",
       8: "ab4111111111111111cd", 9: "a@" * 3000, 10: "1." * 5000, 11: "0000000000000"}


def test_strict_spans_equal_plain_patterns(spark, odd, none):
    docs = odd.unionByName(rows_of(spark, planted() | {200 + k: t for k, t in ODD.items()}))
    got = pii.find(docs, rounds=3).collect()
    key = [(r.doc_id is None, r.doc_id or 0) for r in got]
    want = [(r.doc_id, base(r.text)) for r in docs.collect()]
    assert len(got) == len(want) and sorted(key) == sorted((d is None, d or 0) for d, _ in want)
    digest = sorted((str(d), hashlib.sha256(",".join(b).encode()).hexdigest(), len(b)) for d, b in want)
    assert digest == sorted((str(r.doc_id), r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone)
                            for r in got)
    every = {r.doc_id: set(r.spans.split(",")) for r in got if r.doc_id is not None}
    assert all(set(b) <= every[d] for d, b in want if d is not None and b and d not in (5, 7))
    assert pii.find(none).count() == 0


def test_swallowed_spans_are_added(spark):
    rows = planted() | {3: ODD[3], 4: ODD[4], 8: ODD[8]}
    got = {r.doc_id: r.spans.split(",") for r in pii.find(rows_of(spark, rows)).collect()}
    assert "phone:0:17" in got[3] and "ip:18:33" in got[3]
    assert {"card:0:16", "card:17:33"} <= set(got[4])
    assert got[8] == base(ODD[8])
    clean = texts()
    quiet = {r.doc_id: r.spans for r in pii.find(rows_of(spark, clean | planted())).collect()}
    assert all(quiet[i] == "" for i in clean)


def test_a_tree_equals_its_plain_fit(spark):
    """One round on a small table against all cuts tried one by one."""
    rows = [tuple((i * (j + 3) // 2) % 4 for j in range(len(pii.NAMES)))
            + (5 + i % 3, (i * i) % 5, 0, 0) for i in range(40)]
    cols = ", ".join(f"{n} int" for n in pii.NAMES) + ", n long, hits long, n_kept long, hits_kept long"
    model = pii.fit(spark.createDataFrame(rows, cols), rounds=1)
    n, hits = sum(r[-4] for r in rows), sum(r[-3] for r in rows)
    p = (hits + .5) / (n + 1)

    def gain(name, value):
        at = pii.NAMES.index(name)
        sides = [[r for r in rows if (r[at] > value) == s] for s in (False, True)]
        return sum(sum(r[-3] - r[-4] * p for r in s) ** 2 / (sum(r[-4] for r in s) * p * (1 - p) + 1)
                   for s in sides)
    best = max(gain(x, v) for x in pii.NAMES for v in range(3))
    assert abs(gain(*model.trees[0][:2]) - best) < 1e-3
