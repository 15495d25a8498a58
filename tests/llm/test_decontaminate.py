import re

from latent.llm import decontaminate
from tests.llm.conftest import prose, rows_of, texts


def parts(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_equals_brute_force(spark, odd, none):
    items = {1: prose(500, 30), 2: prose(501, 12), 3: "Only three words", 4: "", 5: None,
             6: prose(502, 80), 7: prose(503, 7)}
    found = texts()
    found |= {60: prose(1, 40) + " " + items[1].upper() + " " + prose(2, 900),
              61: items[2] + "!", 62: "x only, THREE words. y", 63: "only three words",
              64: " ".join(items[6].split()[:70]), 65: " ".join(items[6].split()[:60]),
              66: items[1] + " " + items[6], 67: items[7].replace(" ", "\n")}
    docs = rows_of(spark, found, [(items[1], None, "", "", 0, 0, "", 0),
                                  ("clean", None, "", "", 0, 0, "", 0),
                                  (items[1], 66, "", "", 0, 0, "", 0)])
    bench = spark.createDataFrame([(t, i) for i, t in items.items()], "text string, item_id long")
    want = set()
    for r in docs.collect():
        for i, t in items.items():
            s = parts(t)
            shared = len(s & parts(r.text))
            if s and shared >= 0.8 * len(s) - 1e-9:
                want.add((r.doc_id, i, len(s), shared))
    got = [(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in
           decontaminate.leaks(docs, bench).collect()]
    assert {(66, 1), (66, 6), (None, 1), (64, 6), (63, 3), (67, 7)} <= {w[:2] for w in want}
    assert set(got) == want and (65, 6) not in {w[:2] for w in want}
    kept = decontaminate.clean(docs, bench)
    bad = {w[0] for w in want}
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in docs.collect() if r.doc_id not in bad or r.text == "clean")
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()
