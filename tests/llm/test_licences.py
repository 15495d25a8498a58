import random
import re

from latent.llm import licences


def plain(text, phrases):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, p) for p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted({phrases[p] for _, p in places})))


def test_base_equals_brute_force(odd, none, spark):
    more = spark.createDataFrame([
        ("CC BY cc-by\ncc by MIT_License; gnu general public license gnu general", 70),
        ("Licensed under CC BY-NC 4.0. Été", 71), ("the apache", 72), ("license", 73)],
        "text string, doc_id long")
    rows = odd.select("text", "doc_id").union(more)
    got = licences.scan(rows).collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=key) == sorted(
        ((r.doc_id, *plain(r.text, licences.PHRASES)) for r in rows.collect()), key=key)
    assert {r.labels for r in got if r.doc_id == 71} == {"cc-by,cc-by-nc-4.0"}
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(","))
               for r in got)
    assert licences.scan(none).count() == 0


def test_automaton_streams_matching_statistics():
    r = random.Random(3)
    make = lambda n: " ".join(r.choices("abc", k=n))
    for _ in range(400):
        strings = [make(r.randint(1, 12)) for _ in range(r.randint(0, 4))]
        phrases = {make(r.randint(1, 4)): "p" for _ in range(r.randint(1, 4))}
        s = licences.Scanner([("t", x) for x in strings], phrases, shortest=1)
        text = make(r.randint(0, 40))
        assert plain(text, phrases) == tuple(s.scan(text)[k] for k in (
            "n_words", "n_base", "first_word", "last_word", "base_labels"))
        w, known = text.split(), [x.split() for x in [*strings, *phrases]]
        longest = [max((n for n in range(1, i + 2) if any(
            w[i + 1 - n:i + 1] == q[j:j + n] for q in known for j in range(len(q)))), default=0)
            for i in range(len(w))]
        want = [(i + 1 - n, i + 1) for i, n in enumerate(longest)
                if n and (i + 1 == len(w) or longest[i + 1] <= n)]
        assert [m[:2] for m in s.stream(licences.words_of(text))[1]] == want


def test_spans_of_changed_notices():
    scanner = licences.Scanner()
    for label, notice in licences.TEMPLATES:
        got = scanner.scan("alpha beta " + notice + " gamma delta")
        assert label in got["labels"].split(","), label
        assert any(s["start"] >= 2 and s["coverage"] == 1 for s in got["spans"] if s["label"] == label)
    notice = next(t for k, t in licences.TEMPLATES if k == "isc")
    words = notice.split()
    words[12] = "changed"
    spans = scanner.scan(" ".join(words))["spans"]
    assert [(s["label"], s["start"]) for s in spans] == [("isc", 0)] and 0.9 < spans[0]["coverage"] < 1
    assert "isc" not in scanner.scan(" ".join(words[:10]))["labels"]
    assert "isc" not in scanner.scan(" ".join(reversed(words)))["labels"]
