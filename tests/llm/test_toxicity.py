import random

from latent.llm import toxicity
from tests.llm.conftest import prose, rows_of

BAD = ["idiot", "scum", "gruffels", "gruffelt", "gruffelo"]


def corpus(n=400):
    r, texts, labels = random.Random(4), {}, {}
    for i in range(n):
        words, y = prose(1000 + i, 60).split(), int(i % 4 == 0)
        if y:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        texts[i] = ". ".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9))
        labels[i] = y
    return texts, labels


def test_held_out_and_sentences(spark):
    texts, labels = corpus()
    docs = rows_of(spark, texts, [(None, 900, "", "", 0, 0, "", 0), ("", None, "", "", 0, 0, "", 0)])
    marks = spark.createDataFrame([*labels.items(), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, learn=~toxicity.held_out())
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + 2
    known = [r for r in rows if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.97 * len(known)
    assert not any(r.predicted for r in known if not labels[r.doc_id])
    for r in known:
        for s in r.offending:
            assert any(b in texts[r.doc_id][s.start:s.end] for b in BAD)
    assert all(r.score == 0 for r in rows if r.doc_id not in labels)
    # A new word with a telling beginning, and a clean text of any length.
    assert model.score("you gruffelz gruffelz and gruffelk")[0] > 0.7
    assert model.score(prose(5, 40).replace(" ", ". ") * 200)[0] < 0.1
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.predicted for r in rows)


def test_score_is_the_noisy_or():
    model = toxicity.Model(-2.0, {"bad": 3.0, "good": -1.0}, 0.1)
    import math
    p = [1 / (1 + math.exp(-x)) for x in (1.0, -3.0, -2.0)]
    got, parts = model.score("bad bad word. Good one! nothing\n")
    assert abs(got - (1 - math.prod(1 - x for x in p))) < 1e-12
    assert [round(s[2], 9) for s in parts] == [round(x, 9) for x in p]


def test_without_labels(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty)
    assert not any(r.predicted for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, model).count() == 0 and toxicity.accepted(none, model).count() == 0


def test_copies_of_a_sentence_are_held_once():
    import tracemalloc
    sentence = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))
    texts = [f"{sentence}. " * 40] * 200
    tracemalloc.start()
    toxicity.fit(texts, [i % 2 for i in range(200)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
