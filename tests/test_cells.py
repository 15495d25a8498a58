"""Cells of texts: no shuffle where ids are not repeated, equal rows where they are."""

from latent.operators import corpus

TEXTS = [(1, "b a B"), (2, ""), (3, None), (4, "É é x1x"), (5, "1 2")]
AGAIN = [(1, "b"), (None, "q q"), (None, "q")]
SCHEMA = "doc_id long, text string"


def cells(spark, rows):
    got = corpus.cells_from_text(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    return got, {(r.doc_id, r.term): r.n for r in got.collect()}


def test_texts_of_their_own_id_are_not_shuffled(spark):
    got, n = cells(spark, TEXTS)
    assert n == {(1, "a"): 1, (1, "b"): 2, (4, "é"): 2, (4, "x"): 2}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_meet_however_many_ids_are_repeated(spark, monkeypatch):
    want = {(1, "a"): 1, (1, "b"): 3, (4, "é"): 2, (4, "x"): 2, (None, "q"): 3}
    for listed in (10, 2, 1):
        monkeypatch.setattr(corpus, "REPEATED_IDS", listed)
        got, n = cells(spark, TEXTS + AGAIN)
        assert n == want and got.count() == len(want)
