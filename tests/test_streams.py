import pytest
from pyspark.sql import functions as F

from catalog import fits
from latent.session import Workspace
from latent.streaming import fold

ROWS = [(d, w, 1 + (d * i) % 3) for d in range(12) for i, w in enumerate("abcdef"[d % 4:])]


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_several_files(spark, tmp_path, parts):
    docs = spark.createDataFrame([(d, "a b a c" if d % 2 else "d e") for d in range(9)], "doc_id long, text string")
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    assert fits.Q["stream_fit"](spark, str(tmp_path)).agg(F.sum("nwsum")).first()[0] == 4 * 4 + 5 * 2


def test_a_window_drops_documents_before_listing_tokens(spark, tmp_path, monkeypatch):
    seen = []
    build = Workspace.cut
    monkeypatch.setattr(Workspace, "cut", lambda self, df, name, **k: (
        seen.append(df.select("doc_id").distinct().count()) if name == "held" else None, build(self, df, name, **k))[1])
    model = fold.WindowFit(spark, 2, window=4, path=str(tmp_path / "w"))
    model.on_batch(spark.createDataFrame(ROWS, "doc_id long, term string, n long"), 0)
    assert seen == [4] and model.state(spark).select("doc_id").distinct().count() == 4
