import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from latent.llm import toxicity
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import parts
from tests.llm.test_simhash import plain_groups
from tests.llm.test_toxicity import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_equals_a_plain_version(spark, tmp_path):
    texts, labels = corpus(300)
    items = {i: prose(700 + i, 25) for i in range(5)}
    texts |= {1000 + i: prose(3000 + i, 80) for i in range(30)}
    texts |= {2000 + i: texts[1000 + i % 3] + " more" * (i % 2) for i in range(12)}
    texts |= {3000 + i: prose(i, 50) + " " + items[i] + " " + prose(i, 60) for i in range(5)}
    texts |= {4000: "", 4001: None}
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA).write.parquet(
        f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn=~toxicity.held_out())
    left = {i: t for i, t in texts.items() if model.score(t or "")[0] < 0.7}
    assert all(i in left for i in texts if i >= 1000) and len(left) < len(texts) - 50
    named = plain_groups(left)
    left = {i: t for i, t in left.items() if named[i] == i}
    assert 4000 in left and not {4001, 2000, 2011} & set(left)
    left = {i: t for i, t in left.items()
            if not any(len(parts(b) & parts(t)) >= 0.8 * len(parts(b)) for b in items.values())}
    assert not any(3000 <= i < 3005 for i in left) and sum(1000 <= i < 1030 for i in left) == 30
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in left.items()}
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(
        (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items())


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
        assert stage(spark, docs.limit(0), sf).count() == 0
