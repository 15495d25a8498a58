import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latent.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("leaf", [40, 32_768])
def test_equals_the_library(odd, none, library, leaf):
    got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in bpe.encode(odd, PATH, leaf).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, *expected(library, r.text)) for r in odd.collect())
    assert got == want
    assert bpe.encode(none, PATH, leaf).count() == 0


def test_ids_are_kept(odd, library):
    one = odd.where("doc_id = 51")
    got = bpe.encode(one, PATH, 1000, keep_ids=True).first()
    assert list(got.ids) == library.encode("ab" * 30000).ids


def test_joins_are_exact(library):
    codec, r = bpe.Codec(PATH), random.Random(5)
    alphabet = ["a", "th", " ", "  ", "\n", "'", "s", "'re", "1", "é", "ß", "日本", "🙂", "!", "<|endoftext|>",
                "<|endo", "\x1c", "\x85"]
    for k in range(600):
        text = "".join(r.choices(alphabet if k % 3 else "abtheringostupld", k=r.randint(1, 600)))
        for leaf in (7, 120):
            parts = [(s.encode(), codec.encode(s)) for s in bpe.halves(text, leaf)]
            assert list(codec.concatenate(parts)) == library.encode(text, add_special_tokens=False).ids
