import random

import pytest

SCHEMA = "text string, doc_id long, lang string, key string, _id long, _hash long, w string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as".split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


def texts() -> dict:
    """Texts by id: prose, exact and near copies, blanks, a long and an unsplit one."""
    out = {i: prose(i, 30 + 7 * i) for i in range(20)}
    out |= {20 + i: out[3] for i in range(6)}                       # exact copies
    out |= {30 + i: out[15] + f" extra{i}" for i in range(5)}       # near copies
    out |= {40: "", 41: None, 42: " \n\t", 43: "one", 44: "One two", 45: "ÀÉ ß 日本 🙂 x\x1cy"}
    out |= {50: prose(99, 9000), 51: "ab" * 30000, 52: "<|endoftext|> tail <|endo", 53: "A\r\nb\x0bc"}
    return out


def rows_of(spark, found: dict, more: list = ()):
    """A table whose other columns clash with names the operators use themselves."""
    rows = [(t, i, "en", "k", 1, 2, "w", 3) for i, t in found.items()] + list(more)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """The texts, a row repeated whole, one id with two texts, and rows without an id."""
    found = texts()
    extra = [(found[5], 5, "de", "k", 1, 2, "w", 3), ("another text of five", 7, "de", "k", 0, 0, "", 0),
             ("no id here at all", None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return rows_of(spark, found, extra).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
