"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability sigmoid(bias + sum of
the weights of its telling words and word beginnings), a document with the noisy-or of its sentences,
1 − Π(1 − p_s). Only document labels are known: bias and weights maximise their likelihood,
in which a leak ε stands for labels that no sentence explains,
P(label) = ε + (1 − ε)·noisy-or. The score leaves the leak out, so it does not grow with the
mere length of a text. Sentences with a high probability are the offending ones.

The model is fitted on a bounded sample of labelled rows (``Settings.sample``), all texts are
scored in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latent.llm.common import fold_of, ids_and_texts, map_batches

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
CACHED = 200_000


@dataclass(frozen=True)
class Settings:
    sample: int = 8000           # labelled rows that are fitted at most
    sample_chars: int = 60_000   # longer texts are scored, but not fitted
    evidence: float = 30.0       # likelihood ratio (G²) from which a word gets a weight
    steps: int = 400
    rate: float = 0.1
    l2: float = 0.03             # of the squared weights, per fitted set
    bias: float = -12.0          # of a sentence without such words: mean of its prior
    threshold: float = 0.7


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every stretch between full stops, marks and line ends."""
    return [(m.start(), m.end(), TOKEN.findall(m[0].lower())) for m in SENTENCE.finditer(text)]


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected and compound forms share."""
    return [word, *(word[:k] + "-" for k in range(3, min(8, len(word))))]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    leak: float
    words: dict[str, float] = field(default_factory=dict)  # of words met so far, at most CACHED

    def weight(self, word: str) -> float:
        if (known := self.words.get(word)) is None:
            if len(self.words) >= CACHED:
                self.words.clear()
            known = self.words[word] = sum(
                self.weights.get(f, 0.0) for f in features(word)) if self.weights else 0.0
        return known

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence; words count once a sentence."""
        out = []
        for start, end, words in sentences(text):
            logit = self.bias + sum(map(self.weight, set(words)))
            out.append((start, end, 1 / (1 + math.exp(-logit))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        scored = self.sentence_scores(text)
        p = np.array([s[2] for s in scored])
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), scored


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, learn=None) -> DataFrame:
    """(text, toxic) of at most ``settings.sample`` labelled rows, chosen by a hash of their id.

    An id with several labels is toxic if one of them is; rows without id or label don't count.
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    if learn is not None:
        known = known.where(learn)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    rows = docs.where(F.length("text") <= settings.sample_chars)
    # The sample's bound is the bound of what is broadcast.
    return (ids_and_texts(rows).join(F.broadcast(chosen), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
            .orderBy("doc_id").limit(settings.sample))


def telling_features(bags: list[list[list[str]]], toxic: list[int],
                     evidence: float) -> list[str]:
    """Features that tell a toxic document from others, by the likelihood ratio of the
    documents and that of the distinct sentences that hold them. Copies of a sentence count
    once, so a document that was copied often lends its words no weight; neither does a long
    one."""
    def held(bag, only=None):
        every = {f for s in bag for w in s for f in features(w)}
        return every if only is None else every & only

    docs: list[Counter] = [Counter(), Counter()]
    seen: list[dict[tuple, None]] = [{}, {}]
    for bag, y in zip(bags, toxic, strict=True):
        seen[y].update(dict.fromkeys(map(tuple, bag)))
        if y:
            docs[1].update(held(bag))
    some = {f for f, n in docs[1].items() if n >= 5}
    for bag, y in zip(bags, toxic, strict=True):
        if not y:
            docs[0].update(held(bag, some))
    parts = [Counter(f for s in side for f in held([s], some)) for side in seen]
    return sorted(f for f in some if min(
        _ratio(docs[1][f], docs[0][f], toxic.count(0), toxic.count(1)),
        _ratio(parts[1][f], parts[0][f], len(seen[0]), len(seen[1]))) >= evidence)


def _ratio(yes: int, no: int, without: int, within: int) -> float:
    """G² of a word's counts against the sizes of both sides; 0 where it is the rarer one."""
    part, share = yes / (yes + no), within / (within + without)
    if part <= share:
        return 0.0
    return sum(2 * n * math.log(p / q) for n, p, q in
               ((yes, part, share), (no, 1 - part, 1 - share)) if n)


def fit(texts: Iterable, toxic: list[int], settings: Settings = Settings()) -> Model:
    """Maximum likelihood of the document labels by gradient ascent with momentum (Adam)."""
    pool: dict = {}  # one object for each word and for each sentence, however often it occurs

    def shared(words: list[str]) -> tuple[str, ...]:
        bag = tuple(sorted({pool.setdefault(x, x) for x in words}))
        return pool.setdefault(bag, bag)

    bags = [[shared(w) for _, _, w in sentences(str(t)) if w] or [()] for t in texts]
    del pool
    kept = telling_features(bags, toxic, settings.evidence)
    if not kept:
        return Model(settings.bias, {}, (sum(toxic) + 0.5) / (len(toxic) + 1))
    index = {w: i for i, w in enumerate(kept)}
    flat = [[index[f] for w in s for f in features(w) if f in index] for bag in bags for s in bag]
    of_sentence = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    word = np.fromiter((i for s in flat for i in s), np.int64)
    first = np.cumsum([0, *(len(b) for b in bags)])[:-1]
    of_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    y = np.array(toxic, float)

    theta = np.zeros(len(kept) + 2)
    theta[-2:] = settings.bias, np.log(0.05 / 0.95)  # bias of a sentence, leak
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        w, bias, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
        logit = bias + np.bincount(of_sentence, w[word], len(flat))
        p = 1 / (1 + np.exp(-logit))
        miss = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), first))
        yes = np.clip(1 - (1 - leak) * miss, 1e-9, 1 - 1e-9)
        d_yes = y / yes - (1 - y) / (1 - yes)
        d_logit = (d_yes * (1 - leak) * miss)[of_doc] * p
        gradient = np.concatenate([
            np.bincount(word, d_logit[of_sentence], len(kept)) - settings.l2 * w,
            [d_logit.sum() - (bias - settings.bias)], [(d_yes * miss).sum() * leak * (1 - leak)]])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        theta = theta + settings.rate * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(theta[-2]), {w: float(theta[i]) for w, i in index.items()},
                 float(1 / (1 + np.exp(-theta[-1]))))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
          learn=None) -> Model:
    rows = training_rows(docs, labels, settings, learn).toArrow()
    return fit(rows.column("text"), rows.column("toxic").to_pylist(), settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, score, predicted, n_sentences, and (start, end, score) of each
    offending sentence, whose code points lie at [start, end) of the text.

    A null or empty text has no sentence and scores 0; a null id stays; repeated rows repeat.
    """
    def start():
        def step(batch):
            out = {k: [] for k in ("score", "predicted", "n_sentences", "offending")}
            for text in batch.column(1).to_pylist():
                p, scored = model.score(text)
                out["score"].append(p)
                out["predicted"].append(int(p >= settings.threshold))
                out["n_sentences"].append(len(scored))
                out["offending"].append([{"start": a, "end": b, "score": float(s)}
                                         for a, b, s in scored if s >= 0.5])
            return out | {"doc_id": batch.column(0)}
        return step

    return map_batches(ids_and_texts(docs), start,
                       "doc_id long, score double, predicted int, n_sentences int, "
                       "offending array<struct<start:int,end:int,score:double>>")


def accepted(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold."""
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "")[0] < settings.threshold
                                         for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, StructType(docs.schema.fields))


def held_out():
    return fold_of("doc_id", 3) == 1
