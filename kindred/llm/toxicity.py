"""Toxicity by compression distance: separate zstandard dictionaries of toxic and ordinary text, compared window by window.

A window is a word with its separators. It is compressed with either dictionary, between two fixed marks that both
dictionaries hold (zstandard finds no match in the last bytes of its input and writes no block that saves nothing; the
marks take these fixed costs, so that a match of some letters shows). The saving is the ordinary length minus the toxic
one. A document's features are how many windows reach each of several savings, absolute and by length; a logistic
regression on the same labelled documents calibrates them, and 0.5 is the threshold of its probability.

Learning takes a bounded sample, by a hash of the ids: at most `toxic_docs` and `ordinary_docs` labelled documents of at
most `max_chars` characters (defaults 1,500, 5,000 and 12,000). The toxic dictionary holds the words whose letter runs
stand in at least 3 toxic documents, however many there are, and are `contrast` times rarer in ordinary ones: first one word
for each such run, so that rare families of words get a place, then the most frequent. (With 1,500 toxic and 5,000 ordinary
documents the contrast asks for 8 toxic ones where no ordinary one has the run.) The ordinary dictionary holds the most
frequent words of ordinary documents; in both the most frequent stand last, where a reference is cheapest.
Scoring reads whole texts. Only the text enters a score.

Defined cases: null and empty texts have no windows and get the score of that; without labels of both kinds every score is
the share of toxic labels (0 if there are none); null labels are not used, contradictory ones count as toxic; repeated
rows are scored each; an empty table gives an empty result; other columns have no effect.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import fold, trimmed

HEAD, TAIL = bytes(range(200, 232)), bytes(range(160, 192))
LEVEL = 19
DICTIONARY = 6144
RUNS = (5, 6, 7, 8)
SAVINGS = range(1, 9)
#: Words whose saving a worker keeps; beyond it the cache starts anew, which costs time only.
CACHE = 600_000


def split(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _runs(words: set[bytes], sizes: tuple[int, ...] = RUNS) -> set[bytes]:
    out = set()
    for w in words:
        x = b" " + w + b" "
        for n in sizes:
            out.update(x[i : i + n] for i in range(len(x) - n + 1))
    return out


def _content(words: Counter, size: int, runs: set[bytes] = frozenset()) -> bytes:
    """The most frequent words that have room; those that bring one of runs for the first time go before all others."""
    often = [w for w, _ in words.most_common()]
    new, covered = set(), set()
    for w in often:
        mine = _runs({w}) & runs
        if not mine <= covered:
            new.add(w)
            covered |= mine
    chosen, n = set(), 0
    for w in (*(w for w in often if w in new), *(w for w in often if w not in new)):
        if n + len(w) + 1 > size:
            break
        chosen.add(w)
        n += len(w) + 1
    out = [w for w in often if w in chosen]
    return b" " + b" ".join(reversed(out)) + b" "


def dictionaries(toxic: list[str], ordinary: list[str], size: int = DICTIONARY, contrast: float = 50.0, least: int = 3) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary. Copies among the texts count once. Runs are counted length by length, so that those of one length are in memory at once."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    telling: set[bytes] = set()
    for n in RUNS:
        found: Counter = Counter()
        for t in toxic:
            found.update(_runs(set(split(t)), (n,)))
        found = Counter({g: k for g, k in found.items() if k >= least})
        other: Counter = Counter()
        for t in ordinary:
            other.update(g for g in _runs(set(split(t)), (n,)) if g in found)
        telling |= {g for g, k in found.items() if k / len(toxic) > contrast * (other[g] + 0.5) / len(ordinary)}
    words: Counter = Counter()
    for t in toxic:
        words.update(split(t))
    words = Counter({w: k for w, k in sorted(words.items()) if any((b" " + w + b" ")[i : i + n] in telling for n in RUNS for i in range(len(w) + 3 - n))})
    common: Counter = Counter()
    for t in ordinary:
        common.update(split(t))
    return _content(words, size, telling), _content(Counter(dict(sorted(common.items()))), size)


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()
    share: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        def compressor(content: bytes):
            held = TAIL + content + HEAD
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(held), source_size=96, write_content_size=False, write_dict_id=False)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)

        self.model, self.known = model, {}
        if model.toxic or model.ordinary:
            self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic)

    def saving(self, word: bytes) -> int:
        x = HEAD + b" " + word + b" " + TAIL
        return len(self.ordinary.compress(x)) - len(self.toxic.compress(x))

    def features(self, text: str | None) -> list[float]:
        words = Counter(split(text))
        if len(self.known) + len(words) > CACHE:
            self.known = {}
        known, hits = self.known, [0] * (max(SAVINGS) + 1)
        for w, k in words.items():
            s = known.get(w)
            if s is None:
                s = known[w] = self.saving(w)
            if s > 0:
                hits[min(s, len(hits) - 1)] += k
        n = words.total()
        at_least = np.cumsum(hits[::-1])[::-1][1:]
        return [*np.log1p(at_least), *np.minimum(1.0, 20.0 * at_least / (n + 30.0)), float(np.log(max(n, 100)))]

    def scores(self, texts) -> np.ndarray:
        if not self.model.weights:
            return np.full(len(texts), self.model.share)
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), -1)
        w = np.array(self.model.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(w[0] + x @ w[1:], -700, 700)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method on standardised features; weights for the features as they are, the constant first."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread]


def fit(toxic: list[str], ordinary: list[str], **options) -> Model:
    total = len(toxic) + len(ordinary)
    if not toxic or not ordinary:
        return Model(share=len(toxic) / total if total else 0.0)
    bad, plain = dictionaries(toxic, ordinary, **options)
    scorer = Scorer(Model(bad, plain))
    x = np.array([scorer.features(t) for t in (*toxic, *ordinary)])
    return Model(bad, plain, tuple(_logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]).tolist()), len(toxic) / total)


def learned(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, ordinary_docs: int = 5000, max_chars: int = 12_000, folds: int = 5) -> Model:
    """The model from labelled documents whose fold is not 0. Only the sampled ids (bounded by the parameters) are broadcast, and only their texts come to the driver."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id"), folds) != 0)
    first = lambda kind, n: known.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first("toxic > 0", toxic_docs).unionByName(first("toxic <= 0", ordinary_docs))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic, ordinary = ([r["text"] for r in rows if (r["toxic"] > 0) == kind] for kind in (True, False))
    del rows
    model = fit(toxic, ordinary)
    del toxic, ordinary
    trimmed()  # what follows in this session needs the driver's memory
    return model


def scored(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch[["doc_id", "held_out"]].assign(score=scorer.scores(batch["text"]))

    out = docs.select(F.col("doc_id").cast("string"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("text"))
    return out.mapInPandas(score, "doc_id string, held_out boolean, score double").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs whose score is below 0.5, with their columns."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, **options))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(clean, docs.schema)


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest that op10 returns."""
    return scored(docs, learned(docs, labels))
