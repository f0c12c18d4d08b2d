"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, and each is followed by the same stretch
of ordinary passages. A window of a text (``window`` bytes, every ``step`` bytes, over the whole text) is compressed
with both; the bytes that the toxic dictionary saves are its distance. Words that toxic and ordinary texts share would
drown that difference, so the training samples of the toxic side are toxic texts reduced to the words that mark them
(z at least ``mark_z`` between the classes) and those of the ordinary side are random words of ordinary texts. The
distances of a text (greatest, second, mean, share above 2, number of windows) are calibrated to a probability by
logistic regression on labelled texts that neither dictionary has seen (by folds).

Fitting uses a bounded sample of labelled rows: two thirds to one and a half times ``toxic_docs`` and ``ordinary_docs`` in expectation (every so-manieth, rounded), picked by a hash of
the id. Each class is thinned at its own rate, so the calibration weights a row by its class's sampling interval: a
probability, and with it the threshold, means the same whatever the sample. Scoring reads every whole text.

This departs from dictionaries of whole texts, which do not separate these documents: see the README for figures.

Defined results: a null, empty or blank text is one empty window; very long texts are windows from end to end; repeated rows
score alike, and an id that repeats is learned from once, by its first text; labels that are null or whose documents are
missing are not used; if a document has several labels the greatest counts; other columns are ignored; an empty table, or a
sample without both classes, gives a model by which every text scores 0. A null id is never held out nor learned from.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import map_texts, only

#: Least score of a text that is predicted toxic.
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


def features(d: np.ndarray) -> tuple[float, ...]:
    top = np.sort(d)[-2:]
    n = len(d)
    return (1.0, float(top[-1]), float(top[0]), float(d.mean()), float((d >= 2).sum()) / n, float((d >= 2).sum()) / math.sqrt(n), math.log(n))


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    window: int = 64
    step: int = 48
    level: int = 9
    describe: Callable[[np.ndarray], tuple] = features

    def scorer(self):
        """Texts -> probabilities; holds the two compressors."""
        if not self.weights:
            return lambda texts: [0.0] * len(texts)
        press = [compressor(x, self.level) for x in (self.toxic, self.ordinary)]
        weights = np.array(self.weights)

        def score(texts):
            x = np.array([self.describe(distances(t, *press, self.window, self.step)) for t in texts]).reshape(-1, len(weights))
            return (1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))).tolist()

        return score


def compressor(content: bytes, level: int):
    import zstandard

    words = zstandard.ZstdCompressionDict(content or bytes(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def distances(text: str | None, toxic, ordinary, window: int, step: int) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    body = normal(text)
    a, b = toxic.compress, ordinary.compress
    return np.array([len(b(w)) - len(a(w)) for i in range(0, max(1, len(body) - window + step), step) if (w := body[i : i + window]) is not None])


def stems(word: str) -> tuple[str, ...]:
    """A word and its beginnings, under which its inflected forms meet."""
    return (word, f"{word[:4]}-", f"{word[:5]}-")


def marks(toxic: list[str], ordinary: list[str], z: float) -> set[str]:
    """Words and beginnings of words that are in far more toxic texts than chance would put there."""
    t, o = Counter(), Counter()
    for into, texts in ((t, toxic), (o, ordinary)):
        for x in texts:
            into.update({s for w in set(WORD.findall(x.lower())) for s in stems(w)})
    share = len(toxic) / (len(toxic) + len(ordinary))
    spread = share * (1 - share)
    return {w for w, c in t.items() if c > 2 and c - (n := c + o[w]) * share >= z * math.sqrt(n * spread)}


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained zstandard dictionary; of too few samples, the samples."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[:size]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients; a row counts ``weight`` times."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def dictionaries(rows: list[tuple[int, str, int]], size: int, base_bytes: int, mark_z: float) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    pick = random.Random(7)
    toxic, ordinary = ([r[1] or "" for r in rows if r[2] == k] for k in (1, 0))
    found = marks(toxic, ordinary, mark_z)
    hot = [" ".join(w for w in WORD.findall(t.lower()) if not found.isdisjoint(stems(w))).encode() for t in toxic]
    cold = [" ".join(pick.sample(words, min(8, len(words)))).encode() for t in ordinary if (words := WORD.findall(t.lower()))]
    base = b" ".join(normal(t) for t in ordinary[: base_bytes // 500])[:base_bytes]
    return dictionary(hot, size) + base, dictionary(cold, size) + base


def fit_fold(rows: list[tuple[str, int, bool]], model: Model, size: int, base_bytes: int, mark_z: float) -> tuple[list, list, tuple[bytes, bytes]]:
    """Features and labels of the rows (text, label, own) that are the fold's own, by dictionaries of the others."""
    rows = sorted(rows)
    random.Random(7).shuffle(rows)
    rest = [(0, t, y) for t, y, own in rows if not own]
    if {r[2] for r in rest} != {0, 1}:
        return [], [], (b"", b"")
    content = dictionaries(rest, size, base_bytes, mark_z)
    press = [compressor(c, model.level) for c in content]
    own = [(t, y) for t, y, o in rows if o]
    return [model.describe(distances(t, *press, model.window, model.step)) for t, _ in own], [y for _, y in own], content


def fit(sample: DataFrame, size: int = 1536, base_bytes: int = 250_000, mark_z: float = 6.0, folds: int = 4, every: dict[int, int] | None = None, **shape) -> Model:
    """The model from (doc_id, text, toxic) rows. Each fold is scored by dictionaries of the others, for the calibration.

    The folds, and the dictionaries of all rows, are trained each in a task of its own; what comes to the driver are the
    features of the sample and the two dictionaries. ``every`` has the sampling interval of each label.
    """
    every, model = every or {1: 1, 0: 1}, Model(**shape)
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(folds)).cast("int")
    parts = sample.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", fold.alias("fold")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds))))

    def run(pdf):
        k = int(pdf["part"].iloc[0])
        x, y, content = fit_fold([(t, int(label), int(f) == k) for t, label, f in zip(pdf["text"], pdf["toxic"], pdf["fold"])], model, size, base_bytes, mark_z)
        last = k == folds
        return pd.DataFrame({"x": [[list(map(float, r)) for r in x]], "y": [y], "toxic": [content[0] if last else b""], "ordinary": [content[1] if last else b""]})

    # by range: a task a part, where hashes of so few numbers would meet
    found = parts.repartitionByRange(folds + 1, "part").groupBy("part").applyInPandas(run, "x array<array<double>>, y array<int>, toxic binary, ordinary binary").collect()
    x, y = [r for f in found for r in f.x], [v for f in found for v in f.y]
    if x:
        model.toxic, model.ordinary = (max((bytes(f[c]) for f in found), key=len) for c in ("toxic", "ordinary"))
        model.weights = logistic(np.array(x), np.array(y, float), np.array([every[k] for k in y], float)).tolist()
    return model


def held_out(part: int = 2, of: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 2000, ordinary_docs: int = 4000, **shape) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = {k: max(1, round(sizes.get(k, 0) / most)) for k, most in ((1, toxic_docs), (0, ordinary_docs))}
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") == 1, every[1]).otherwise(every[0])) == 0)
    # at most about toxic_docs + ordinary_docs ids, whatever the input; an id that repeats counts once, with its first text
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return fit(rows, every=every, **shape)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for rows of (doc_id, text)."""

    def make():
        scorer = model.scorer()

        def work(ids, texts):
            p = scorer(texts)
            return {"doc_id": ids, "score": p, "predicted": [int(x >= threshold) for x in p]}

        return work

    return map_texts(docs, make, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's toxicity."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
