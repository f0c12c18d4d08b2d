"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language. An unseen word, padded with blanks, backs off:
its n-grams of the greatest length of which any is known score by their mean log frequency, else the next shorter
length, down to single letters. A text sums its words; the score is the softmax of that sum over the languages.

Word and n-gram tables come from a bounded sample of labelled rows, by a hash of the id and counted by Spark: each language
has an equal part of ``sample_docs``, at least ``least_docs``, and is thinned at its own rate to between once and twice
that part; a language with fewer rows is read whole. An item that a language lacks has the same frequency in all of
them, so that having few rows is no advantage. A word is known if some language has it ``least`` times in the sample, an
n-gram if it is in a word of the sample; nothing else bounds the tables. All else covers all rows and whole texts.

Defined results (very long texts and repeated rows are as any other): ``und`` with score 0 for a null text or one without a letter, and for every text if nothing could be
learned, as from an empty table; a text of letters that no table knows gets the language with most training rows, at a score
of one part for each language; ties go to that language too, then to the first by name. Null languages, and those whose
sampled texts have no word, are not learned from. Other columns are ignored. A null id is never held out nor learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import drop_scratch, map_texts, only, stored
from kinoframe.llm.tokens import MEMO_CHARS, MEMO_UNITS, Memo

LENGTHS = (5, 4, 3, 2, 1)
#: A text's language is told where its score is above this: likelier than all others together.
CONFIDENT = 0.5


def words_of(text: str) -> list[str]:
    """Runs of letters of a text in lower case."""
    low = text.lower()
    return [low] if low.isalpha() else "".join([c if c.isalpha() else " " for c in low]).split()


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)  # commonest first
    words: dict[str, list[float]] = field(default_factory=dict)
    grams: dict[str, list[float]] = field(default_factory=dict)

    def word(self, w: str) -> list[float]:
        """Log frequency of a word in each language, by backoff."""
        if (known := self.words.get(w)) is not None:
            return known
        look = self.grams.get
        for n in LENGTHS:
            if found := [x for g in grams_of(w, n) if (x := look(g)) is not None]:
                k = len(found)
                return found[0] if k == 1 else [sum(column) / k for column in zip(*found)]
        return [0.0] * len(self.langs)

    def predictor(self):
        """Texts -> (language, score)."""
        return Predictor(self).predict


class Predictor(Memo):
    """Remembers the rows of a table: a unit's sums over its words, and in the last column its number of words."""

    def __init__(self, model: Model, room: int = MEMO_UNITS):
        super().__init__(room)
        self.model, self.table = model, np.zeros((4096, len(model.langs) + 1))

    def learn(self, missing: set[str]) -> dict[str, int]:
        # what will be remembered comes first, so that the rows after it are free again for the next batch
        order = sorted(missing, key=lambda u: len(u) > MEMO_CHARS)
        base = len(self.memo)
        rows = []
        for u in order:
            words = words_of(u)
            sums = [self.model.word(w) for w in words]
            rows.append([*(sums[0] if len(sums) == 1 else map(sum, zip(*sums)) if sums else [0.0] * len(self.model.langs)), len(words)])
        while len(self.table) < base + len(rows):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if rows:
            self.table[base : base + len(rows)] = rows
        return {u: base + i for i, u in enumerate(order)}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, langs = [], self.model.langs
        for rows in self.values([t.split() if t else [] for t in texts]):
            total = self.table[rows].sum(axis=0) if rows else None
            if not langs or total is None or total[-1] == 0:
                out.append(("und", 0.0))
                continue
            x = total[:-1]
            best = int(np.argmax(x))  # the first of equals is the commonest language
            out.append((langs[best], float(1 / np.exp(np.clip(x - x[best], -60, 0)).sum())))
        return out


def held_out(part: int = 0, of: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == part, F.lit(False))


def counted(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "item", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) from word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in LENGTHS:
                    for g in grams_of(w, size):
                        counts[lang, g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])

    return words.mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame, langs: list[str], by: str, least: int) -> dict[str, list[float]]:
    """Log relative frequency in each language of the items that some language has ``least`` times.

    The table grows with the sample, which is bounded.
    """
    own = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    rows = counts.groupBy("item").agg(own.alias("by")).select("item", F.transform(F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at("by", x), F.lit(0).cast("long"))).alias("n"))
    # as Arrow columns, which hold a number in 8 bytes
    known = rows.where(F.array_max("n") >= least).toArrow()
    items = known.column("item").to_pylist()
    n = known.column("n").combine_chunks().flatten().to_numpy().reshape(-1, len(langs)).astype(np.float64)
    size = np.array([len(g) if by == "grams" else 0 for g in items], np.int64)
    out = np.zeros_like(n)
    for k in np.unique(size):
        part = n[size == k]
        totals = part.sum(axis=0)
        # half an item in the language with most of them; as a share it holds for all, also for one without any
        most = totals.max()
        out[size == k] = np.log((part / np.maximum(totals, 1) * most + 0.5) / (most + 0.5 * len(items)))
    return dict(zip(items, out.tolist()))


def train(docs: DataFrame, sample_docs: int = 12_000, least_docs: int = 500, least: int = 2) -> Model:
    """A model from a bounded sample of the labelled rows (doc_id, text, lang) that are not held out."""
    spark = docs.sparkSession
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    part = max(1, least_docs, sample_docs // len(sizes))
    every = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // part))])
    paths: list[str] = []
    words = stored(counted(known.where(F.pmod(F.xxhash64("doc_id"), every[F.col("lang")]) == 0)), "language-words", paths)
    langs = sorted((r["lang"] for r in words.select("lang").distinct().collect()), key=lambda k: (-sizes[k], k))
    model = Model() if not langs else Model(langs, frequencies(words, langs, "words", least), frequencies(gram_counts(words), langs, "grams", 1))
    drop_scratch(spark, *paths)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for rows of (doc_id, text)."""

    def make():
        predictor = model.predictor()

        def work(ids, texts):
            found = predictor(texts)
            return {"doc_id": ids, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return work

    return map_texts(docs, make, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(only(docs, "doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
