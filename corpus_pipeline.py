"""A corpus pipeline of five stages; each reads what its predecessor wrote as Parquet.

Language ID, toxicity, exact deduplication and near-duplicate removal return the columns of ``documents``; packing
returns pieces with their places. Belongs to ``kinoframe.llm``.

Every stage decides row by row: rows that share an id are judged each by its own text, and so are rows with a null id.

Defined results, the same in every stage unless it says otherwise: null ids are kept as rows of their own; a null, empty or
blank text goes in the first stage, and in a later one it is a text like any other, without words; very long texts are read
whole; repeated rows are judged alike, and of them the deduplication stages keep one; of ties the smallest id stays, then the
first row by file and place; an empty table passes as an empty table; other columns are carried, whatever their names, and
packing leaves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm import exact_dedup, language, packing, simhash, toxicity
from kinoframe.llm.base import drop_scratch, free_name, only, only_result, stored, with_found

#: The stages train models and follow links, which SQL cannot say; tests compare run() with a brute-force version.
ORACLE_SQL = None


def kept_rows(docs: DataFrame, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of ``docs`` whose text the function that ``make`` gives finds true."""
    name = free_name(docs, "_keep")
    return with_found(docs, make, name, "boolean").where(F.col(name)).drop(name)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with confidence; where their ``lang`` is null, it becomes the prediction.

    Rejected: a null text, one without a letter, and one for which no language is likelier than all others together.
    """
    model = language.train(docs.select("doc_id", "text", "lang"))

    def make():
        predict = model.predictor()
        return lambda texts: [lang if lang != "und" and score > language.CONFIDENT else None for lang, score in predict(texts)]

    name = free_name(docs, "_lang")
    told = with_found(docs, make, name, "string").where(F.col(name).isNotNull())
    return told.withColumn("lang", F.coalesce("lang", name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    texts = only(docs, "doc_id", "text")
    model = toxicity.train(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def make():
        score = model.scorer()
        return lambda texts: [x < toxicity.THRESHOLD for x in score(texts)]

    return kept_rows(docs, make)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id, null ids last."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id, null ids last."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(only(docs, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what only a stage needs is removed when its output is written."""
    docs, paths = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with only_result(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep)
        drop_scratch(spark, *paths)
        paths = keep
    return STAGES[-1][1](spark, docs, sf_dir)
