"""Exact deduplication as a stateful stream.

Rows enter a Structured Streaming query keyed by the digest of their normalised text. The state is on disk (RocksDB),
never expires, and keeps a digest, the stable identifier of the row that stays and its content locator (file and row).
Micro-batches hold ``BATCH_BYTES`` of digests, and each appends the states it changed; the last state of a digest gives
its group. What arrives at a digest that is known is a hit: its full bytes are compared with the bytes the locator names,
all hits in one pass after the stream, so that texts move once, and rows that only share the digest are grouped by their
whole text instead.

A locator names a row only in a plain Parquet scan (with filters and projections). Nothing but the caller knows that: rows
that an explode, join or union made can share file and row. So an input is written first and located there, unless
``plain_scan`` says that it is one.

Two texts are equal when identical after each run of [\\x20\\x09-\\x0D] is replaced by one blank; null counts as empty.
Of equal texts the row with the smallest id stays; among rows that share id and text, the first by file and row.
Counting is partial before the shuffle, and joins on the digest leave a hot group to be split by adaptive execution.

Defined results: null ids come after all others; repeated rows are rows of their own; very long texts are compared whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import drop_scratch, free_name, scratch, stored

#: Bytes of staged digests that a micro-batch reads at most.
BATCH_BYTES = 8 << 30
#: State on disk; a partition's store is closed when its batch is committed, so that only those at work hold local files.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scanned(docs: DataFrame, plain_scan: bool, name: str = "dedup-input") -> DataFrame:
    """``docs`` as a plain Parquet scan, whose rows Spark can name: what is a table just read stays as it is."""
    table = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if plain_scan or table else stored(docs, name)


def located(docs: DataFrame) -> DataFrame:
    """A plain scan with the content locator, file and row."""
    mine = [c for c in docs.columns if c.lower() not in ("_file", "_row")]
    file, row = place(docs)
    return docs.select(*[F.col(f"`{c}`") for c in mine], file.alias("_file"), row.alias("_row"))


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of a plain scan; the hidden column, whatever the names of the others."""
    hidden = docs.metadataColumn("_metadata")
    return hidden["file_path"], hidden["row_index"]


def keeper() -> Column:
    """Orders ids first to last, null ids last, then locators."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")


def state_of(spark: SparkSession, staged: str, schema, per_trigger: dict | None) -> DataFrame:
    """Runs the stream over staged digests to the end; (digest, keep, n), stored."""
    states, held = scratch(spark, "dedup-states"), scratch(spark, "dedup-stream")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        for k, v in (per_trigger or {"maxBytesPerTrigger": BATCH_BYTES}).items():
            reader = reader.option(k, v)
        grouped = reader.parquet(staged).groupBy("digest").agg(F.min(keeper()).alias("keep"), F.count(F.lit(1)).alias("n"))
        stream = (
            grouped.writeStream.outputMode("update")
            .option("checkpointLocation", held)
            .trigger(availableNow=True)
            # a batch that is repeated after a failure replaces its own files
            .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{states}/batch={batch}"))
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    found = spark.read.schema("digest string, keep struct<no_id: boolean, doc_id: long, _file: string, _row: long>, n long, batch int").parquet(states)
    # later states of a digest only have a smaller row to keep and a greater count
    last = stored(found.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n")), "dedup-state")
    drop_scratch(spark, states, held)
    return last


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    per_trigger: dict | None = None,
    plain_scan: bool = False,
) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and its locator _file, _row."""
    spark = docs.sparkSession
    texts = located(scanned(docs, plain_scan)).select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("text"), "_file", "_row")
    narrow = texts.select("doc_id", "_file", "_row", sha256(F.col("text")).alias("text_sha256"), digest(F.col("text")).cast("string").alias("digest"))
    staged = scratch(spark, "dedup-staged")
    narrow.write.parquet(staged)
    rows = spark.read.schema(narrow.schema).parquet(staged)
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "_file", "_row")
    state = state_of(spark, staged, narrow.schema, per_trigger)

    # full bytes on hits
    shared = state.where("n > 1").select("digest", "keep")
    checked: list[str] = []
    hits = stored(texts.withColumn("digest", digest(F.col("text")).cast("string")).join(shared, "digest"), "dedup-hits", checked)
    stay = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
    kept_bytes = hits.where(stay).select("digest", F.col("text").alias("kept_text"))
    other = stored(hits.where(~stay).join(kept_bytes, "digest").where("text <> kept_text").select("doc_id", "_file", "_row", "digest", "text"), "dedup-collided", checked)

    mine = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
    if other.isEmpty():
        drop_scratch(spark, *checked)
        return rows.join(state, "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), mine.alias("kept"), "text_sha256", "_file", "_row")
    again = other.join(other.groupBy("digest", "text").agg(F.min(keeper()).alias("keep"), F.count(F.lit(1)).alias("n")), ["digest", "text"]).select("_file", "_row", F.col("keep").alias("own"), F.col("n").alias("own_n"))
    less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    fixed = rows.join(state, "digest").join(less, "digest", "left").join(again, ["_file", "_row"], "left")
    keep = F.coalesce("own", "keep")
    fixed = fixed.select("doc_id", keep.alias("keep"), F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"), "text_sha256", "_file", "_row")
    return fixed.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", mine.alias("kept"), "text_sha256", "_file", "_row")


def deduplicate(docs: DataFrame, plain_scan: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = scanned(docs, plain_scan)
    return without_rows(docs, groups(docs, plain_scan=True, **options).where("not kept"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """A plain Parquet scan less the rows whose locators (_file, _row) are in ``gone``."""
    gone = gone.select("_file", "_row")
    file, row = free_name(docs, "_dedup_file"), free_name(docs, "_dedup_row")
    here = docs.select("*", *[c.alias(n) for c, n in zip(place(docs), (file, row))])
    return here.join(gone, (F.col(file) == gone["_file"]) & (F.col(row) == gone["_row"]), "left_anti").drop(file, row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's group of equal texts."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), plain_scan=True).drop("_file", "_row")
