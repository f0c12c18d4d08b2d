"""Sharding by a two-pass external shuffle, on DataFrame operations only.

Pass 1 scatters records uniformly into buckets by a seeded hash of the id; the number of buckets follows from the bytes
of the input, so that a bucket fits in memory. Pass 2 loads each bucket as one array, puts it in a fixed order, applies a
seeded Fisher-Yates shuffle (Spark's ``shuffle``), lays the buckets end to end and writes them from where they are. Shards
are equal slices of that sequence: their row counts differ by one at most (the law ``rows``).

Order. ``shuffle`` draws from one generator a partition, so buckets are dealt to a number of partitions that follows from
the data alone: seed and rows decide the order, whatever the session's partitions, files and executors.

Hot keys. Only the id decides the bucket, so a source, a text or a group of copies that holds a third of the rows is spread
evenly. Where the counts show a bucket far above its share (an id, or a text without id, that repeats very often), rows are
dealt by id, text and a number that tells identical rows apart; those are counted, not moved, to be numbered.

Defined results: null texts and null ids are dealt like any row; repeated rows are all kept; very long texts are moved whole,
a bucket holds at least one; an empty table gives an empty result; columns called like the added ones are replaced by them.
Map columns cannot be put in order by Spark and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import free_name, scratch, starts_of, stored

#: Bytes of text in a bucket.
BUCKET_BYTES = 16 << 20
#: Buckets whose starts are broadcast (16 bytes each); beyond that they are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20
#: Copies of a row that one task makes.
RUN = 100_000


def partition_count(buckets: int) -> int:
    """Partitions for so many buckets: one each up to 2000, then up to 64 buckets a partition."""
    return buckets if buckets <= 2000 else max(2000, buckets // 64)


def numbered(docs: DataFrame, columns: list[str], copy: str) -> DataFrame:
    """``docs`` with ``copy``, a number that tells identical rows apart."""
    n, run = free_name(docs, "n"), free_name(docs, "run")
    same = docs.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(n))
    runs = same.select("*", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {RUN})")).alias(run)).repartition(F.col(run), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    return runs.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.expr(f"sequence({run} * {RUN}, least({n}, ({run} + 1) * {RUN}) - 1)")).alias(copy))


def shuffle_shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    row_bytes: int = 64,
) -> DataFrame:
    """All rows and columns with ``shard`` and ``slot`` (gapless from 0 in each shard), in shuffled order."""
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    b, rec, at, copy, first_key = (free_name(docs, x) for x in ("bucket", "record", "at", "copy", "_key"))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + row_bytes
    whole = docs.agg(F.sum(size.cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n, buckets = whole["n"], max(1, -(-(whole["bytes"] or 0) // bucket_bytes))

    # where each bucket starts: a row a bucket, from the ids alone
    def dealt_by(*key):
        return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *key), F.lit(buckets).cast("long"))

    def counts(rows, bucket):
        return stored(rows.groupBy(bucket.alias(b)).agg(F.count(F.lit(1)).alias("rows_in")), "shard-buckets")

    key = F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))
    sizes = counts(docs, dealt_by(*key))
    if (sizes.agg(F.max("rows_in")).first()[0] or 0) > 4 * n / buckets + 100:
        docs, key = numbered(docs, columns, copy), (F.col(id_col), F.col(text_col), F.col(copy))
        sizes = counts(docs, dealt_by(*key))
    starts = starts_of(sizes, b, "rows_in").drop("rows_in")

    row = F.struct(F.col(id_col).alias(first_key), *[F.col(f"`{c}`") for c in columns if c != id_col])
    dealt = (
        docs.select(dealt_by(*key).alias(b), row.alias(rec))
        .repartition(partition_count(buckets), b)
        .groupBy(b)
        .agg(F.collect_list(rec).alias(rec))
        # array after array of a partition from its generator: in bucket order
        .sortWithinPartitions(b)
        .select(b, F.expr(f"shuffle(sort_array({rec}), {int(seed)})").alias(rec))
    )
    placed = dealt.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, b).select("start", F.posexplode(rec).alias(at, rec))
    # shard s holds the places p with p * k div n = s, so it begins at ceil(s * n / k)
    shard = F.expr(f"(start + {at}) * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    out = placed.select(*[F.col(f"{rec}.{first_key}" if c == id_col else f"{rec}.`{c}`").alias(c) for c in columns], (F.col("start") + F.col(at)).alias("slot"), shard.cast("int").alias("shard"))
    return out.select(*[F.col(f"`{c}`") for c in columns], "shard", (F.col("slot") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffled rows as Parquet, a folder for each shard. Each task writes its own buckets, in slot order: a file holds
    stretches of consecutive slots, and ``slot`` gives the order over all files of a shard."""
    shuffle_shards(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What ``write_shards`` wrote; ``columns``: the schema of the documents' columns. A filter on ``shard`` reads that alone."""
    return spark.read.schema(f"{columns}, slot long, shard int").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents written as shards and read back; every document's shard and place, digests of the texts read."""
    path = scratch(spark, "shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_shards(spark, path, "doc_id long, text string").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
