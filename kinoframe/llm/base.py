"""What the operators of this subpackage share: scratch space, column names, process caches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset the warehouse serves, if it is no machine's own disk or the session is a single machine.
    """
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and re.match(r"(file:)?/", warehouse):
        raise ValueError(f"executors do not share {warehouse}: set spark.checkpoint.dir to a folder that they share")
    return f"{warehouse}/_shared"


def folder(spark: SparkSession, path: str):
    """A Hadoop file system and a path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Scratch paths of this process that are not removed yet, oldest first.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the session ends, or before by ``drop_scratch``."""
    home = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, where = folder(spark, home)
    files.mkdirs(where)
    files.deleteOnExit(where)
    _scratch.append(path := f"{home}/data")
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove scratch that no later plan reads."""
    for path in paths:
        files, where = folder(spark, path.removesuffix("/data"))
        files.delete(where, True)
        if path in _scratch:
            _scratch.remove(path)


@contextmanager
def only_result(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch made inside is removed at the end, but for the paths put into the list that this gives."""
    before, keep = set(_scratch), []
    yield keep
    drop_scratch(spark, *[p for p in _scratch if p not in before and p not in keep])


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage ends in files that survive the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str, keep: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Written as Parquet to the shared folder and read again; its path goes into ``keep``."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, under the names doc_id and text, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """Rows of (doc_id, text) through a Python function by Arrow batches.

    ``make`` runs once a task and gives a function (ids, texts) -> columns. Batches are cut so that one call
    sees about 4 MB of text at most (or a single text), which bounds a worker's memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                out = work(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, parsed)


def with_found(docs: DataFrame, make: Callable[[], Callable[[list], list]], name: str, kind: str) -> DataFrame:
    """The rows of ``docs``, each with what a Python function finds in its text, as a last column ``name``.

    ``make`` runs once a task and gives a function texts -> values. Nothing is joined, so rows need no key.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    at, value = docs.columns.index("text"), _parse_datatype_string(kind)
    schema = StructType([*docs.schema.fields, StructField(name, value)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, arrow = make(), to_arrow_type(value)
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(work(rows.column(at).to_pylist()), arrow)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def starts_of(parts: DataFrame, key: str, amount: str, fan: int = 4096) -> DataFrame:
    """``parts`` (one row a whole-number key from 0) with ``start``: the sum of ``amount`` over all smaller keys.

    Two levels, so that no task orders more than ``fan`` keys or the number of keys over ``fan``.
    """
    from pyspark.sql import Window

    before = (Window.unboundedPreceding, -1)
    group = F.expr(f"{key} div {fan}")
    tops = parts.groupBy(group.alias("_fan")).agg(F.sum(amount).alias("_sum"))
    tops = tops.select("_fan", F.coalesce(F.sum("_sum").over(Window.orderBy("_fan").rowsBetween(*before)), F.lit(0)).alias("_top"))
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy("_fan").orderBy(key).rowsBetween(*before)), F.lit(0))
    return parts.withColumn("_fan", group).withColumn("_in", inner).join(tops, "_fan").select(*parts.columns, (F.col("_top") + F.col("_in")).alias("start"))
