"""Shared-folder tables, Arrow helpers and held-out splits used by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch; keeps a worker's memory flat when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_linelark_scratch"):
        spark._linelark_scratch = tempfile.mkdtemp(prefix="linelark-")
    return f"file://{spark._linelark_scratch}"


_made: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages restart from files, not from ``df``'s plan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has written and says how many: call it when no result that reads them is needed any more."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, start: Callable[[], Callable[[list], list | None]], schema: str) -> DataFrame:
    """``mapInArrow`` over rows: ``start()`` runs once a task; what it returns gets each row's values and gives a row or None."""
    small_batches(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = start()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [r for values in zip(*columns) if (r := handle(*values)) is not None]
            for made in to_batches(rows, target):
                yield made

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, start: Callable[[], Callable[..., bool]], inputs: list[str]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose ``inputs`` pass the test that ``start()`` makes once a task. Nothing is shuffled."""
    small_batches(df.sparkSession)
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            yield batch.filter(pa.array([passes(*v) for v in zip(*(batch.column(i).to_pylist() for i in at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_batches(rows: list, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


arrow_schema = _arrow_schema


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int) -> list:
    """At most ``per_class`` labelled training documents of each class, by smallest hash of the id: [(text, 0 or 1)], in a fixed order.

    Texts above ``max_chars`` are passed over for the next ones; a class of longer texts only gives its shortest one. Rows
    that share an id count as one document (its smallest text). Ids are drawn from the narrow label table, as many as it
    takes, and only the chosen texts reach the driver: ``2 * per_class * max_chars`` characters at most, but for that one.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).select("doc_id", F.col(label).alias("y")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    chosen, drawn = {}, 2 * per_class
    while True:
        parts = [own.where(F.col("y") == y).orderBy(*order).limit(drawn).collect() for y in (0, 1)]
        schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType)])
        ids = documents.sparkSession.createDataFrame([(i,) for i in sorted({r["doc_id"] for part in parts for r in part})], schema)
        # narrow rows: an id and a length for each of at most 2 * drawn ids
        size = {r["doc_id"]: r["n"] for r in texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.length(F.min("text")).alias("n")).collect()}
        enough = True
        for y, part in enumerate(parts):
            there = [r["doc_id"] for r in part if r["doc_id"] in size]
            chosen[y] = [i for i in there if size[i] <= max_chars][:per_class] or sorted(there, key=lambda i: (size[i], i))[:1]
            enough = enough and (len(chosen[y]) == per_class or len(part) < drawn)
        if enough or drawn > 64 * per_class:
            break
        drawn *= 4
    picked = documents.sparkSession.createDataFrame([(i,) for i in sorted({*chosen[0], *chosen[1]})], schema)
    text = {r["doc_id"]: r["text"] for r in texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(text[i], y) for i, y in sorted((i, y) for y in (0, 1) for i in chosen[y])]
