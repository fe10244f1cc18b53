"""Records of a corpus: one row a line that has searchable text.

sentence_id (contiguous in source and line order), completed_sentence (the stripped line), normalized_sentence,
source_text, source_offset (the line's number from 0, blank lines counted).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, strip
from .store import hidden_names, path_kind, qualified, read_bytes, stored

SCHEMA = T.StructType([T.StructField("sentence_id", T.LongType(), False), *[T.StructField(n, T.StringType(), False) for n in ("completed_sentence", "normalized_sentence", "source_text")], T.StructField("source_offset", T.IntegerType(), False)])


#: Rows of a table of splits up to which it is broadcast.
BROADCAST_SPLITS = 500_000
#: Bytes of input in a part that one task sorts, about.
PART_BYTES = 32 << 20
#: Bytes of files with hidden names, which the driver reads itself, at most.
HIDDEN_BYTES = 256 << 20


class TextFiles(NamedTuple):
    """Where the ``*.txt`` files below a root are: folders to be listed by Spark, and hidden files with their size and time, which it leaves out."""

    root: str
    folders: list[str]
    hidden: list[tuple[str, int, float]]


def text_files(spark: SparkSession, root: str) -> TextFiles:
    """Every ``*.txt`` file below ``root``, in folders and under names that begin with '.' or '_' too.

    FileNotFoundError or NotADirectoryError if ``root`` is missing or a file; ValueError if hidden files have over HIDDEN_BYTES.
    """
    kind = path_kind(spark, root)
    if kind == "missing":
        raise FileNotFoundError(root)
    if kind == "file":
        raise NotADirectoryError(root)
    folders, hidden = [root], []
    for path, is_folder, size, changed in hidden_names(spark, root):
        if is_folder:
            folders.append(path)
        elif path.endswith(".txt"):
            hidden.append((path, size, changed))
    if sum(size for _, size, _ in hidden) > HIDDEN_BYTES:
        raise ValueError(f"files with hidden names have over {HIDDEN_BYTES} bytes")
    return TextFiles(root, folders, hidden)


def file_times(spark: SparkSession, files: TextFiles) -> DataFrame:
    """modificationTime of each file; no contents are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(files.folders).select("modificationTime")
    seconds = spark.createDataFrame([(t,) for _, _, t in files.hidden], "t double").select(F.timestamp_seconds("t").alias("modificationTime"))
    return listed.unionAll(seconds)


def file_lines(spark: SparkSession, files: TextFiles) -> DataFrame:
    """source_text (path below the root), block (a split's first byte), source_offset and line of each physical line.

    UTF-8 with bad bytes replaced, a leading byte-order mark dropped, lines ended by \\n, \\r\\n or \\r only. Files are split by bytes,
    so one of any size is read by many tasks: lines are counted a split, and a split's first line has the number of all
    lines in the splits before it.
    """
    prefix = qualified(spark, files.root).rstrip("/") + "/"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(files.folders)
    # a file's name comes as a URI
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = raw.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.make_valid_utf8("value").alias("line"))
    rows = stored(rows, "split")
    splits = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(splits.withColumn("before", before), "splits")
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    source = F.col("path")
    for p in (prefix, prefix.replace("file:///", "file:/")):
        source = F.when(F.col("path").startswith(p), F.substring(F.col("path"), len(p) + 1, 1 << 30)).otherwise(source)
    offset = (F.col("id") - F.col("first") + F.col("before")).cast("int")
    lines = rows.join(splits, ["path", "block"]).select(source.alias("source_text"), "block", offset.alias("source_offset"), "line")
    lines = lines.withColumn("line", F.when(F.col("source_offset") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    own = []
    for path, _, _ in files.hidden:
        text = read_bytes(spark, path).decode("utf-8-sig", "replace")
        name = path.removeprefix(prefix).removeprefix(prefix.replace("file:///", "file:/"))
        own += [(name, 0, i, line) for i, line in enumerate(re.split("\r\n|\r|\n", text))]
    return lines.unionAll(spark.createDataFrame(own, lines.schema)) if own else lines


def document_lines(documents: DataFrame) -> DataFrame:
    """The lines of a table of documents: source_text is 'source/doc_id.txt', with doc_id kept for the order."""
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return documents.select("doc_id", name.alias("source_text"), F.posexplode(F.split("text", "\r\n|\r|\n")).alias("source_offset", "line"))


def parts(rows: DataFrame) -> int:
    """Into how many parts to deal ``rows`` of files: about PART_BYTES of input each, and one a core at least. A task's memory doesn't grow with the input."""
    spark = rows.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() * max(1, round(split / PART_BYTES)))


def searchable(lines: DataFrame) -> DataFrame:
    """``lines`` with completed_sentence and normalized_sentence; blank lines and lines without a letter or digit go."""
    # the same as to ask whether the normalised text is empty, which would be made twice for that
    rows = lines.where(F.lower("line").rlike(r"[\p{L}\p{N}]")).withColumn("completed_sentence", strip("line"))
    return rows.withColumn("normalized_sentence", normalize("completed_sentence")).drop("line")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, which are in order within partitions and from one to the next, with contiguous sentence_ids.

    They are written once, each with its partition's number and its own in there. A partition's lines follow on those of
    all before it: what the driver sees and the plan of the result holds is one count a partition.
    """
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "lines")
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(rows.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))]
    first = F.element_at(F.lit(before).cast("array<bigint>"), (part + 1).cast("int"))
    return rows.withColumn("sentence_id", first + own).select(*SCHEMA.names)


def path_order(column: str = "source_text") -> list[Column]:
    """Part by part, as paths compare, not as one string."""
    return [F.split(column, "/")]


def directory_records(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    order = [*path_order(), F.col("block"), F.col("source_offset")]
    lines = file_lines(spark, text_files(spark, root)).repartitionByRange(*order).sortWithinPartitions(*order)
    return first_records(numbered(searchable(lines)), limit)


def document_records(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents are dealt to ranges of doc_id before their lines are cut; each text moves once."""
    order = F.asc_nulls_last("doc_id")
    dealt = documents.select("doc_id", "source", "text").repartitionByRange(parts(documents), order)
    return first_records(numbered(searchable(document_lines(dealt).sortWithinPartitions(order, "source_offset"))), limit)


def load_records(spark: SparkSession, root: str) -> list:
    """All records of a directory on the driver, in order: for corpora that fit there."""
    return sorted(directory_records(spark, root).collect(), key=lambda r: r["sentence_id"])


def first_records(records: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` searchable records in order; all if it is None."""
    return records if limit is None else records.where(F.col("sentence_id") < limit)


def from_records(spark: SparkSession, rows: Iterable) -> DataFrame:
    """Records given in memory. ValueError unless every normalized text is non-empty and ids count from 0 in order."""
    rows = [tuple(r) for r in rows]
    if any(not r[2] for r in rows):
        raise ValueError("normalized sentences must not be empty")
    if any("\0" in r[2] for r in rows):
        raise ValueError("sentences must not hold NUL")
    if any(r[0] != i for i, r in enumerate(rows)):
        raise ValueError("sentence ids must be contiguous from 0 in record order")
    return spark.createDataFrame(rows, SCHEMA)


def violations(records: DataFrame) -> DataFrame:
    """One row of what a stored corpus breaks: empty (texts), nul, gaps (ids that are missing or repeated)."""
    n = F.col("normalized_sentence")
    return records.agg(
        F.count_if(n == "").alias("empty"), F.count_if(n.contains("\0")).alias("nul"),
        (F.greatest(F.coalesce(F.max("sentence_id") + 1, F.lit(0)), F.count("*")) - F.count_distinct("sentence_id")).cast("long").alias("gaps"),
    )
