"""The corpus on disk: Parquet in the shared folder, with a signature that tells when it is out of date."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_linelark_store"):
        spark._linelark_store = tempfile.mkdtemp(prefix="linelark-store-")
    return f"file://{spark._linelark_store}"


_made: list[str] = []


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written and read back: plans on it start from files."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables in the shared folder that this process has written, and says how many: call it when no result that reads them is needed any more.

    Tables at paths of the caller's own, such as a store's, stay.
    """
    n = len(_made)
    while _made:
        fs, p = _file_system(spark, _made.pop())
        fs.delete(p, True)
    return n


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_kind(spark: SparkSession, path: str) -> str:
    """'directory', 'file' or 'missing', on any file system that Spark reads."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return "missing"
    return "directory" if fs.getFileStatus(p).isDirectory() else "file"


def hidden_names(spark: SparkSession, root: str) -> list[tuple[str, bool, int, float]]:
    """(path, whether it is a folder, bytes, modification time in seconds) of all below ``root`` whose name begins with '.' or '_'.

    Level by level, by the file system's own patterns: only what is found reaches the driver.
    """
    fs, p = _file_system(spark, root)
    level = "".join("\\" + c if c in "{}[]*?\\" else c for c in fs.makeQualified(p).toString().rstrip("/"))
    path, found = spark._jvm.org.apache.hadoop.fs.Path, []
    while True:
        found += [(f.getPath().toString(), f.isDirectory(), f.getLen(), f.getModificationTime() / 1000) for f in fs.globStatus(path(f"{level}/[._]*")) or []]
        level += "/*"
        if not fs.globStatus(path(f"{level}/*")):
            return found


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's contents, on the driver."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, latest modification) of a file or folder: it changes when the files do."""
    fs, p = _file_system(spark, path)
    found = [fs.getFileStatus(p), *(fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [])]
    return len(found), sum(f.getLen() for f in found), max(f.getModificationTime() for f in found)


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    return fs.makeQualified(p).toString()


def signature(files: DataFrame) -> tuple[int, float]:
    """(number of text files, latest modification time in seconds); (0, 0.0) for none. Reads no contents."""
    r = files.agg(F.count("*").alias("n"), F.max(F.col("modificationTime").cast("double")).alias("at")).first()
    return int(r["n"]), float(r["at"] or 0.0)


def cached_records(spark: SparkSession, path: str, files: DataFrame, limit: int | None, build) -> tuple[DataFrame, str, bool]:
    """(records, their folder, whether they came from the store at ``path``). A hit needs the same signature and limit; anything unreadable is rebuilt.

    Records are written to a folder of their own, which the meta table then names: a run that ends in between leaves the
    store as it was. The folder that the store named before stays for those who still read it; older ones are deleted.
    """
    now, before = [*signature(files), limit], None
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        before = meta["records"]
        if meta["of"] == now:
            return spark.read.parquet(f"{path}/{before}"), f"{path}/{before}", True
    except Exception:  # noqa: BLE001  a missing or broken store is built anew, as any cache
        pass
    name = f"records-{uuid.uuid4().hex}"
    made = stored(build(), "records", f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"of": now, "records": name}),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    fs, p = _file_system(spark, path)
    for f in fs.listStatus(p):
        own = f.getPath().getName()
        if own.startswith("records") and own.removesuffix("-index") not in (name, before):
            fs.delete(f.getPath(), True)
    return made, f"{path}/{name}", False
