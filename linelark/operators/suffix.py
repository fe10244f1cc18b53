"""The suffix order of a corpus and what is read off it, spread over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .ordering import with_running_total

#: Width of the buckets of positions by which positions and sentences meet.
BUCKET = 1024


def sentence_starts(records: DataFrame) -> DataFrame:
    """(sentence_id, normalized_sentence, start, length): places in the corpus of all sentences joined by one NUL."""
    rows = records.select("sentence_id", "normalized_sentence", F.length("normalized_sentence").alias("length")).withColumn("_width", F.col("length") + 1)
    return with_running_total(rows, [F.col("sentence_id")], "_width", "start").drop("_width")


def characters(records: DataFrame) -> DataFrame:
    """(position, code): every code point of the joined corpus, 0 for the separators between sentences."""
    starts = stored(sentence_starts(records), "starts")
    last = starts.agg(F.max("sentence_id")).first()[0]
    text = F.when(F.col("sentence_id") == last, F.col("normalized_sentence")).otherwise(F.concat("normalized_sentence", F.lit("\0")))
    split = F.split(text, "")
    return starts.select("start", F.posexplode(split).alias("_at", "_c")).where("_c <> ''").select((F.col("start") + F.col("_at")).alias("position"), _code("_c").alias("code"))


def _code(c: str):
    """The code point of a one-character string: its UTF-32 bytes as a number."""
    return F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("long")


def suffix_array(records: DataFrame) -> DataFrame:
    """(rank, position) of all suffixes of the joined corpus, separators included, in code point order.

    Prefix doubling: a suffix's rank by its first k characters and that of the suffix k places on give its rank by 2 k. Each
    round is an equi-join on positions, a count of equal pairs and a running sum over their order, and is written to files;
    it ends when all ranks differ. What is sorted are pairs of numbers, never suffixes.
    """
    rows = characters(records).withColumnRenamed("code", "rank")
    ranked = stored(_ranked(rows.select("position", F.col("rank").alias("a"), F.lit(-1).cast("long").alias("b"))), "ranks")
    width, total = 1, ranked.count()
    while ranked.select("rank").distinct().count() < total:
        # the rank of what begins width places later; -1 where the corpus has ended
        later = ranked.select((F.col("position") - width).alias("position"), F.col("rank").alias("b"))
        pairs = ranked.join(later, "position", "left").select("position", F.col("rank").alias("a"), F.coalesce("b", F.lit(-1)).alias("b"))
        ranked = stored(_ranked(pairs), "ranks")
        width *= 2
    return ranked.select(F.col("rank").cast("int").alias("rank"), F.col("position").cast("int").alias("position"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """(position, rank): how many positions have a smaller pair (a, b)."""
    pairs = stored(pairs, "pairs")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    ranks = with_running_total(counts, [F.col("a"), F.col("b")], "n", "rank")
    return pairs.join(ranks, ["a", "b"]).select("position", "rank")


def suffix_at(records: DataFrame, rank: int) -> int:
    """The position of the suffix of that rank; IndexError if there is none."""
    row = suffix_array(records).where(F.col("rank") == rank).first()
    if row is None:
        raise IndexError(rank)
    return int(row["position"])


def locate(records: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, sentence_id, match_offset) of corpus positions; separators and places outside give no row.

    An equi-join on buckets of BUCKET positions: a sentence is in each bucket that it reaches into, a position in one.
    """
    starts = sentence_starts(records).where("length > 0").select("sentence_id", "start", "length")
    first, last = F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.col("length") - 1) / BUCKET)
    own = starts.select("*", F.explode(F.sequence(first, last)).alias("_bucket"))
    p = F.col("position")
    met = positions.withColumn("_bucket", F.floor(p / BUCKET)).join(own, "_bucket")
    return met.where((p >= F.col("start")) & (p < F.col("start") + F.col("length"))).select("position", "sentence_id", (p - F.col("start")).cast("int").alias("match_offset"))
