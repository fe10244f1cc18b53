"""A stored index of trigrams: which sentences have them.

A query of six or more characters has three in each half, and a sentence within one edit holds a half whole. So its
candidates have all trigrams of one half; those of the rarest few are read and intersected instead of the corpus.
Sentences are kept by blocks of consecutive ids: a trigram's row has a bit for each sentence of one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stored
from .search import anchors, may_match

#: Characters of a gram; grams of a half that are intersected; ids that a filter lists at most; share of all sentences above which a scan is better.
GRAM, RAREST, LISTED, SCAN_SHARE = 3, 3, 2_000, 0.2
#: Longs of 64 sentences that a block has; sentences whose grams one task puts together, about.
LONGS, PART_SENTENCES = 4, 1 << 17
BITS = [f"b{j}" for j in range(LONGS)]


class Postings:
    """``records``, ``grams`` (block, gram, BITS) sorted by gram in each of its files, ``counts`` (gram, n) in gram order: three tables of files.

    A filter on sentence_id skips most of ``records`` if they come in id order, as the corpus does.
    """

    def __init__(self, records: DataFrame, grams: DataFrame, counts: DataFrame, total: int) -> None:
        self.records, self.grams, self.counts, self.total = records, grams, counts, total

    @classmethod
    def build(cls, records: DataFrame, path: str | None = None) -> Postings:
        """Written to ``path`` (else to the shared folder). What is dealt out are texts, by block; a block's grams are put together where they are cut."""
        at = lambda name: path and f"{path}/{name}"
        own = stored(records, "sorted", at("sorted"))
        total, cores = own.count(), own.sparkSession.sparkContext.defaultParallelism
        i, n, width = F.col("sentence_id"), F.col("normalized_sentence"), 64 * LONGS
        texts = own.select(F.floor(i / width).alias("block"), (i % width).cast("int").alias("at"), n).repartition(max(cores, -(-total // PART_SENTENCES)), "block")
        # those that begin at the first, second and third character and every third from there: no match overlaps another
        every = [F.regexp_extract_all(n if not k else F.substring(n, k + 1, 1 << 30), F.lit(f"(?s){'.' * GRAM}"), F.lit(0)) for k in range(GRAM)]
        cut = texts.select("block", "at", F.explode(F.concat(*every)).alias("gram"))
        bit = F.expr("shiftleft(1L, at & 63)")
        bits = [F.bit_or(F.when(F.shiftright("at", 6) == j, bit).otherwise(F.lit(0).cast("long"))).alias(b) for j, b in enumerate(BITS)]
        grams = stored(cut.groupBy("block", "gram").agg(*bits).sortWithinPartitions("gram", "block"), "grams", at("grams"))
        held = reduce(lambda a, b: a + b, [F.bit_count(b) for b in BITS])
        counts = stored(grams.groupBy("gram").agg(F.sum(held).alias("n")).repartitionByRange(4, "gram").sortWithinPartitions("gram"), "counts", at("counts"))
        return cls(own, grams, counts, total)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Postings:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("sorted", "grams", "counts")]
        return cls(*tables, tables[0].count())

    def _grams(self, query: str) -> list[list[tuple[str, int]]] | None:
        """(gram, sentences) of the rarest grams of each half, rarest first; None if a half is too short."""
        halves = [sorted({h[i : i + GRAM] for i in range(len(h) - GRAM + 1)}) for h in anchors(query)]
        if not all(halves):
            return None
        n = dict(self.counts.where(F.col("gram").isin(sorted({g for h in halves for g in h}))).collect())
        return [sorted(((g, n.get(g, 0)) for g in h), key=lambda x: (x[1], x[0]))[:RAREST] for h in halves]

    def ids(self, query: str) -> DataFrame | None:
        """sentence_id of all sentences that have the rarest grams of a half; None if reading the corpus is better: short queries and common grams."""
        halves = self._grams(query)
        if halves is None or sum(h[0][1] for h in halves) > SCAN_SHARE * self.total:
            return None
        # a gram that is much commoner than the rarest costs more to read than it saves
        chosen = [[g for g, n in h if n <= 8 * h[0][1]] for h in halves if h[0][1]]
        if not chosen:
            return self.records.limit(0).select("sentence_id")
        rows = self.grams.where(F.col("gram").isin(sorted({g for h in chosen for g in h})))
        none = F.lit(0).cast("long")

        def of_all(b: str) -> Column:
            each = [F.when(F.count_if(F.col("gram").isin(h)) == len(h), F.bit_and(F.when(F.col("gram").isin(h), F.col(b)))).otherwise(none) for h in chosen]
            return reduce(lambda x, y: x.bitwiseOR(y), each)

        longs = rows.groupBy("block").agg(*[of_all(b).alias(b) for b in BITS]).select("block", F.posexplode(F.array(*BITS)).alias("_j", "_bits")).where("_bits <> 0")
        bits = longs.select("block", "_j", "_bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k")).where("(shiftrightunsigned(_bits, _k) & 1) = 1")
        return bits.select(((F.col("block") * LONGS + F.col("_j")) * 64 + F.col("_k")).cast("long").alias("sentence_id"))

    def candidates(self, query: str) -> DataFrame:
        """The records that hold a half of a normalised query: as the scan gives them, by fewer rows."""
        ids = self.ids(query)
        if ids is None:
            return self.records.where(may_match(query))
        listed = [r["sentence_id"] for r in ids.limit(LISTED + 1).collect()]
        # a filter on the sorted ids, which the scan uses to skip row groups and pages; more ids than that are on most pages
        rows = self.records
        if len(listed) <= LISTED:
            rows = rows.where(F.col("sentence_id").isin(sorted(listed)) if listed else F.lit(False))
        return rows.where(may_match(query))
