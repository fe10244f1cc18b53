"""Candidates, occurrences and the best completions of a query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import best_match_score, quoted, verify_one_edit, within_one_edit
from ..functions.text import casefold, column, normalize_text

#: Queries that are broadcast at once; queries scored in one scan.
QUERY_BLOCK, SCAN_QUERIES = 1024, 64
RESULT = ["completed_sentence", "source_text", "offset", "score", "rank"]


def anchors(query: str) -> tuple[str, str]:
    """The halves of a query: an edit of one character leaves one of them whole."""
    half = len(query) // 2
    return query[:half], query[half:]


def may_match(query: str, sentence: Column | str = "normalized_sentence", shortest: int = 4) -> Column:
    """A filter that passes every sentence within one edit of ``query``: all below ``shortest`` characters, else those that hold a half."""
    n = column(sentence)
    if len(query) < shortest:
        return F.lit(True)
    left, right = anchors(query)
    return n.contains(left) | n.contains(right)


def candidates(records: DataFrame, query: str) -> DataFrame:
    """sentence_id of the candidates of a normalised query: all for one character, exact one-edit matches for two or three, else by halves."""
    n = F.col("normalized_sentence")
    if len(query) < 2:
        kept = records
    elif len(query) < 4:
        kept = records.where(best_match_score(query, n).isNotNull())
    else:
        kept = records.where(may_match(query))
    return kept.select("sentence_id")


def half_candidates(records: DataFrame, query: str) -> DataFrame:
    """The plainer rule: all sentences below three characters, else those that hold either half."""
    return records.where(may_match(query, shortest=3)).select("sentence_id")


def exact_sentence_ids(records: DataFrame, pattern: str) -> DataFrame:
    if not pattern or "\0" in pattern:
        return records.select("sentence_id").limit(0)
    return records.where(F.col("normalized_sentence").contains(pattern)).select("sentence_id")


def exact_occurrences(records: DataFrame, pattern: str) -> DataFrame:
    """(sentence_id, match_offset) of every occurrence, overlapping ones too; offsets are code points from 0."""
    if not pattern or "\0" in pattern:
        return records.select("sentence_id", F.lit(0).alias("match_offset")).limit(0)
    # a split before every occurrence: the pieces' lengths add up to its places; a piece at 0 is one only if the text begins so
    n = F.col("normalized_sentence")
    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("found"))
    step = lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
    places = F.aggregate(F.split(n, f"(?={quoted(pattern)})", -1), empty, step)["found"]
    hits = F.filter(places, lambda at: (at > 0) | n.startswith(pattern))
    return records.where(n.contains(pattern)).select("sentence_id", F.explode(hits).alias("match_offset"))


def verified_matches(records: DataFrame, query: str, filtered: bool = True) -> DataFrame:
    """(sentence_id, match_offset, edit_type) of every sentence within one edit of a normalised query; all are verified if not ``filtered``."""
    rows = records.where(may_match(query)) if filtered else records
    return rows.select("sentence_id", verify_one_edit(query, "normalized_sentence").alias("v")).where("v.matched").select("sentence_id", "v.match_offset", "v.edit_type")


def result_order() -> list[Column]:
    """Score, then the sentence case-folded, then as written, then its place: total, as a place holds one line."""
    return [F.desc("score"), casefold("completed_sentence"), F.col("completed_sentence"), F.col("source_text"), F.col("source_offset")]


def best_completions(records: DataFrame, text: str, k: int = 5, brute_force: bool = False) -> DataFrame:
    """The ``k`` best lines that hold the normalised ``text`` with at most one edit: completed_sentence, source_text, offset, score, rank.

    ``brute_force`` scores every record. A text without a letter or digit gives no rows. Scores may be negative; equal
    lines of different places each take a rank.
    """
    query = normalize_text(text)
    rows = records.where(F.lit(bool(query)))
    if not brute_force:  # the halves are pushed to the scan
        rows = rows.where(may_match(query) & within_one_edit(query, "normalized_sentence"))
    scored = rows.withColumn("score", best_match_score(query, "normalized_sentence"))
    scored = scored.where(F.col("score").isNotNull()) if brute_force else scored
    top = scored.orderBy(*result_order()).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*result_order())))  # k rows
    return ranked.withColumnRenamed("source_offset", "offset").select(*RESULT)


def _scored(records: DataFrame, queries: list[tuple[int, str, int | None]]) -> DataFrame:
    """``records`` with number, query and score, a row for each query (number, text, least score) that fits."""
    n = F.col("normalized_sentence")

    def score(q: str, least: int | None) -> Column:
        best = best_match_score(q, n, least)
        return best if least == 2 * len(q) else F.when(within_one_edit(q, n), best)

    each = [F.struct(F.lit(i).cast("int").alias("_number"), F.lit(q).alias("query"), score(q, least).alias("score")) for i, q, least in queries]
    kept = [c for c in records.columns if c not in ("_number", "query", "score")]
    return records.select(*kept, F.explode(F.array(*each)).alias("_q")).select(*kept, "_q.*").where(F.col("score").isNotNull())


def kth_scores(records: DataFrame, queries: list[str], k: int) -> list[int]:
    """For each query the score that its ``k`` best lines reach at least: its lowest score, if fewer fit, and that of the query itself, if none does.

    One scan; the driver sees a count for each query and score.
    """
    counts = _scored(records, [(i, q, None) for i, q in enumerate(queries)]).groupBy("_number", "score").agg(F.count("*").alias("n")).collect()
    out = [2 * len(q) for q in queries]
    seen = [0] * len(queries)
    for r in sorted(counts, key=lambda r: -r["score"]):
        i = r["_number"]
        if seen[i] < k:
            out[i] = r["score"]
        seen[i] += r["n"]
    return out


def batch_completions(records: DataFrame, texts: Iterable[tuple[int, str]], k: int = 5) -> DataFrame:
    """``best_completions`` of many (query_id, text) at once, with query_id and the normalised query.

    Each scan of the corpus scores SCAN_QUERIES queries as literals: a pattern joined in from a table would be compiled
    anew for every line. A first one counts scores, so that the second keeps and sorts only lines that have the score of the
    ``k``-th one or more. Nothing is shuffled before the best k of each task and query are known.
    """
    queries = [(i, q) for i, t in texts if (q := normalize_text(t))]
    out = None
    best = Window.partitionBy("query_id").orderBy(*result_order())
    for at in range(0, max(1, len(queries)), SCAN_QUERIES):
        some = queries[at : at + SCAN_QUERIES]
        if not some:
            return records.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit("").alias("query"), "completed_sentence", "source_text", F.col("source_offset").alias("offset"), F.lit(0).alias("score"), F.lit(0).alias("rank"))
        least = kth_scores(records, [q for _, q in some], k)
        scored = _scored(records, [(j, q, x) for j, ((_, q), x) in enumerate(zip(some, least))])
        scored = scored.withColumn("query_id", F.element_at(F.lit([i for i, _ in some]).cast("array<bigint>"), F.col("_number") + 1))
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked = ranked.withColumnRenamed("source_offset", "offset").select("query_id", "query", *RESULT)
        out = ranked if out is None else out.unionAll(ranked)
    return out


def batch_candidates(records: DataFrame, texts: Iterable[tuple[int, str]]) -> DataFrame:
    """(query_id, sentence_id) of every sentence that holds a half of a query: a join of the corpus with a broadcast table of at most QUERY_BLOCK queries."""
    rows = [(i, *anchors(q)) for i, t in texts if (q := normalize_text(t))]
    n, out = F.col("normalized_sentence"), None
    for at in range(0, max(1, len(rows)), QUERY_BLOCK):
        queries = F.broadcast(records.sparkSession.createDataFrame(rows[at : at + QUERY_BLOCK], "query_id long, left string, right string"))
        found = records.select("sentence_id", n).join(queries, n.contains(F.col("left")) | n.contains(F.col("right"))).select("query_id", "sentence_id")
        out = found if out is None else out.unionAll(found)
    return out


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side``; empty if both hold the same rows as often."""
    both = left.withColumn("_n", F.lit(1).cast("long")).unionAll(right.withColumn("_n", F.lit(-1).cast("long")))
    more = both.groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.sum("_n").alias("_n")).where("_n <> 0")  # each side is made once
    return more.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).drop("_n")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows, each as often."""
    return differences(left, right).isEmpty()
