"""Corpus statistics, index sizes and the figures of a query benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import within_one_edit
from .search import may_match

# Upper ends of the query length classes, words of synthetic sentences, kinds and numbers of an experiment's queries.
LENGTH_CLASSES = [(2, "1-2"), (5, "3-5"), (10, "6-10"), (20, "11-20")]
WORDS = (
    "apple bridge cloud data engine forest green happy index journey language machine network object pattern python query river science search "
    "simple system table useful vector window yellow"
).split()
EXPERIMENT = [("exact", 35), ("substitution", 35), ("insertion", 35), ("deletion", 35), ("no-match", 35), ("short-query", 25)]
KINDS = ["exact", "substitution", "insertion", "deletion", "no-match", "short"]


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row: sentences, sources, corpus_chars (with separators)."""
    return records.agg(F.count("*").alias("sentences"), F.count_distinct("source_text").alias("sources"), F.greatest(F.coalesce(F.sum(F.length("normalized_sentence") + 1), F.lit(0)) - 1, F.lit(0)).cast("long").alias("corpus_chars"))


def index_memory(records: DataFrame) -> DataFrame:
    """One row: bytes that a suffix array of 32-bit positions would take, kept and at the peak of its build."""
    s = corpus_stats(records)
    chars, starts = F.col("corpus_chars"), 4 * F.col("sentences")
    return s.select((4 * chars).alias("suffix_array_bytes"), starts.alias("sentence_starts_bytes"), (12 * chars).alias("workspace_bytes"), (16 * chars + starts).alias("build_peak_bytes"))


def lines_per_source(records: DataFrame) -> DataFrame:
    return records.groupBy("source_text").agg(F.count("*").alias("lines"))


def query_metrics(records: DataFrame, queries: list[str]) -> DataFrame:
    """One row a normalised query: query, length, mode, candidates, matches, from one scan of the corpus."""
    n = F.col("normalized_sentence")
    sums = [F.count_if(may_match(q)).alias(f"c{i}") for i, q in enumerate(queries)] + [F.count_if(within_one_edit(q, n)).alias(f"m{i}") for i, q in enumerate(queries)] + [F.count("*").alias("total")]
    one = records.agg(*sums)
    rows = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(len(q)).alias("length"), F.lit("all" if len(q) < 4 else "halves").alias("mode"), F.col(f"c{i}").alias("candidates"), F.col(f"m{i}").alias("matches"), F.col("total")) for i, q in enumerate(queries)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def length_class(length: Column) -> Column:
    out = None
    for top, name in LENGTH_CLASSES:
        out = F.when(length <= top, F.lit(name)) if out is None else out.when(length <= top, F.lit(name))
    return out.otherwise(F.lit("21+"))


def by_length(metrics: DataFrame) -> DataFrame:
    """Queries, mean and median candidates and mean matches of each length class, empty classes included."""
    spark = metrics.sparkSession
    classes = F.broadcast(spark.createDataFrame([(n,) for _, n in LENGTH_CLASSES] + [("21+",)], "length_class string"))
    sums = metrics.groupBy(length_class(F.col("length")).alias("length_class")).agg(F.count("*").alias("queries"), F.avg("candidates").alias("mean_candidates"), F.median("candidates").alias("median_candidates"), F.avg("matches").alias("mean_matches"))
    return classes.join(sums, "length_class", "left").withColumn("queries", F.coalesce("queries", F.lit(0)))


def by_mode(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("mode").agg(F.count("*").alias("queries"), F.avg("candidates").alias("mean_candidates"), F.avg("matches").alias("mean_matches"))


def candidate_summary(metrics: DataFrame) -> DataFrame:
    """One row: mean, median and 95th percentile (the element at rank floor(0.95 n)) of candidates, and their reduction in per cent."""
    ordered = F.array_sort(F.collect_list("candidates"))
    rank = F.greatest(F.lit(1), F.floor(F.lit(0.95) * F.count("*"))).cast("int")
    mean = F.avg("candidates")
    return metrics.agg(mean.alias("mean_candidates"), F.median("candidates").alias("median_candidates"), F.element_at(ordered, rank).alias("p95_candidates"), (100 * (1 - mean / F.max("total"))).alias("reduction_percent"))


def pearson(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of two columns; 0 if one does not vary."""
    return metrics.agg(F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias("correlation"))


def most_candidates(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.select("query", "candidates").orderBy(F.desc("candidates"), "query").limit(k)


def _pick(key: Column, salt: str, n: Column | int) -> Column:
    """A number from 0 to n - 1 that follows from ``key`` and ``salt`` alone."""
    digits = F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(salt))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n.cast("long")).cast("int")


def _with_query(rows: DataFrame, key: Column, kind: Column, digits: int, seed: str) -> DataFrame:
    """``rows`` with a ``query`` of its ``kind`` cut from normalized_sentence.

    A run of 8 to 20 characters at a random place as it is, with one character replaced by x (or z, where it is x), with an x
    put in, or less one character; 999999 and the key in ``digits`` digits for no match; one letter or digit for the short kinds.
    """
    n = F.col("normalized_sentence")
    letters = F.regexp_replace(n, r"[^\p{L}\p{N}]", "")
    rows = rows.withColumn("_size", F.least(F.length(n), 8 + _pick(key, seed + "l", 13))).withColumn("_at", _pick(key, seed + "s", F.length(n) - F.col("_size") + 1))
    rows = rows.withColumn("_cut", F.substring(n, F.col("_at") + 1, F.col("_size"))).withColumn("_p", _pick(key, seed + "p", F.greatest(F.col("_size"), F.lit(1))))
    rows = rows.withColumn("_letter", F.substring(letters, _pick(key, seed + "c", F.greatest(F.length(letters), F.lit(1))) + 1, F.lit(1)))
    cut, p = F.col("_cut"), F.col("_p")
    head, tail, same = F.substring(cut, F.lit(1), p), F.substring(cut, p + 2, F.length(cut)), F.substring(cut, p + 1, F.lit(1))
    query = (
        F.when(kind == "exact", cut).when(kind == "substitution", F.concat(head, F.when(same == "x", "z").otherwise("x"), tail))
        .when(kind == "insertion", F.concat(head, F.lit("x"), same, tail)).when(kind == "deletion", F.concat(head, tail))
        .when(kind == "no-match", F.concat(F.lit("999999"), F.lpad(key.cast("string"), digits, "0"))).otherwise(F.col("_letter"))
    )
    return rows.withColumn("kind", kind).withColumn("query", query)


def generated_queries(records: DataFrame, seed: str = "20260812") -> DataFrame:
    """(sentence_id, kind, query): one benchmark query from every record of 8 or more characters, of each of KINDS in turn."""
    i = F.col("sentence_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % len(KINDS) + 1).cast("int"))
    return _with_query(records.where(F.length("normalized_sentence") >= 8), i, kind, 6, seed).select("sentence_id", "kind", "query")


def experiment_queries(records: DataFrame, n: int = 200, seed: str = "20260811") -> DataFrame:
    """(number, sentence_id, kind, query): the first ``n`` of an experiment's queries, so many of each kind, each from a record drawn for it.

    ``records`` have sentence_ids from 0 on without gaps. The few queries are the broadcast side.
    """
    spark = records.sparkSession
    total = records.agg(F.coalesce(F.max("sentence_id") + 1, F.lit(1)).alias("n")).first()["n"]
    kinds = [k for k, size in EXPERIMENT for _ in range(size)][:n]
    drawn = spark.createDataFrame(list(enumerate(kinds)), "number int, _kind string").withColumn("sentence_id", _pick(F.col("number"), seed + "i", F.lit(total)).cast("long"))
    rows = records.join(F.broadcast(drawn), "sentence_id")
    return _with_query(rows, F.col("number"), F.col("_kind"), 4, seed).select("number", "sentence_id", "kind", "query")


def slowest(timed: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rows of the highest total_seconds, ties by query."""
    return timed.orderBy(F.desc("total_seconds"), "query").limit(k)


def synthetic_sentences(spark, n: int, seed: str = "20260811") -> DataFrame:
    """(sentence_id, sentence): n sentences of three to five listed words, the first letter a capital."""
    i = F.col("id")
    words = F.array(*[F.lit(w) for w in WORDS])
    picked = F.transform(F.sequence(F.lit(1), 3 + _pick(i, seed, 3)), lambda j: F.element_at(words, _pick(F.concat_ws("-", i.cast("string"), j.cast("string")), seed, len(WORDS)) + 1))
    text = F.array_join(picked, " ")
    return spark.range(n).select(i.alias("sentence_id"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20)).alias("sentence"))
