"""Named queries over the driver's tables and the SQL they are held against.

The corpus is ``documents``: one record a line, sources named 'source/doc_id.txt'. It is built once a session and folder
and kept in the store. Scores and verification by definition run over ``part``.p_name, suffixes over ``nation``.n_name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score
from ..functions.text import casefold, normalize
from ..engine import Completer
from ..operators import metrics, search, suffix
from ..operators.postings import Postings
from ..sources import corpus
from ..sources.store import path_kind, version
from .sql import oracle_sql

__all__ = ["oracle_sql", "queries"]

_built: dict[tuple, DataFrame | Postings] = {}

#: Texts of the compared queries: all kinds of edits, short ones, one of messy case and signs, and one without a match.
EXACT, SUBSTITUTED, INSERTED, DELETED = "and the", "anb the", "thzat the", "hat te"
LONG = "thtion of thxe"
BATCH = [(1, "and the"), (2, "anb the"), (3, "de la"), (4, "z"), (5, "zq"), (6, "qqqqqq"), (7, "Und DIE!")]
MEASURED = ["z", "zq", "and", "and the", "anb the", "de la que", "thtion of the", "inthe and thestion", "qqqqqqqq", "reading and the same thing over"]
PATTERN, SCORED = "ander", ["red bolt", "bult", "ring", "gear", "x"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored corpus of the documents in ``sf_dir``, built anew if they change."""
    key = spark.sparkContext.applicationId, sf_dir, version(spark, f"{sf_dir}/documents.parquet")
    if key not in _built or path_kind(spark, _built[key].inputFiles()[0]) == "missing":
        _built[key] = corpus.document_records(_read(spark, sf_dir, "documents"))
    return _built[key]


def index(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored trigrams of the corpus in ``sf_dir``."""
    key = spark.sparkContext.applicationId, sf_dir, version(spark, f"{sf_dir}/documents.parquet"), "index"
    if key not in _built or path_kind(spark, _built[key].counts.inputFiles()[0]) == "missing":
        _built[key] = Postings.build(records(spark, sf_dir))
    return _built[key]


def _indexed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Completer(records(spark, sf_dir), index=index(spark, sf_dir)).complete(text)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", "p_name")


def _over_parts(function, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _parts(spark, sf_dir)
        out = None
        for q in SCORED:
            one = rows.select("p_partkey", F.lit(q).alias("query"), function(q, "p_name").alias(name))
            out = one if out is None else out.unionAll(one)
        return out

    return run


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_parts(score.verify_one_edit, "v")(spark, sf_dir).select("p_partkey", "query", "v.*")


def _top(text: str, brute: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search.best_completions(records(spark, sf_dir), text, brute_force=brute)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sentence_id"), F.col("n_name").alias("completed_sentence"))
    return rows.withColumn("normalized_sentence", normalize("completed_sentence"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.query_metrics(records(spark, sf_dir), MEASURED)


def _penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_size").distinct()
    return rows.select("p_size", score.replacement_penalty_of("p_size").alias("replacement"), score.add_or_delete_penalty_of("p_size").alias("add_or_delete"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = suffix.suffix_array(_nations(spark, sf_dir)).select(F.col("position").cast("long").alias("position"))
    return suffix.locate(_nations(spark, sf_dir), positions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    lines = lambda s, d: corpus.document_lines(_read(s, d, "documents"))
    found = {
        "load_lines": lambda s, d: lines(s, d).select("doc_id", "source_text", "source_offset", "line"),
        "normalized_lines": lambda s, d: corpus.searchable(lines(s, d)).select("doc_id", "source_offset", "completed_sentence", "normalized_sentence"),
        "normalized_pages": lambda s, d: _read(s, d, "pages").select("page_id", normalize("html").alias("normalized")),
        "casefolded_lines": lambda s, d: records(s, d).select("sentence_id", casefold("completed_sentence").alias("folded")),
        "sentence_ids": records,
        "first_n_records": lambda s, d: corpus.first_records(records(s, d), 500),
        "corpus_violations": lambda s, d: corpus.violations(records(s, d)),
        "exact_sentence_ids": lambda s, d: search.exact_sentence_ids(records(s, d), PATTERN),
        "exact_occurrences": lambda s, d: search.exact_occurrences(records(s, d), "thth"),
        "anchor_candidates": lambda s, d: search.candidates(records(s, d), SUBSTITUTED),
        "half_candidates": lambda s, d: search.half_candidates(records(s, d), "zqk"),
        "short_candidates_1": lambda s, d: search.candidates(records(s, d), "z"),
        "short_candidates_2": lambda s, d: search.candidates(records(s, d), "zq"),
        "short_candidates_3": lambda s, d: search.candidates(records(s, d), "zqk"),
        "penalties": _penalties,
        "replacement_score": _over_parts(score.best_replacement_score, "score"),
        "extra_char_score": _over_parts(score.best_extra_character_score, "score"),
        "missing_char_score": _over_parts(score.best_missing_character_score, "score"),
        "best_match_score": _over_parts(score.best_match_score, "score"),
        "verify_one_edit": _verified,
        "top5_exact": _top(EXACT),
        "top5_substitution": _top(SUBSTITUTED),
        "top5_insertion": _top(INSERTED),
        "top5_deletion": _top(DELETED),
        "top5_one_char": _top("z"),
        "top5_two_chars": _top("zq"),
        "indexed_top5_long": _indexed(LONG),
        "indexed_top5_substitution": _indexed(SUBSTITUTED),
        "indexed_top5_short": _indexed("zq"),
        "index_grams": lambda s, d: index(s, d).counts,
        "top5_long": _top(LONG),
        "top5_no_match": _top("qqqqqqqq"),
        "top5_messy_text": _top("  AND,   the!"),
        "top5_empty_text": _top(" ?! "),
        "top5_brute_force": _top(SUBSTITUTED, brute=True),
        "indexed_minus_brute": lambda s, d: search.differences(_top(DELETED)(s, d), _top(DELETED, brute=True)(s, d)),
        "result_differences": lambda s, d: search.differences(_top(EXACT)(s, d), _top(SUBSTITUTED)(s, d)),
        "verified_matches": lambda s, d: search.verified_matches(records(s, d), SUBSTITUTED),
        "batch_top5": lambda s, d: search.batch_completions(records(s, d), BATCH),
        "batch_candidates": lambda s, d: search.batch_candidates(records(s, d), BATCH),
        "corpus_stats": lambda s, d: metrics.corpus_stats(records(s, d)),
        "index_memory": lambda s, d: metrics.index_memory(records(s, d)),
        "lines_per_source": lambda s, d: metrics.lines_per_source(records(s, d)),
        "query_metrics": _metrics,
        "candidate_summary": lambda s, d: metrics.candidate_summary(_metrics(s, d)),
        "length_classes": lambda s, d: metrics.by_length(_metrics(s, d)),
        "filter_modes": lambda s, d: metrics.by_mode(_metrics(s, d)),
        "most_candidates": lambda s, d: metrics.most_candidates(_metrics(s, d)),
        "pearson": lambda s, d: metrics.pearson(_metrics(s, d), "length", "candidates").select(F.round("correlation", 9).alias("correlation")),
        "generated_queries": lambda s, d: metrics.generated_queries(records(s, d)),
        "experiment_queries": lambda s, d: metrics.experiment_queries(records(s, d)),
        "synthetic_sentences": lambda s, d: metrics.synthetic_sentences(s, 10_000),
        "suffix_array": lambda s, d: suffix.suffix_array(_nations(s, d)),
        "position_to_sentence": _located,
        "sentence_starts": lambda s, d: suffix.sentence_starts(records(s, d)).select("sentence_id", "start", "length"),
    }
    return found
