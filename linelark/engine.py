"""The completion engine: a stored corpus and its best lines for a typed text."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_text

from .operators import metrics, search
from .operators.postings import Postings
from .sources import corpus, store

_engine: Completer | None = None


class Completer:
    def __init__(self, records: DataFrame, offline: dict[str, float] | None = None, index: Postings | None = None) -> None:
        self.records, self.offline_metrics, self.last_query_metrics, self.index = records, offline or {}, {}, index

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str, limit: int | None = None, store_path: str | None = None, index: bool = False) -> Completer:
        """From the ``*.txt`` files below ``root``, by a store at ``store_path`` (never inside the corpus) that is rebuilt when files or limit change.

        ``index``: search by stored trigrams. offline_metrics: seconds to load the records and to build the index, whether they came from the store.
        """
        began = time.perf_counter()
        files = corpus.text_files(spark, root)
        build = lambda: corpus.directory_records(spark, root, limit)
        postings, built = None, 0.0
        if store_path:
            records, name, hit = store.cached_records(spark, store_path, corpus.file_times(spark, files), limit, build)
        else:
            records, name, hit = build(), None, False
        loaded = time.perf_counter() - began
        if index:
            began, at = time.perf_counter(), name and f"{name}-index"
            done = at is not None and store.path_kind(spark, f"{at}/counts/_SUCCESS") == "file"
            postings = Postings.load(spark, at) if done else Postings.build(records, at)
            records, built = postings.records, time.perf_counter() - began
        return cls(records, {"from_store": float(hit), "load_seconds": loaded, "build_seconds": built}, postings)

    def indexed(self, path: str | None = None) -> Completer:
        """The same corpus searched by trigrams, which are written to ``path`` or the shared folder."""
        began = time.perf_counter()
        index = Postings.build(self.records, path)
        return Completer(index.records, self.offline_metrics | {"build_seconds": time.perf_counter() - began}, index)

    @classmethod
    def from_documents(cls, documents: DataFrame, limit: int | None = None) -> Completer:
        return cls(corpus.document_records(documents, limit))

    @classmethod
    def from_records(cls, spark: SparkSession, rows) -> Completer:
        return cls(corpus.from_records(spark, rows))

    def statistics(self) -> dict[str, float]:
        both = metrics.corpus_stats(self.records).first().asDict() | metrics.index_memory(self.records).first().asDict()
        return self.offline_metrics | {k: float(v) for k, v in both.items()}

    def complete(self, text: str, k: int = 5, brute_force: bool = False) -> DataFrame:
        query = normalize_text(text)
        if self.index and query and not brute_force:
            return search.best_completions(self.index.candidates(query), text, k)
        return search.best_completions(self.records, text, k, brute_force)

    def best(self, text: str, k: int = 5) -> list:
        """``complete`` as rows, best first; candidates, results and seconds are in ``last_query_metrics``.

        candidate_seconds: until the candidates are known, which is the index's lookup; without an index a scan finds and
        ranks them in one, and they are 0. ranking_seconds: all from then on.
        """
        began, seen = time.perf_counter(), Observation()
        query = normalize_text(text)
        rows, looked_up = [], 0.0
        if query:
            candidates = self.index.candidates(query) if self.index else self.records.where(search.may_match(query))
            looked_up = time.perf_counter() - began if self.index else 0.0
            candidates = candidates.observe(seen, F.count("*").alias("candidates"))
            rows = sorted(search.best_completions(candidates, text, k).collect(), key=lambda r: r["rank"])
        total = time.perf_counter() - began
        self.last_query_metrics = {"candidate_count": float(seen.get["candidates"]) if query else 0.0, "results": float(len(rows)), "candidate_seconds": looked_up, "ranking_seconds": total - looked_up, "total_seconds": total}
        return rows


def metrics_line(figures: dict[str, float]) -> str:
    """A query's figures as printed."""
    ms = {k: 1000 * figures[f"{k}_seconds"] for k in ("total", "candidate", "ranking")}
    return f"{ms['total']:.0f} ms in all, {ms['candidate']:.0f} ms to look up candidates, {ms['ranking']:.0f} ms to rank, {figures['candidate_count']:,.0f} candidates"


def display(results: list) -> list[str]:
    """The rows of ``best`` as printed: number, sentence, source without folder and ending, offset, score."""
    out = []
    for r in sorted(results, key=lambda r: r["rank"]):
        stem = r["source_text"].rpartition("/")[2].rpartition(".")
        out.append(f"{r['rank']}. {r['completed_sentence']} ({stem[0] or stem[2]} {r['offset']}, score {r['score']})")
    return out


def initialize(spark: SparkSession, root: str, limit: int | None = None, store_path: str | None = None) -> None:
    global _engine
    _engine = Completer.from_directory(spark, root, limit, store_path)


def get_best_k_completions(prefix: str) -> list:
    if _engine is None:
        raise RuntimeError("call initialize() first")
    return _engine.best(prefix)
