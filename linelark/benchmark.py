"""Query benchmark: ``python -m linelark.benchmark --archive FOLDER [--queries N] [--sizes N ...] [--checked N] [--index] [--show TEXT ...]``.

For each corpus size it generates queries of six kinds from the records, times them one by one, holds the first few
against brute force and prints the slowest ten. ``--index`` searches by stored trigrams; ``--show`` prints what is found for a text.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Completer
from .functions.text import normalize_text
from .operators import metrics, search
from .sources import corpus, store


FIGURES = ["candidate_count", "candidate_seconds", "ranking_seconds", "total_seconds"]


def run(records: DataFrame, queries: int, checked: int, index: bool = False) -> tuple[dict[str, float], list]:
    """(figures of one corpus, its ten slowest queries): latency and candidates (mean, median, 95th percentile), reduction, and checked queries.

    ValueError if no record has the eight characters a query is cut from; AssertionError if a checked query differs from brute force.
    """
    made = metrics.generated_queries(records).orderBy(F.xxhash64("sentence_id"), "sentence_id").limit(queries).collect()
    if not made:
        raise ValueError("no record is long enough")
    engine = Completer(records).indexed() if index else Completer(records)
    timed = []
    for i, r in enumerate(made):
        engine.best(r["query"])
        timed.append((r["query"], r["kind"], *(engine.last_query_metrics[k] for k in FIGURES)))
        if i < checked and not search.same_rows(engine.complete(r["query"]), engine.complete(r["query"], brute_force=True)):
            raise AssertionError(r["query"])
    total, candidates = records.count(), [t[2] for t in timed]
    order = sorted(t[-1] for t in timed)
    rows = records.sparkSession.createDataFrame(timed, "query string, kind string, " + ", ".join(f"{k} double" for k in FIGURES))
    figures = {
        "records": total, "queries": len(made), "mean_seconds": sum(order) / len(order), "median_seconds": (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2,
        "p95_seconds": order[max(0, int(0.95 * len(order)) - 1)], "mean_candidates": sum(candidates) / len(candidates), "reduction_percent": 100 * (1 - sum(candidates) / len(candidates) / total), "checked": min(checked, len(made)),
        "build_seconds": engine.offline_metrics.get("build_seconds", 0.0),
    }
    return figures, metrics.slowest(rows).collect()


def shown(engine: Completer, text: str) -> list[str]:
    """What is found for a text, as printed: the normalised query, candidates and their reduction, each match with place and edit."""
    query, total = normalize_text(text), engine.records.count()
    passed = search.candidates(engine.records, query).count() if query else 0
    rows = search.verified_matches(engine.records, query).join(engine.records, "sentence_id").orderBy("sentence_id").limit(20).collect() if query else []
    lines = [f"query: {text!r}", f"normalised: {query!r}", f"sentences: {total}", f"candidates: {passed}", f"reduction: {100 * (1 - passed / total) if total else 0:.0f} %"]
    return lines + [f"  {r['sentence_id']}: offset {r['match_offset']}, {r['edit_type']}: {r['completed_sentence']}" for r in rows]


def main() -> None:
    parser = argparse.ArgumentParser(prog="linelark.benchmark")
    parser.add_argument("--archive", required=True)
    # The interface's default numbers.
    parser.add_argument("--queries", type=int, default=200)
    parser.add_argument("--sizes", type=int, nargs="+", default=[10_000, 50_000, 100_000])
    parser.add_argument("--checked", type=int, default=20)
    parser.add_argument("--index", action="store_true")
    parser.add_argument("--show", nargs="*", default=[])
    args = parser.parse_args()
    spark = SparkSession.builder.appName("linelark-benchmark").getOrCreate()
    began = time.perf_counter()
    records = store.stored(corpus.directory_records(spark, args.archive), "records")
    there = records.count()
    print(f"loaded {there} records in {time.perf_counter() - began:.2f} s")
    for text in args.show:
        print("\n".join(shown(Completer(records), text)))
    for size in args.sizes:
        figures, slow = run(corpus.first_records(records, size), args.queries, args.checked, args.index)
        for name, value in figures.items():
            print(f"{name}: {value:.6g}")
        for r in slow:
            print(f"  {r['query']!r} ({r['kind']}): {1000 * r['total_seconds']:.0f} ms, {r['candidate_count']:.0f} candidates")
        if size >= there:
            break


if __name__ == "__main__":
    main()
