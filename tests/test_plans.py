"""What the physical plans must and must not hold."""

import pytest

from linelark.functions.text import normalize_text
from linelark.operators import metrics, search
from linelark.sources import corpus, store


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    lines = [f"line {i} of the text" for i in range(200)]
    rows = corpus.from_records(spark, [(i, s, normalize_text(s), f"s/{i % 7}.txt", i) for i, s in enumerate(lines)])
    return store.stored(rows.repartition(4), "records", f"file://{tmp_path_factory.mktemp('plans')}/records")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_search_is_one_pushed_scan_without_a_shuffle(records):
    text = plan(search.best_completions(records, "of the text"))
    assert "TakeOrderedAndProject" in text and "StringContains" in text
    assert "Exchange hashpartitioning" not in text and "rangepartitioning" not in text
    assert "Python" not in text and "Arrow" not in text


def test_candidates_read_two_columns(records):
    text = plan(search.candidates(records, "of the text"))
    assert "ReadSchema: struct<sentence_id:bigint,normalized_sentence:string>" in text
    assert "Exchange" not in text


def test_batches_limit_before_the_shuffle(records):
    text = plan(search.batch_completions(records, [(1, "the text"), (2, "z")]))
    assert "WindowGroupLimit" in text and text.count("Scan parquet") == 2  # the operator and its details: one scan for all queries
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_statistics_aggregate_before_the_shuffle(records):
    text = plan(metrics.query_metrics(records, ["the text", "z"]))
    assert "partial_count" in text and text.count("Scan parquet") == 2


def test_matches_are_counted_by_two_patterns_a_query(records):
    """Not by one a score: a line without a match would be searched for each."""
    text = plan(metrics.query_metrics(records, ["the text"]))
    assert max(line.count("RLIKE") for line in text.splitlines()) == 2


def test_differences_read_each_side_once(records):
    text = plan(search.differences(records, records.where("sentence_id > 3")))
    assert text.count("Scan parquet") == 4  # two operators and their details


def test_candidate_joins_broadcast_the_queries(records):
    text = plan(search.batch_candidates(records, [(1, "the text")]))
    assert "BroadcastNestedLoopJoin" in text and "BuildRight" in text


def test_empty_batches(records):
    assert search.batch_completions(records, []).collect() == []
    assert search.batch_completions(records, [(1, " ?! ")]).columns == ["query_id", "query", "completed_sentence", "source_text", "offset", "score", "rank"]
