"""The pipeline against a brute-force version of each stage, from the rows that the stage before left."""

import os

import pytest
import test_ops as ops

import corpus_pipeline
from linelark.llm import decontam, quality, scratch
from linelark.llm.queries import tokenizer_paths

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_and_run(spark):
    first = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, DATA), name)
        assert docs.dtypes == first.dtypes
        got = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "quality":
            scores = quality.quality_scores(first, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
            want = {r["doc_id"]: kept[r["doc_id"]] for r in scores if r["predicted"]}
            assert len(want) > 0.6 * len(kept)
        elif name == "near_duplicates":
            ids = sorted(kept)
            roots = ops.brute_components([kept[i]["text"] for i in ids], 5)[1]
            want = {ids[n]: kept[ids[n]] for n, r in enumerate(roots) if n == r}
        elif name == "decontamination":
            items = [r["text"].lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            flat = lambda t: " ".join(decontam.words_of(t))
            want = {i: d for i, d in kept.items() if not any(f" {flat(x)} " in f" {flat(d['text'])} " for x in items)}
        else:
            want = kept
            for i, d in got.items():
                assert not ops.base_spans(d["text"]) and d["n_chars"] == len(d["text"])
                if not ops.base_spans(kept[i]["text"]) and "[SECRET]" not in d["text"] and "[PHONE]" not in d["text"]:
                    assert d == kept[i]
            kept = want = got
        assert got == want, name
        kept = got
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_paths()[0])
    ids = {i: tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0] for i, d in kept.items()}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    assert ops.packed(rows, ids, 1024, 64, 1024) <= 0.02 * sum(map(len, ids.values()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names, empty tables."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, gone string, kind int, _row string, spans string, items string, component_id long, sketch string"
    texts = [*ops.ODD, "write to a.b@c.de or +1 (555) 123-4567", "word " * 200_000]
    rows = [(i, t, "en" if i % 2 else None, None, len(t or ""), "x", 1, "r", "s", "i", 7, None) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "no id here", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, columns)
    got = stage(spark, df, DATA).collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
        assert sum(r["length"] for r in got if r["doc_id"] is None) == 5 and stage(spark, df.limit(0), DATA).collect() == []
        return
    made = stage(spark, df, DATA)
    assert made.dtypes == df.dtypes and stage(spark, df.limit(0), DATA).collect() == []
    kept = [tuple(r) for r in got]
    if name == "personal_data":
        changed = [r for r in kept if r[0] == 10]
        assert len(kept) == len(rows) and sorted(map(str, (r for r in kept if r[0] != 10))) == sorted(map(str, (r for r in rows if r[0] != 10)))
        assert len(changed) == 3 and all(r[1] == "write to [EMAIL] or [PHONE]" and r[4] == len(r[1]) and r[5:] == rows[10][5:] for r in changed)
    else:  # whole rows, as often as they are there
        assert all(kept.count(r) in (0, rows.count(r)) for r in rows) and set(kept) <= set(rows)
        if name == "near_duplicates":
            assert {r[0] for r in kept} == {i for i in range(len(texts)) if i != 8} | {None}
        elif name == "decontamination":
            assert len(kept) == len(rows)
