import random

import pytest

from linelark import benchmark, engine
from linelark.functions.text import normalize_text
from linelark.operators import metrics
from linelark.sources import corpus, store
from linelark.streaming.terminal import kept, step


def _folder(tmp_path):
    # The first file is a case of the interface's golden values.
    files = {
        "nested/sample.txt": b"\nHello, WORLD!\ncomp@uter sci$ence\n",
        "a-b.txt": b"\xef\xbb\xbfFirst\r\nsecond\rthird \x0b same\n\n?!\nbad \xff byte",
        "a/b.txt": "Straße eins\n".encode(),
        "a.txt": b"only",
        "with blank %41 + é.txt": b"named",
        "skip.md": b"no",
        "_hidden.txt": b"\xef\xbb\xbfhid\r\n\nden \xfe",
        ".dot.txt": b"dotted",
        "_folder/deep/plain.txt": b"in a folder",
        "nested/.x/_y.txt": b"deep\rhidden",
        "nested/.x/z.txt": b"",
        "_folder/_skip.md": b"no",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return sorted((p for p in tmp_path.rglob("*.txt") if p.is_file()), key=lambda p: p.relative_to(tmp_path).parts)


def _expected(tmp_path, files):
    rows = []
    for p in files:
        with open(p, encoding="utf-8-sig", errors="replace") as f:
            for at, line in enumerate(f):
                if normalize_text(line):
                    rows.append((len(rows), line.strip(), normalize_text(line), p.relative_to(tmp_path).as_posix(), at))
    return rows


def test_directory(spark, tmp_path):
    files = _folder(tmp_path)
    want = _expected(tmp_path, files)
    assert sorted(map(tuple, corpus.directory_records(spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, corpus.directory_records(spark, str(tmp_path), 3).collect())) == want[:3]
    assert list(map(tuple, corpus.load_records(spark, str(tmp_path)))) == want
    assert corpus.violations(corpus.directory_records(spark, str(tmp_path))).first().asDict() == {"empty": 0, "nul": 0, "gaps": 0}


def test_files_are_read_by_splits(spark, tmp_path):
    """Lines of files that many tasks read have the numbers of the whole file, whatever ends them and wherever a split falls."""
    rng = random.Random(4)
    for f in range(3):
        (tmp_path / f"f{f}.txt").write_bytes(b"".join(rng.choice([b"word", b"some words here", b"", b"x\xff", "ü€😀".encode()]) + rng.choice([b"\n", b"\r\n", b"\r", b"\n\n"]) for _ in range(400)))
    want = _expected(tmp_path, sorted(tmp_path.glob("*.txt")))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("333", "0", "1")):
            spark.conf.set(n, v)
        lines = corpus.file_lines(spark, corpus.text_files(spark, str(tmp_path)))
        assert lines.select("source_text", "block").distinct().count() > 20
        got = sorted(map(tuple, corpus.directory_records(spark, str(tmp_path)).collect()))
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert got == want


def test_hidden_files_are_bounded(spark, tmp_path, monkeypatch):
    _folder(tmp_path)
    monkeypatch.setattr(corpus, "HIDDEN_BYTES", 10)
    with pytest.raises(ValueError, match="hidden"):
        corpus.text_files(spark, str(tmp_path))


def test_missing_directory_and_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.text_files(spark, str(tmp_path / "none"))
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(NotADirectoryError):
        corpus.text_files(spark, str(tmp_path / "f.txt"))


def test_store_follows_files_and_limit(spark, tmp_path):
    root, store = tmp_path / "in", tmp_path / "store"
    root.mkdir()
    _folder(root)
    load = lambda limit=None: engine.Completer.from_directory(spark, str(root), limit, f"file://{store}")
    assert load().offline_metrics["from_store"] == 0
    again = load()
    assert again.offline_metrics["from_store"] == 1 and again.best("hello")[0]["completed_sentence"] == "Hello, WORLD!"
    assert load(2).offline_metrics["from_store"] == 0
    (root / "new.txt").write_text("hello again")
    made = load(2)
    assert made.offline_metrics["from_store"] == 0 and made.records.count() == 2


def test_store_survives_a_run_that_dies(spark, tmp_path):
    """Until the new records are complete the store gives the old ones; then it gives the new."""
    root, at = tmp_path / "in", f"file://{tmp_path}/store"
    root.mkdir()
    (root / "a.txt").write_text("one\ntwo\nthree")
    load = lambda limit=None, index=False: engine.Completer.from_directory(spark, str(root), limit, at, index)
    load()
    times = corpus.file_times(spark, corpus.text_files(spark, str(root)))

    def dies():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.cached_records(spark, at, times, 2, dies)
    kept = load()
    assert kept.offline_metrics["from_store"] == 1 and kept.records.count() == 3
    assert load(2).records.count() == 2 and load(2).offline_metrics["from_store"] == 1
    made = load(2, index=True)
    assert made.offline_metrics["from_store"] == 1 and made.offline_metrics["build_seconds"] > 0
    assert [r["completed_sentence"] for r in load(2, index=True).best("two")] == ["two"]
    for limit in (1, 3):
        load(limit)
    assert sum(p.name.startswith("records") for p in (tmp_path / "store").iterdir()) <= 3


def test_tables_in_the_shared_folder_can_be_cleared(spark, tmp_path):
    kept = store.stored(spark.range(3), "x", f"file://{tmp_path}/own")
    gone = store.stored(spark.range(3), "x").inputFiles()[0]
    assert store.clear(spark) >= 1 and store.clear(spark) == 0 and kept.count() == 3
    assert store.path_kind(spark, gone) == "missing"


def test_module_interface(spark, tmp_path):
    engine._engine = None
    with pytest.raises(RuntimeError):
        engine.get_best_k_completions("x")
    _folder(tmp_path)
    engine.initialize(spark, str(tmp_path))
    rows = engine.get_best_k_completions("hello")
    assert rows[0]["source_text"] == "nested/sample.txt" and rows[0]["offset"] == 1
    assert engine.display(engine._engine.best("hello wor")) == ["1. Hello, WORLD! (sample 1, score 18)"]
    assert engine._engine.statistics()["sentences"] == 15
    figures = engine._engine.last_query_metrics
    assert figures["candidate_count"] == 1 and figures["candidate_seconds"] + figures["ranking_seconds"] == figures["total_seconds"]
    assert engine.metrics_line(figures).endswith("1 candidates")
    assert engine._engine.best("?!") == [] and engine._engine.last_query_metrics["candidate_count"] == 0


def test_documents_with_gaps(spark):
    rows = [(3, "b\n\n c ", "s"), (1, "a", "s"), (2, None, "s"), (5, "", "s"), (9, "!\nd", None)]
    got = corpus.document_records(spark.createDataFrame(rows, "doc_id long, text string, source string").where("source is not null")).collect()
    assert sorted(map(tuple, got)) == [(0, "a", "a", "s/1.txt", 0), (1, "b", "b", "s/3.txt", 0), (2, "c", "c", "s/3.txt", 2)]
    assert corpus.document_records(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_records_are_written_once_and_in_order(spark, monkeypatch):
    """One table whatever the number of parts, in id order within files, its parts as many as the input asks for; doc_ids may be in any order, occur twice or be null."""
    monkeypatch.setattr(corpus, "PART_BYTES", 16 << 20)
    docs = spark.createDataFrame([(i * 37 % 101, f"line {i}\n!\n\u00a0 other\u2003 {i}\tx", "s") for i in range(101)] + [(5, "A\nB", "t"), (None, "last", "u")], "doc_id long, text string, source string").repartition(3)
    assert corpus.parts(docs) >= 3 * 8
    made = len(store._made)
    got = corpus.document_records(docs)
    assert len(store._made) == made + 1
    text = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Exchange" not in text and "Window" not in text and "Sort" not in text
    rows = sorted(map(tuple, got.collect()))
    assert [r[0] for r in rows] == list(range(101 * 2 + 3)) and rows[-1][1:] == ("last", "last", None, 0)
    places = [(int(r[3][2:-4]), r[4]) for r in rows[:-1]]
    assert places == sorted(places) and rows[1][1:3] == ("other\u2003 0\tx", "other 0 x")
    for f in got.inputFiles():
        ids = [r["_id"] for r in spark.read.parquet(f).collect()]
        assert ids == list(range(min(ids), min(ids) + len(ids)))


def test_terminal_steps():
    assert step("x /quit ").done
    assert step("?!") == (None, "", False, False)
    taken = step("to be # ")
    assert taken == ("to be ", "to be ", True, False) and kept(taken, 2) == "" and kept(taken, 0) == "to be "
    assert kept(step("to b"), 3) == "to b"


def test_metrics(spark):
    m = spark.createDataFrame([("a", 1, "all", 10, 1, 10), ("abcd", 4, "halves", 2, 1, 10), ("abcdef", 6, "halves", 4, 0, 10)], "query string, length int, mode string, candidates long, matches long, total long")
    assert metrics.candidate_summary(m).first().asDict() == {"mean_candidates": 16 / 3, "median_candidates": 4.0, "p95_candidates": 4, "reduction_percent": 100 * (1 - 16 / 30)}
    assert {r["length_class"]: r["queries"] for r in metrics.by_length(m).collect()} == {"1-2": 1, "3-5": 1, "6-10": 1, "11-20": 0, "21+": 0}
    assert metrics.pearson(m.where("length = 4"), "length", "candidates").first()[0] == 0.0
    assert [r[0] for r in metrics.most_candidates(m, 2).collect()] == ["a", "abcdef"]
    timed = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "query string, total_seconds double")
    assert [r["query"] for r in metrics.slowest(timed, 2).collect()] == ["c", "a"]
    assert metrics.synthetic_sentences(spark, 50).where("sentence rlike '^[A-Z][a-z]+( [a-z]+){2,4}$'").count() == 50


def test_benchmark(spark):
    records = corpus.from_records(spark, [(i, f"words of line {i} here", f"words of line {i} here", "s.txt", i) for i in range(60)]).cache()
    figures, slow = benchmark.run(records, queries=12, checked=3)
    assert len(slow) == 10 and [r["total_seconds"] for r in slow] == sorted((r["total_seconds"] for r in slow), reverse=True)
    assert benchmark.run(records, queries=2, checked=2, index=True)[0]["build_seconds"] > 0
    assert benchmark.shown(engine.Completer(records), "Line 59 hexe")[-1] == "  59: offset 9, substitution: words of line 59 here"
    assert figures["records"] == 60 and figures["queries"] == 12 and figures["checked"] == 3 and figures["p95_seconds"] > 0
    with pytest.raises(ValueError):
        benchmark.run(records.limit(0), 5, 1)
