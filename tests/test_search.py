import random

import brute
import pytest

from linelark.functions.text import normalize_text
from linelark.operators import metrics, postings, search, suffix
from linelark.sources import corpus

WORDS = "python jython data structures algorithms learning machine computer science language zebra crossing is at cat dog how can i have this".split()


def _records(spark, lines, source="sample.txt", offset=0):
    return corpus.from_records(spark, [(i, s, normalize_text(s), source, offset + i) for i, s in enumerate(lines)])


def _expected(lines, text, k=5, source="sample.txt", offset=0):
    q = normalize_text(text)
    found = [(-x, s.casefold(), s, source, offset + i) for i, s in enumerate(lines) if (x := brute.score(q, normalize_text(s))) is not None] if q else []
    return [(s, src, at, -x, n) for n, (x, _, s, src, at) in enumerate(sorted(found)[:k], 1)]


def _typed(rng, line):
    """A piece of a line with up to two edits, and signs, blanks and capitals that normalisation takes out."""
    at = rng.randrange(len(line))
    piece = list(line[at : at + rng.choice([1, 2, 3, 6, 12])])
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        i = rng.randrange(len(piece) + 1)
        piece[i : i + rng.randrange(2)] = rng.choice([[], ["x"], ["q"]])
    if rng.random() < 0.3:
        piece.insert(rng.randrange(len(piece) + 1), rng.choice(["!", "  ", "@"]))
    return "".join(piece).upper() if rng.random() < 0.3 else "".join(piece)


def _rows(df):
    return sorted(map(tuple, df.select("completed_sentence", "source_text", "offset", "score", "rank").collect()), key=lambda r: r[-1])


def test_ties_are_alphabetical_and_five_are_kept(spark):
    # A golden case of the interface.
    lines = [f"{w} beta" for w in ("Zulu", "Alpha", "Echo", "Bravo", "Delta", "Charlie")]
    got = _rows(search.best_completions(_records(spark, lines), "beta"))
    assert [r[0] for r in got] == ["Alpha beta", "Bravo beta", "Charlie beta", "Delta beta", "Echo beta"]


def test_original_text_and_place_are_kept(spark):
    records = corpus.from_records(spark, [(0, "To be, or not to be.", "to be or not to be", "nested/quote.txt", 7)])
    assert _rows(search.best_completions(records, "OR not!")) == [("To be, or not to be.", "nested/quote.txt", 7, 12, 1)]


def test_random_corpus_against_brute_force(spark):
    rng = random.Random(20260813)
    lines = [" ".join(rng.choices(WORDS, k=rng.randrange(4, 9))).capitalize() for _ in range(300)]
    records = _records(spark, lines, "source/a.txt", 100).cache()
    queries = ["", "?!", "q" * 9] + [_typed(rng, rng.choice(lines)) for _ in range(24)]
    for q in queries:
        want = _expected(lines, q, source="source/a.txt", offset=100)
        assert _rows(search.best_completions(records, q)) == want, q
        assert _rows(search.best_completions(records, q, brute_force=True)) == want, q
    batch = search.batch_completions(records, list(enumerate(queries)))
    for i, q in enumerate(queries):
        assert _rows(batch.where(f"query_id = {i}")) == _expected(lines, q, source="source/a.txt", offset=100), q
    records.unpersist()


@pytest.mark.parametrize("listed, share", [(2000, 1.0), (0, 1.0), (2000, 0.2)])
def test_the_index_gives_what_the_scan_gives(spark, monkeypatch, listed, share, tmp_path):
    monkeypatch.setattr(postings, "LISTED", listed)
    monkeypatch.setattr(postings, "SCAN_SHARE", share)
    rng = random.Random(17)
    lines = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(200)] + ["at", "é𐐨ana été 𐐨𐐩𐐪", "x"]
    records = _records(spark, lines).cache()
    index = postings.Postings.build(records, f"file://{tmp_path}/index")
    index = postings.Postings.load(spark, f"file://{tmp_path}/index")
    queries = {normalize_text(_typed(rng, rng.choice(lines))) for _ in range(12)} | {"zzzzzzzz", "é𐐨ana ét", "machine learning data", "machine lxearning data"}
    for q in sorted(q for q in queries if q):
        want = {r[0] for r in records.where(search.may_match(q)).select("sentence_id").collect()}
        assert {r["sentence_id"] for r in index.candidates(q).collect()} == want, q
    own = [{s[i : i + 3] for i in range(len(s) - 2)} for s in map(normalize_text, lines)]
    assert {r["gram"]: r["n"] for r in index.counts.collect()} == {g: sum(g in grams for grams in own) for g in set().union(*own)}
    assert index.ids("ab") is None
    empty = postings.Postings.build(records.limit(0))
    assert empty.candidates("machine learning").collect() == []
    records.unpersist()


def test_batches_sort_only_what_reaches_the_kth_score(spark):
    lines = ["and the end"] * 7 + ["anb the", "zz"] + ["ant hill"] * 40
    records = _records(spark, lines)
    queries = ["and the", "anb the", "zz", "qqqqqq", "z"]
    assert search.kth_scores(records, queries, 5) == [14, brute.score("anb the", "and the"), brute.score("zz", "zz"), 12, brute.score("z", "ant hill")]
    assert search.kth_scores(records, ["anb the", "ant hint"], 1) == [14, brute.score("ant hint", "ant hill") or 16]
    batch = search.batch_completions(records, list(enumerate(queries)))
    for i, q in enumerate(queries):
        assert _rows(batch.where(f"query_id = {i}")) == _expected(lines, q), q


def test_the_index_has_a_row_a_block_and_gram(spark, monkeypatch):
    """Bits of all longs and blocks, whatever the number of parts; much fewer rows than grams of lines."""
    monkeypatch.setattr(postings, "PART_SENTENCES", 100)
    monkeypatch.setattr(postings, "SCAN_SHARE", 1.0)
    rng = random.Random(3)
    lines = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(700)] + ["été 𐐨𐐩𐐪𐐨", "ab"]
    records = _records(spark, lines).cache()
    index = postings.Postings.build(records)
    own = [{s[i : i + 3] for i in range(len(s) - 2)} for s in map(normalize_text, lines)]
    got, rows = [set() for _ in lines], index.grams.collect()
    for r in rows:
        for j, b in enumerate(postings.BITS):
            for k in range(64):
                if r[b] >> k & 1:
                    got[(r["block"] * postings.LONGS + j) * 64 + k].add(r["gram"])
    assert got == own and len(rows) == len({(r["block"], r["gram"]) for r in rows}) < sum(map(len, own)) / 10
    for q in ("machine learning", "zebra crossing", "languagx scien", "été 𐐨𐐩"):
        halves = [q[: len(q) // 2], q[len(q) // 2 :]]
        found = {r[0] for r in index.ids(q).collect()}
        assert {i for i, s in enumerate(map(normalize_text, lines)) if any(h in s for h in halves)} <= found < set(range(len(lines)))
        assert {r["sentence_id"] for r in index.candidates(q).collect()} == {r[0] for r in records.where(search.may_match(q)).select("sentence_id").collect()}
    records.unpersist()


def test_candidates_hold_every_match(spark):
    lines = ["python", "jython", "at", "cat", "dog", "unrelated", "banana", "bandana", "ananas"]
    records = _records(spark, lines)
    for q in ["python", "ana", "bananas", "at", "c", "cat", "dig", "xbandana"]:
        got = {r[0] for r in search.candidates(records, q).collect()}
        want = {i for i, s in enumerate(lines) if brute.score(q, s) is not None}
        assert got >= want and (len(q) > 3 or len(q) < 2 or got == want)
        assert {r[0] for r in search.half_candidates(records, q).collect()} >= want


@pytest.mark.parametrize("query", ["cat", "bat", "python", "xbandana", "c", "ana"])
def test_verified_matches(spark, query):
    lines = ["python", "jython", "at", "cat", "dog", "unrelated", "banana", "bandana", "ananas"]
    want = sorted((i, at, kind) for i, s in enumerate(lines) for ok, at, kind in [brute.verify(query, s)] if ok)
    for filtered in (True, False):
        assert sorted(map(tuple, search.verified_matches(_records(spark, lines), query, filtered).collect())) == want


def test_differences_count_copies(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(map(tuple, search.differences(a, b).collect())) == [(1, "left"), (3, "right")]
    assert not search.same_rows(a, b) and search.same_rows(a, a)


@pytest.mark.parametrize("pattern", ["ana", "a", "na", "banana", "zzz", "", "\0"])
def test_occurrences_overlap(spark, pattern):
    lines = ["banana", "bandana", "ananas", "é😀ana", "aaaa"]
    records = corpus.from_records(spark, [(i, s, s, "s.txt", i) for i, s in enumerate(lines)])
    want = [(i, at) for i, s in enumerate(lines) for at in range(len(s)) if pattern and s.startswith(pattern, at)]
    assert sorted(map(tuple, search.exact_occurrences(records, pattern).collect())) == want
    assert sorted(r[0] for r in search.exact_sentence_ids(records, pattern).collect()) == sorted({i for i, _ in want})


def test_suffixes_and_positions(spark):
    lines = ["banana", "bandana 😀", "ananas \uffee", "alpha beta", "beta alpha"]
    records = corpus.from_records(spark, [(i, s, s, "s.txt", i) for i, s in enumerate(lines)])
    whole = "\0".join(lines)
    want = sorted(range(len(whole)), key=lambda p: whole[p:])
    assert [r["position"] for r in sorted(suffix.suffix_array(records).collect(), key=lambda r: r["rank"])] == want
    few = _records(spark, ["banana", "bandana"])
    assert suffix.suffix_at(few, 3) == sorted(range(14), key=lambda p: "banana\0bandana"[p:])[3]
    with pytest.raises(IndexError):
        suffix.suffix_at(few, 14)
    assert suffix.suffix_array(records.limit(0)).collect() == []
    positions = spark.range(len(whole) + 3).withColumnRenamed("id", "position")
    places = [(p, i, p - sum(len(x) + 1 for x in lines[:i])) for p in range(len(whole)) if whole[p] != "\0" for i in [whole[:p].count("\0")]]
    assert sorted(map(tuple, suffix.locate(records, positions).collect())) == places


def test_generated_queries_follow_their_kinds(spark):
    lines = [f"axle box {i} xx yz mixed words {i % 7}" for i in range(60)] + ["short"]
    records = _records(spark, lines)
    made = metrics.generated_queries(records).collect()
    assert [r["kind"] for r in sorted(made, key=lambda r: r["sentence_id"])] == [metrics.KINDS[i % 6] for i in range(60)]
    drawn = metrics.experiment_queries(records, 200).collect()
    assert [r["kind"] for r in sorted(drawn, key=lambda r: r["number"])] == [k for k, n in metrics.EXPERIMENT for _ in range(n)]
    for r in [*made, *drawn]:
        q, line = r["query"], lines[r["sentence_id"]]
        if r["kind"] in ("short", "short-query"):
            assert len(q) == 1 and q.isalnum() and q in line
        elif r["kind"] == "no-match":
            assert q.startswith("999999") and len(q) in (10, 12)
        elif r["kind"] == "exact":
            assert q in line and min(8, len(line)) <= len(q) <= 20
        elif r["kind"] == "substitution":
            pieces = [line[a : a + len(q)] for a in range(len(line) - len(q) + 1)]
            assert any([(x, y) for x, y in zip(p, q) if x != y] in ([(c, "x")] if c != "x" else [("x", "z")] for c in p) for p in pieces)
        else:
            assert brute.score(q, line) is not None


def test_records_are_checked(spark):
    with pytest.raises(ValueError):
        corpus.from_records(spark, [(1, "a", "a", "s", 0)])
    with pytest.raises(ValueError):
        corpus.from_records(spark, [(0, "a", "", "s", 0)])
    with pytest.raises(ValueError):
        corpus.from_records(spark, [(0, "a", "a\0", "s", 0)])
