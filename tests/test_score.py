import random

import brute
import pytest
from pyspark.sql import functions as F

from linelark.functions import score as S

# Golden cases of the interface.
GOLDEN = [("or not", "to be or not to be", 12), ("to pe", "to be", 6), ("or knot", "or not", 8), ("or nt", "or not", 8), ("zz be", "to be", None)]
VERIFIED = [
    ("cat", "cat", True, 0, "exact"), ("bat", "cat", True, 0, "substitution"), ("caat", "cat", True, 0, "insertion"), ("abcd", "abxcd", True, 0, "deletion"),
    ("cat", " cat", True, 1, "exact"), ("xab", "abxac", True, 2, "substitution"), ("cat", "cat x cat", True, 0, "exact"), ("cat", "bat x dat", True, 0, "substitution"),
    ("data structures", "algorithms and data structures are important", True, 15, "exact"), ("computer science", "i like learning computer science", True, 16, "exact"),
    ("pxthqn", "python", False, None, None), ("café", "xx café noir", True, 3, "exact"), ("καλη", "xx καλή", True, 3, "substitution"), ("", "python", False, None, None),
]


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q,s,want", GOLDEN)
def test_golden_scores(spark, q, s, want):
    assert _one(spark, S.best_match_score(q, "s"), s) == want == brute.score(q, s)


@pytest.mark.parametrize("q,s,matched,at,kind", VERIFIED)
def test_golden_verification(spark, q, s, matched, at, kind):
    assert tuple(_one(spark, S.verify_one_edit(q, "s"), s)) == (matched, at, kind) == brute.verify(q, s)


def test_random_pairs_against_the_definitions(spark):
    rng = random.Random(20260812)
    make = lambda low, high: "".join(rng.choices("aaabbccdde  😀é", k=rng.randrange(low, high)))
    sentences = [make(0, 16) for _ in range(150)]
    df = spark.createDataFrame([(s,) for s in sentences], "s string").cache()
    for q in [make(1, 8) for _ in range(24)] + ["a", "é😀"]:
        rows = df.select("s", S.best_replacement_score(q, "s").alias("r"), S.best_extra_character_score(q, "s").alias("e"), S.best_missing_character_score(q, "s").alias("m"), S.best_match_score(q, "s").alias("x"), S.verify_one_edit(q, "s").alias("v")).collect()
        for r in rows:
            s = r["s"]
            assert (r["r"], r["e"], r["m"], r["x"]) == (brute.replacement(q, s), brute.extra(q, s), brute.missing(q, s), brute.score(q, s)), (q, s)
            assert tuple(r["v"]) == brute.verify(q, s), (q, s)
            if s:  # one fits exactly when the other does
                assert r["v"]["matched"] == (r["x"] is not None), (q, s)
    df.unpersist()


def test_whether_an_edit_fits_is_whether_there_is_a_score(spark):
    rng = random.Random(7)
    make = lambda low, high: "".join(rng.choices("aab c😀", k=rng.randrange(low, high)))
    sentences = [make(0, 14) for _ in range(300)] + [None]
    df = spark.createDataFrame([(s,) for s in sentences], "s string").cache()
    for q in [make(n, n + 1) for n in range(1, 9) for _ in range(3)] + ["a.b", ""]:
        for r in df.select("s", S.best_match_score(q, "s").alias("x"), S.within_one_edit(q, "s").alias("w")).collect():
            assert bool(r["w"]) == (r["x"] is not None) == (r["s"] is not None and brute.score(q, r["s"]) is not None), (q, r)
    df.unpersist()


def test_penalties(spark):
    rows = spark.range(8).select("id", S.replacement_penalty_of("id").alias("a"), S.add_or_delete_penalty_of("id").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(S.replacement_penalty(i), S.add_or_delete_penalty(i)) for i in range(8)] == [(5, 10), (4, 8), (3, 6), (2, 4), (1, 2), (1, 2), (1, 2), (1, 2)]


def test_empty_query_and_null_sentence(spark):
    for f in (S.best_match_score, S.best_replacement_score, S.best_extra_character_score, S.best_missing_character_score):
        assert _one(spark, f("", "s"), "abc") is None
        assert _one(spark, f("ab", "s"), None) is None
    assert _one(spark, S.best_match_score("a*b", F.col("s")), "xa*by") == 6
