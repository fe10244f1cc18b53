"""One-edit scores and verification of a query within a sentence, as column expressions over code points.

The query is a literal, so every pattern is a constant that is compiled once a task. Normalised queries hold letters,
digits and spaces only and need no escaping; others are quoted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

_SPECIAL = re.compile(r"[^\w\s]|_")


def quoted(text: str) -> str:
    """``text`` as a literal in a Java pattern."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def replacement_penalty(position: int) -> int:
    return max(1, 5 - position)


def add_or_delete_penalty(position: int) -> int:
    return max(2, 10 - 2 * position)


def replacement_penalty_of(position: Column | str) -> Column:
    return F.greatest(F.lit(1), F.lit(5) - column(position)).cast("int")


def add_or_delete_penalty_of(position: Column | str) -> Column:
    return F.greatest(F.lit(2), F.lit(10) - 2 * column(position)).cast("int")


def _best(n: Column, tiers: dict[int, list[str]]) -> Column | None:
    """The highest score whose alternatives occur in ``n``; null if none."""
    out = None
    for score in sorted(tiers, reverse=True):
        found = n.rlike("(?s)(?:" + "|".join(dict.fromkeys(tiers[score])) + ")")
        out = F.when(found, F.lit(score)) if out is None else out.when(found, F.lit(score))
    return out


def _tiers(pairs) -> dict[int, list[str]]:
    tiers: dict[int, list[str]] = {}
    for score, pattern in pairs:
        tiers.setdefault(score, []).append(pattern)
    return tiers


def best_replacement_score(query: str, sentence: Column | str) -> Column:
    """Best score of a window that differs from the query at exactly one position; null if there is none."""
    n, size = column(sentence), len(query)
    own = _tiers((2 * (size - 1) - replacement_penalty(p), quoted(query[:p]) + f"[^{quoted(query[p])}]" + quoted(query[p + 1 :])) for p in range(size))
    return F.lit(None).cast("int") if not own else _best(n, own).cast("int")


def best_extra_character_score(query: str, sentence: Column | str) -> Column:
    """Best score of the query less one of its characters within the sentence; null if there is none."""
    n, size = column(sentence), len(query)
    own = _tiers((2 * (size - 1) - add_or_delete_penalty(p), quoted(query[:p] + query[p + 1 :])) for p in range(size))
    return F.lit(None).cast("int") if not own else _best(n, own).cast("int")


def best_missing_character_score(query: str, sentence: Column | str) -> Column:
    """Best score of a window that is the query with one more character; null if there is none."""
    n, size = column(sentence), len(query)
    if not size:
        return F.lit(None).cast("int")
    return _best(n, _tiers((2 * size - add_or_delete_penalty(p), quoted(query[:p]) + "." + quoted(query[p:])) for p in range(size + 1))).cast("int")


def tier_patterns(query: str) -> list[tuple[int, str]]:
    """(score, pattern) by descending score of all single edits, for sentences that do not contain the query."""
    size = len(query)
    pairs = [(2 * (size - 1) - replacement_penalty(p), quoted(query[:p]) + "." + quoted(query[p + 1 :])) for p in range(size)]
    pairs += [(2 * (size - 1) - add_or_delete_penalty(p), quoted(query[:p] + query[p + 1 :])) for p in range(size)]
    pairs += [(2 * size - add_or_delete_penalty(p), quoted(query[:p]) + "." + quoted(query[p:])) for p in range(1, size)]
    tiers = _tiers(pairs)
    return [(s, "(?s)(?:" + "|".join(dict.fromkeys(tiers[s])) + ")") for s in sorted(tiers, reverse=True)]


def best_match_score(query: str, sentence: Column | str, least: int | None = None) -> Column:
    """2 * length if the sentence contains the query, else the best score of one edit; null if none fits, it is below ``least`` or either is empty.

    Give it a stored column: an expression would be repeated in every branch.
    """
    n = column(sentence)
    if not query:
        return F.lit(None).cast("int")
    out = F.when(F.length(n) == 0, F.lit(None)).when(n.contains(query), F.lit(2 * len(query)))
    for score, pattern in tier_patterns(query):
        if least is None or score >= least:
            out = out.when(n.rlike(pattern), F.lit(score))
    return out.cast("int")


def within_one_edit(query: str, sentence: Column | str) -> Column:
    """Whether ``best_match_score`` is a number: the sentence holds the query with at most one edit.

    An edit leaves one half of the query whole and beside what the edit made of the other. Only a sentence that holds a half
    is searched for edits of the other one.
    """
    n, size = column(sentence), len(query)
    if not size:
        return F.lit(False)

    def edited(text: str, first: int, last: int) -> str:
        """Alternatives: ``text`` with one character replaced, missing, or added at a place from ``first`` to ``last``."""
        every = [quoted(text[:p]) + "." + quoted(text[p + 1 :]) for p in range(len(text))] + [quoted(text[:p] + text[p + 1 :]) for p in range(len(text))]
        every += [quoted(text[:p]) + "." + quoted(text[p:]) for p in range(first, last + 1)]
        return "(?:" + "|".join(dict.fromkeys(every)) + ")"

    left, right = query[: size // 2], query[size // 2 :]
    # nothing is added before or behind the query, as it is then there itself
    found = n.contains(query) | (n.contains(left) & n.rlike(f"(?s){quoted(left)}{edited(right, 0 if left else 1, len(right) - 1)}"))
    if left:
        found = found | (n.contains(right) & n.rlike(f"(?s){edited(left, 1, len(left) - 1)}{quoted(right)}"))
    return (F.length(n) > 0) & found


def verify_one_edit(query: str, sentence: Column | str) -> Column:
    """struct(matched, match_offset, edit_type): exact, then substitution, insertion (the query has one more character), deletion; the earliest offset of the first kind that fits."""
    n, size = column(sentence), len(query)
    result = lambda at, kind: F.struct(F.lit(True).alias("matched"), at.cast("int").alias("match_offset"), F.lit(kind).alias("edit_type"))
    nothing = F.struct(F.lit(False).alias("matched"), F.lit(None).cast("int").alias("match_offset"), F.lit(None).cast("string").alias("edit_type"))
    if not size:
        return nothing
    kinds = {
        "substitution": [quoted(query[:p]) + "." + quoted(query[p + 1 :]) for p in range(size)],
        "insertion": [quoted(query[:p] + query[p + 1 :]) for p in range(size)],
        "deletion": [quoted(query[:p]) + "." + quoted(query[p:]) for p in range(size + 1)],
    }
    out = F.when(n.contains(query), result(F.instr(n, query) - 1, "exact"))
    for kind, patterns in kinds.items():
        alternatives = "|".join(dict.fromkeys(patterns))
        # the length of what precedes counts code points, a match position would count UTF-16 units
        out = out.when(n.rlike(f"(?s)(?:{alternatives})"), result(F.length(F.regexp_extract(n, f"(?s)^(.*?)(?:{alternatives})", 1)), kind))
    return out.otherwise(nothing)
