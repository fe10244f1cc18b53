"""The interactive session: typed lines are a stream whose only state is the text so far."""

from __future__ import annotations

from typing import NamedTuple

from ..functions.text import normalize_text


class Step(NamedTuple):
    """What to search (None: nothing), the text kept for the next input, whether a search with results clears it, whether to end."""

    query: str | None
    text: str
    once: bool
    done: bool


def step(typed: str) -> Step:
    """``typed`` is the whole edited line. '/quit' at its end ends; '#' at its end clears the text after a search that finds
    something; a line without a letter or digit clears it without a search."""
    end = typed.rstrip()
    if end.endswith("/quit"):
        return Step(None, "", False, True)
    once = end.endswith("#")
    text = end[:-1] if once else typed
    if not normalize_text(text):
        return Step(None, "", once, False)
    return Step(text, text, once, False)


def kept(taken: Step, results: int) -> str:
    """The text for the next input."""
    return "" if taken.once and results else taken.text
