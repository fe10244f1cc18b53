"""Language identification with a bit-sliced Bloom filter of character n-grams.

Row h of the filter is a bit mask over languages. The AND of the rows that an n-gram hashes to has a bit for every
language whose filter may hold it. A text's score for a language is the popcount of its bit over all n-grams, less
the false positives expected at that filter's fill, and the largest corrected count decides.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .scratch import map_rows, remainder

ROWS, HASHES, SHORTEST, LONGEST = 1 << 18, 4, 2, 5
#: Documents of each language, and characters of one, used for fitting at most.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
#: Languages told apart at most.
MOST_LANGUAGES = 1000
#: An n-gram enters a language's filter if its rate there is at least this share of its highest rate.
SHARE, LEAST = 0.25, 2
#: Characters looked up at once.
PART = 1 << 18


#: Runs of word characters other than digits and underscores: letters, and numbers such as ² or Ⅷ.
_RUNS = re.compile(r"[^\W\d_]+")


def _words(text: str):
    """Runs of letters as str.isalpha() knows them."""
    for run in _RUNS.findall(text):
        if run.isalpha():
            yield run
        else:
            yield from "".join(c if c.isalpha() else " " for c in run).split()


def _grams(words: list[str]):
    """Two hashes of every n-gram within the words; a word's ends count as characters."""
    points = grams.spaced(words)
    blanks = np.cumsum(points == 32)
    for (n, a), (_, b) in zip(grams.hashes(points, SHORTEST, LONGEST), grams.hashes(points, SHORTEST, LONGEST, 77)):
        own = blanks[n - 2 : n - 2 + len(a)] == blanks[: len(a)]  # no blank but at its ends
        yield a[own], b[own] | np.uint32(1)


#: Which bits each byte has.
_BITS = np.arange(256)[:, None] >> np.arange(8) & 1


def _masks(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = rows[a % np.uint32(ROWS)]
    for i in range(1, HASHES):
        found = found & rows[(a + np.uint32(i) * b) % np.uint32(ROWS)]
    return found


def _parts(text: str):
    words, size = [], 0
    for w in _words(text.lower()):
        words.append(w)
        size += len(w) + 1
        if size > PART:
            yield words
            words, size = [], 0
    if words:
        yield words


def fit(sample: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, list[float]]:
    """(languages, masks of the filter's rows, false positive rate of each language) from (text, language) rows.

    One mask holds 64 languages; more of them add columns of masks.
    """
    names = sorted({lang for _, lang in sample})
    keys, counts = [], []
    for name in names:
        found = [np.empty(0, np.uint64)]
        for text, lang in sample:
            if lang == name:
                for words in _parts(text):
                    found += [a.astype(np.uint64) << np.uint64(32) | b for a, b in _grams(words)]
        k, n = np.unique(np.concatenate(found), return_counts=True)
        keys.append(k)
        counts.append(n)
    rows = np.zeros((max(1, -(-len(names) // 64)), ROWS), np.uint64)
    if not names:
        return names, rows, []
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    rate = np.concatenate([n / max(1, n.sum()) for n in counts])
    highest = np.zeros(len(every))
    np.maximum.at(highest, back, rate)
    enough = (np.concatenate(counts) >= LEAST) & (rate >= SHARE * highest[back])
    false, at = [], 0
    for i, k in enumerate(keys):
        kept = k[enough[at : at + len(k)]]
        at += len(k)
        a, b = (kept >> np.uint64(32)).astype(np.uint32), kept.astype(np.uint32)
        slots = np.unique(np.concatenate([(a + np.uint32(j) * b) % np.uint32(ROWS) for j in range(HASHES)]))
        rows[i // 64][slots] |= np.uint64(1 << i % 64)
        false.append(min(0.99, (len(slots) / ROWS) ** HASHES))
    return names, rows, false


class Identifier:
    def __init__(self, names: list[str], rows: np.ndarray, false: list[float]) -> None:
        self.names, self.rows, self.false = names, rows, np.array(false)

    def __call__(self, text: str | None) -> tuple[str, float]:
        n, counts = 0, np.zeros(len(self.names))
        for words in _parts(text) if text else ():
            for a, b in _grams(words):
                n += len(a)
                for block, rows in enumerate(self.rows):
                    masks = _masks(rows, a, b)
                    here = self.names[64 * block : 64 * block + 64]
                    if len(here) <= 8:  # few languages: count each mask once
                        sets = np.bincount(masks.astype(np.uint8), minlength=256)
                        counts[64 * block : 64 * block + len(here)] += sets @ _BITS[:, : len(here)]
                        continue
                    for i in range(len(here)):
                        counts[64 * block + i] += np.count_nonzero(masks & np.uint64(1 << i))
        if not n or not self.names:
            return "und", 0.0
        corrected = np.maximum(0.0, (counts - n * self.false) / (1 - self.false))
        best = int(np.argmax(corrected))
        return self.names[best], min(1.0, float(corrected[best] / corrected.sum())) if corrected[best] else 1 / len(self.names)


def sample_of(documents: DataFrame, train, per_language: int, max_chars: int, max_languages: int) -> list[tuple[str, str]]:
    """At most ``per_language`` training texts of each language, by smallest hash of the id.

    Texts above ``max_chars`` are passed over, but a language of longer texts only gives its shortest one. Rows that share
    an id and a language count as one (the smallest text); rows without an id are not used. ValueError above
    ``max_languages`` languages, as the driver holds a sample and every worker a filter of each.
    """
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & train)
    usable = usable.select("doc_id", "lang", F.col("text").cast("string").alias("text"), (F.length("text") <= max_chars).alias("short"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count_if("short").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return []
    # thin by hash before ranking, so that the ranked rows are few in every language, however common
    span = 1 << 40
    cut = F.create_map([F.lit(x) for lang, n in counts.items() for x in (lang, min(span, int(span * 2.0 * per_language / max(1, n)) + 1))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    kept = usable.where("short").select("doc_id", "lang", h.alias("h")).where(F.col("h") < cut[F.col("lang")]).distinct()
    ranked = kept.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language)
    chosen = ranked.select("doc_id", "lang")  # per_language ids of each of max_languages
    texts = usable.where("short").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in texts.collect()]
    long_ones = [lang for lang, n in counts.items() if not n]
    if long_ones:
        least = F.min(F.struct(F.length("text").alias("size"), "doc_id", "text")).alias("least")
        rows += [(r["least"]["doc_id"], r["lang"], r["least"]["text"]) for r in usable.where(F.col("lang").isin(long_ones)).groupBy("lang").agg(least).collect()]
    return [(text, lang) for _, lang, text in sorted(rows)]


def identify(documents: DataFrame, folds: int = 5, held_out: int = 0, per_language: int = SAMPLE_PER_LANGUAGE, max_chars: int = SAMPLE_CHARS, max_languages: int = MOST_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``documents`` (doc_id, text, lang).

    Learns only from text and non-null lang of rows with crc32(doc_id as text) mod ``folds`` other than ``held_out``, at most
    ``per_language`` of each language with texts of up to ``max_chars`` characters.
    ``und`` with score 0: null text, text without a letter (as str.isalpha() knows them), or nothing to learn from. Otherwise
    score is the winner's share of all corrected counts; ties go to the first name. Repeated rows repeat; other columns are
    ignored; an empty table gives no rows. ValueError above ``max_languages`` languages.
    """
    train = remainder("doc_id", folds) != held_out
    shared = documents.sparkSession.sparkContext.broadcast(fit(sample_of(documents, train, per_language, max_chars, max_languages)))

    def start():
        identifier = Identifier(*shared.value)
        return lambda doc_id, text, out: (doc_id, out, *identifier(text))

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder("doc_id", folds) == held_out).alias("held_out"))
    return map_rows(rows, start, "doc_id long, held_out boolean, lang_pred string, score double")
