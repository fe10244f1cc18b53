"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND (Ding and Suel, 2011).

Impacts are divided by the item's own BM25 score, so an item scores 1 against itself and one threshold serves all. The
queries are passages: windows of twice an item's length and the edits it may have, stepping by half a window, so that each
occurrence of an item lies within a passage whole. Every item above the threshold is retrieved, then verified: its question and
its answer must each be in the passage, by enough of their word 5-grams or with few words edited (bit-parallel approximate
matching; Myers, 1999).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep_rows, map_rows, table

#: Items and characters of one index that is broadcast; more items are searched in turns, one index at a time.
INDEX_ITEMS, INDEX_CHARS = 20_000, 20_000_000
#: Rows of a table of hits up to which it is broadcast.
BROADCAST_ROWS = 500_000
THRESHOLD, OVERLAP, BLOCK, GRAM = 0.6, 0.8, 8, 5
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what precedes it the question; an item of one sentence is split after two thirds."""
    parts = [w for p in re.split(r"(?<=[.!?:])\s+|\n+", text) if (w := words_of(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def n_grams(words: list[str]) -> Counter:
    n = min(GRAM, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def edits_allowed(n: int, overlap: float) -> int:
    """Words changed, added or missing at most in a copy of ``n`` words."""
    return int((1 - overlap) * n + 1e-9)


def within_edits(part: list[str], passage: list[str], most: int) -> bool:
    """Whether some run of words of ``passage`` is at most ``most`` word edits from ``part``."""
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(part):
        places[w] |= 1 << i
    full, top = (1 << len(part)) - 1, 1 << (len(part) - 1)
    # bits where the edit distance rises or falls from one word of the part to the next
    up, down, distance = full, 0, len(part)
    if distance <= most:
        return True
    for w in passage:
        same = places.get(w, 0)
        flat = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (full & ~(flat | up)), up & flat
        distance += bool(plus & top) - bool(minus & top)
        if distance <= most:
            return True
        plus, minus = plus << 1 & full, minus << 1 & full
        # a run may begin anywhere, so the first row stays 0
        vertical = same | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return False


class Index:
    """Items of similar length: postings (item, impact) by term in item order, and for each term and block of BLOCK items the largest impact."""

    def __init__(self, items: list[tuple[int, str]], terms: dict[str, int]) -> None:
        self.ids = [i for i, _ in items]
        docs = [words_of(t) for _, t in items]
        self.longest = max(map(len, docs))
        self.parts = [question_answer(t) for _, t in items]
        mean = sum(map(len, docs)) / len(docs)
        holds = Counter(w for d in docs for w in set(d))
        idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in holds.items()}
        postings = defaultdict(list)
        for i, d in enumerate(docs):
            impact = {terms[w]: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(d) / mean)) for w, n in Counter(d).items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((i, x / own))
        self.items = {t: [i for i, _ in p] for t, p in postings.items()}
        self.impacts = {t: [x for _, x in p] for t, p in postings.items()}
        blocks = [{i // BLOCK: 0.0 for i, _ in postings.get(t, ())} for t in range(len(terms))]
        for t, p in postings.items():
            for i, x in p:
                blocks[t][i // BLOCK] = max(blocks[t][i // BLOCK], x)
        self.blocks = -(-len(docs) // BLOCK)
        self.bound = np.array([max(b.values(), default=0.0) for b in blocks])
        self.block_bound = blocks
        self.first = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
        self.block = np.array([k for b in blocks for k in b], np.int64)
        self.top = np.array([x for b in blocks for x in b.values()])

    def search(self, terms: list[int], block: int, threshold: float) -> list[int]:
        """All items of a block whose summed impacts over ``terms`` reach ``threshold``, by WAND with the block's own bounds."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for t in terms:
            if block in self.block_bound[t]:
                items = self.items[t]
                lists.append([items[at := bisect_left(items, low)], at, items, t, self.block_bound[t][block]])
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for n, x in enumerate(lists):
                total += x[4]
                if total + 1e-9 >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            if lists[0][0] == item:  # every list up to the pivot is there: score it
                here = [x for x in lists if x[0] == item]
                if sum(self.impacts[x[3]][x[1]] for x in here) + 1e-9 >= threshold:
                    found.append(item)
                item += 1
            else:
                here = lists[:pivot]
            for x in here:
                x[1] = bisect_left(x[2], item, x[1])
                x[0] = x[2][x[1]] if x[1] < len(x[2]) else high
            lists = [x for x in lists if x[0] < high]
        return found

    def leaks(self, words: list[str], at: np.ndarray, terms: np.ndarray, threshold: float, overlap: float) -> set[int]:
        """Ids of items that some passage holds; ``terms`` are the index's terms at the places ``at`` of ``words``."""
        step = self.longest + edits_allowed(self.longest, overlap)
        last = max(0, -(-(len(words) - step) // step) - 1)  # number of the last passage
        window = np.concatenate((np.minimum(at // step, last), np.clip(at // step - 1, 0, last)))
        pairs = np.unique(window * len(self.bound) + np.concatenate((terms, terms)))
        window, term = np.divmod(pairs, len(self.bound))
        reach = np.bincount(window, self.bound[term], last + 1) + 1e-9 >= threshold
        if not reach.any():
            return set()
        window, term = window[reach[window]], term[reach[window]]
        size = self.first[term + 1] - self.first[term]
        picks = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        places, back = np.unique(np.repeat(window, size) * self.blocks + self.block[picks], return_inverse=True)
        found: set[int] = set()
        for place in places[np.bincount(back, self.top[picks]) + 1e-9 >= threshold].tolist():
            w, block = divmod(place, self.blocks)
            passage = words[w * step : (w + 2) * step] if w < last else words[w * step :]
            for item in self.search(term[window == w].tolist(), block, threshold):
                if item not in found and self._verified(item, passage, overlap):
                    found.add(item)
        return {self.ids[i] for i in found}

    def _verified(self, item: int, passage: list[str], overlap: float) -> bool:
        for part in self.parts[item]:
            grams = n_grams(part)
            if not grams:
                continue
            n = len(next(iter(grams)))
            there = Counter(g for i in range(len(passage) - n + 1) if (g := tuple(passage[i : i + n])) in grams)
            if sum((grams & there).values()) < overlap * sum(grams.values()) and not within_edits(part, passage, edits_allowed(len(part), overlap)):
                return False
        return True


class Searcher:
    """Indexes for each range of lengths (to 32, 64, 128, ... words), so that passages fit their items, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        classes = defaultdict(list)
        self.terms: dict[str, int] = {}
        for i, text in items:
            if words := words_of(text):
                classes[max(5, (len(words) - 1).bit_length())].append((i, text))
                for w in words:
                    self.terms.setdefault(w, len(self.terms))
        self.indexes = [Index(c, self.terms) for _, c in sorted(classes.items())]

    def __call__(self, words: list[str], threshold: float, overlap: float) -> set[int]:
        known = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        return set().union(*(i.leaks(words, at, known[at], threshold, overlap) for i in self.indexes)) if len(at) else set()


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()


def _parts(usable: DataFrame, index_items: int) -> int:
    size = usable.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    return max(1, -(-size["n"] // index_items), -(-(size["chars"] or 0) // INDEX_CHARS))


def _index(usable: DataFrame, parts: int, part: int):
    """A broadcast searcher of one part of the items."""
    rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
    return usable.sparkSession.sparkContext.broadcast(Searcher(sorted((r["item_id"], r["text"]) for r in rows)))


def _search(documents: DataFrame, shared, threshold: float, overlap: float) -> DataFrame:
    """doc_id, text, items of each row."""

    def start():
        return lambda doc_id, text: (doc_id, text, sorted(shared.value(words_of(text), threshold, overlap)))

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, start, "doc_id long, text string, items array<long>")


def _key() -> list:
    """128 bits of a text: what a text holds depends on it alone."""
    return [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]


def _hits(documents: DataFrame, usable: DataFrame, parts: int, threshold: float, overlap: float) -> DataFrame:
    """(_k1, _k2, item) for each text that holds an item: the texts meet one part of the index after another, and only the hits are written."""
    found = None
    for p in range(parts):
        shared = _index(usable, parts, p)
        hits = _search(documents, shared, threshold, overlap).where(F.size("items") > 0).select(*_key(), F.explode("items").alias("item")).distinct()
        hits = table(hits, "hits")
        found = hits if found is None else found.unionAll(hits)
        shared.destroy()
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_items: int = INDEX_ITEMS) -> DataFrame:
    """For each row of ``documents``: doc_id, items (ids of the benchmark items that it holds, ascending), n_items, contaminated.

    All passages of the whole text are queries against all items (item_id, text). Null and empty texts hold nothing;
    items without a word or an id take no part; items of equal text are all reported. Repeated rows repeat, other columns
    are ignored, and an empty table on either side gives no rows or no items. Above ``index_items`` items the texts are
    searched against one bounded part of the index after another, so that one part is in memory at a time.
    """
    usable = _usable(benchmark)
    parts = _parts(usable, index_items)
    if parts == 1:
        rows = _search(documents, _index(usable, 1, 0), threshold, overlap)
    else:
        found = table(_hits(documents, usable, parts, threshold, overlap).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item")).alias("items")), "items")
        small = (found.agg(F.sum(F.size("items") + 2)).first()[0] or 0) <= BROADCAST_ROWS
        found = F.broadcast(found) if small else found
        rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", *_key()).join(found, ["_k1", "_k2"], "left")
    items = F.coalesce("items", F.expr("CAST(array() AS array<long>)"))
    return rows.select("doc_id", items.alias("items"), F.size(items).alias("n_items"), (F.size(items) > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no benchmark item; one pass without a shuffle, or one a part of the index.

    Null and empty texts stay. Repeated rows all stay or all go. An empty table stays empty; without items all rows stay.
    """
    usable = _usable(benchmark)
    parts = _parts(usable, index_items)
    if parts > 1:
        found = table(_hits(documents, usable, parts, threshold, overlap).select("_k1", "_k2").distinct(), "found")
        names = {c: c for c in ("_k1", "_k2")}
        for c in names:
            while names[c] in documents.columns:
                names[c] += "_"
        found = found.select(*[F.col(c).alias(n) for c, n in names.items()])
        same = [(key == F.col(n)) for key, n in zip((F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.lit(1), F.col("text").cast("string"))), names.values())]
        return documents.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, same[0] & same[1], "left_anti")
    shared = _index(usable, 1, 0)

    def start():
        return lambda text: not shared.value(words_of(text), threshold, overlap)

    return keep_rows(documents, start, ["text"])
