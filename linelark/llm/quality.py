"""Quality classifier on supervised subword embeddings (after Joulin et al., 2017).

A document is the average of learned vectors of its words; a word's vector is the mean of its own hashed vector and
those of its character 3- to 5-grams (with word ends marked). Each two words side by side add the vector of their bigram,
hashed as the exclusive or of both words, so that a word met twice has one bucket whatever the word. A softmax layer
follows; everything is trained by stochastic gradient descent in numpy on the driver.
A trained model scores linearly, so what executors get is one number for each hash bucket.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .scratch import keep_rows, labelled_sample, map_rows, remainder

BITS, DIM, SHORTEST, LONGEST = 17, 8, 3, 5
#: Buckets of words and character n-grams, and behind them as many of bigrams.
PARTS_OF_WORDS = 1 << BITS
BUCKETS = 2 * PARTS_OF_WORDS
#: Labelled documents of each class, and characters of one, used for fitting at most.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 1500, 40_000
#: Characters scored at once; longer texts are scored in parts of whole words.
PART = 1 << 18
_SHIFT = np.uint32(32 - BITS)


def _word_hashes(threes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words themselves, from sums of their 3-gram hashes and their lengths."""
    total = np.concatenate(([0], np.cumsum(threes.astype(np.uint64)))).astype(np.uint64)
    return (total[last - 1] - total[first] + (last - first).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def bigram_buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams of words with these hashes."""
    return _word_buckets((left ^ right) * np.uint64(0xD6E8FEB86659FD93)) + PARTS_OF_WORDS


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many features each word has, all features word by word, hash of each word): a word's features are its own bucket and those of its n-grams."""
    points = grams.spaced(words)
    first, last = grams.places(points)
    at, found = [np.arange(len(words))], []
    for n, h in grams.hashes(points, SHORTEST, LONGEST):
        if n == 3:
            own = _word_hashes(h, first, last)
            found.append(_word_buckets(own))
        low, high = grams.inside(first, last, n)
        size = high - low
        at.append(np.repeat(np.arange(len(words)), size))
        found.append((h >> _SHIFT)[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.int64))
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return np.bincount(at, minlength=len(words)), found[order], own


def fit(sample: list[tuple[str, int]], prior: float = 0.0, epochs: int = 8, rate: float = 0.3, batch: int = 32, seed: int = 5) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias): the logit of class 1 is the bias plus the mean over words of the mean over their buckets.

    ``prior`` is added to the bias. With no rows of one class every document gets ``prior`` plus or minus 4.
    """
    classes = {y for _, y in sample}
    if len(classes) < 2:
        return np.zeros(BUCKETS), 4.0 if classes == {1} else -4.0 if classes else prior
    vocabulary: dict[str, int] = {}
    sequences = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in text.split()), np.int32) for text, _ in sample]
    if not vocabulary:
        return np.zeros(BUCKETS), prior
    known = list(vocabulary)
    parts = [features(known[at : at + 20_000]) for at in range(0, len(known), 20_000)]  # the work arrays are several times the result
    sizes, hashes = np.concatenate([n for n, _, _ in parts]), np.concatenate([h for _, _, h in parts])
    flat = np.concatenate([f.astype(np.int32) for _, f, _ in parts])
    del parts, known, vocabulary
    # bigrams are words of one feature behind the others
    sizes = np.concatenate([sizes, np.ones(PARTS_OF_WORDS, sizes.dtype)])
    behind = len(hashes)
    flat = np.concatenate([flat, np.arange(PARTS_OF_WORDS, BUCKETS, dtype=np.int32)])
    docs = []
    for own in sequences:
        pairs = bigram_buckets(hashes[own[:-1]], hashes[own[1:]]) - PARTS_OF_WORDS + behind
        ids, counts = np.unique(np.concatenate([own, pairs.astype(np.int32)]), return_counts=True)
        docs.append((ids, counts.astype(np.int32)))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(seed)
    e, w, b = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    e_sum, w_sum, b_sum = np.full((BUCKETS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    truth = np.eye(2)[[y for _, y in sample]]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = [i for i in order[at : at + batch] if len(docs[i][0])]
            if not pick:
                continue
            ids, counts = np.concatenate([docs[i][0] for i in pick]), np.concatenate([docs[i][1] for i in pick])
            lengths = np.array([len(docs[i][0]) for i in pick])
            share = counts / np.repeat(np.add.reduceat(counts, np.cumsum(lengths) - lengths), lengths)
            own, back = np.unique(ids, return_inverse=True)
            n = sizes[own]
            where = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            buckets = flat[where]
            vectors = np.add.reduceat(e[buckets], np.cumsum(n) - n) / n[:, None]
            hidden = np.add.reduceat(vectors[back] * share[:, None], np.cumsum(lengths) - lengths)
            z = hidden @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - truth[pick]) / len(pick)
            down = np.repeat(g @ w.T, lengths, axis=0) * share[:, None]
            per_word = np.stack([np.bincount(back, down[:, d], len(own)) for d in range(DIM)], 1) / n[:, None]
            hit, inverse = np.unique(buckets, return_inverse=True)
            spread = np.repeat(per_word, n, axis=0)
            step = np.stack([np.bincount(inverse, spread[:, d], len(hit)) for d in range(DIM)], 1)
            e_sum[hit] += step**2
            e[hit] -= rate * step / np.sqrt(e_sum[hit])
            gw, gb = hidden.T @ g, g.sum(0)
            w_sum += gw**2
            b_sum += gb**2
            w -= rate * gw / np.sqrt(w_sum)
            b -= rate * gb / np.sqrt(b_sum)
    return e.astype(float) @ (w[:, 1] - w[:, 0]), float(b[1] - b[0]) + prior


class Scorer:
    """Logit of whole texts."""

    def __init__(self, buckets: np.ndarray, bias: float) -> None:
        self.buckets, self.bias = buckets, bias

    def __call__(self, text: str | None) -> float:
        words = text.split() if text else []
        if not words:
            return self.bias
        total, last, size, begin = 0.0, None, 0, 0
        for i, w in enumerate(words if len(text) > PART else ()):
            size += len(w) + 1
            if size > PART:
                score, last = self._sum(words[begin : i + 1], last)
                total, size, begin = total + score, 0, i + 1
        total += self._sum(words[begin:], last)[0] if begin < len(words) else 0.0
        return self.bias + total / (2 * len(words) - 1)

    def _sum(self, words: list[str], before: np.ndarray | None) -> tuple[float, np.ndarray]:
        """(summed scores of the words, each the mean over its features, and of their bigrams, hash of the last word).

        ``before``: hash of the word before them. A word's n-grams are side by side, so running sums give them.
        """
        points = grams.spaced(words)
        first, last = grams.places(points)
        for n, h in grams.hashes(points, SHORTEST, LONGEST):
            if n == 3:
                own = _word_hashes(h, first, last)
                score, size = self.buckets[_word_buckets(own)], np.ones(len(first))
            low, high = grams.inside(first, last, n)
            running = np.zeros(len(h) + 1)
            np.cumsum(self.buckets[h >> _SHIFT], out=running[1:])
            low, high = np.minimum(low, len(h)), np.minimum(high, len(h))
            score, size = score + running[high] - running[low], size + (high - low)
        chain = own if before is None else np.concatenate((before, own))
        pairs = self.buckets[bigram_buckets(chain[:-1], chain[1:])].sum()
        return float((score / size).sum() + pairs), own[-1:]


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _trained(documents: DataFrame, labels: DataFrame, folds: int, held_out: int, per_class: int, max_chars: int):
    train = remainder("doc_id", folds) != held_out
    sample = labelled_sample(documents, labels, "quality", train, per_class, max_chars)
    counts = {r["quality"]: r["n"] for r in labels.where(train & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    used = [sum(y == c for _, y in sample) for c in (0, 1)]
    prior = math.log(counts[1] / used[1]) - math.log(counts[0] / used[0]) if all(used) else 0.0
    return documents.sparkSession.sparkContext.broadcast(fit(sample, prior))


def accepted(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``quality_scores`` predicts to be of label 1; one pass, no shuffle.

    Null and empty texts go or stay by the prior's score. Repeated rows are judged one by one, so all go or all stay; an empty table stays empty.
    """
    shared = _trained(documents, labels, folds, held_out, per_class, max_chars)

    def start():
        scorer = Scorer(*shared.value)
        return lambda text: sigmoid(scorer(text)) >= 0.5

    return keep_rows(documents, start, ["text"])


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5) for each row of ``documents``.

    Labels (doc_id, quality) are learned only from rows with crc32(doc_id as text) mod ``folds`` other than ``held_out``,
    at most ``per_class`` of each class with texts of up to ``max_chars`` characters. Null and empty texts get the prior's score; without labels it is 0.5, with one
    class only it is near that class. Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    shared = _trained(documents, labels, folds, held_out, per_class, max_chars)

    def start():
        scorer = Scorer(*shared.value)

        def one(doc_id, text, out):
            score = sigmoid(scorer(text))
            return doc_id, out, score, int(score >= 0.5)

        return one

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder("doc_id", folds) == held_out).alias("held_out"))
    return map_rows(rows, start, "doc_id long, held_out boolean, score double, predicted int")
