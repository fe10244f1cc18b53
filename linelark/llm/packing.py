"""Vector bin packing of tokenised examples into training sequences (dot-product heuristic; Panigrahy et al., 2011).

A sequence has three limits at once: tokens, segments, and tokens that bear loss. Examples of a task wait in a pool of
bounded size. Into the open sequence goes the waiting piece that fits all three and has the largest dot product of its
demand with what is left, both as shares of the limits. When none fits, one is cut so that the sequence is full. What
is left at a task's end goes to sequences whose lengths are powers of two. Tasks pack their own input split in its
order, so nothing is shuffled, memory stays flat, and a task that is run again makes the same pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_schema, small_batches

TOKENS, SEGMENTS, POOL = 1024, 64, 192
#: Loss-bearing tokens of a sequence of instruction data at most.
LOSS = 640
#: Turns of a conversation that are one example.
TURNS = 256


class Packer:
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence, offset) of the examples added; ``flush`` ends the last sequences."""

    def __init__(self, first: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL) -> None:
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss or tokens
        self.sequence, self.pool = first, pool
        self.waiting: list = []  # [doc_id, ids, start, end, doc_tokens, loss-bearing ids before each place]
        self.out: list = []

    def add(self, doc_id, ids: np.ndarray, bearing: np.ndarray | None = None) -> None:
        """``bearing``: which ids bear loss; if it isn't given, all but the last."""
        at, n = 0, len(ids)
        before = None if bearing is None else np.concatenate(([0], np.cumsum(bearing)))
        while n - at >= self.tokens and self.loss >= self.tokens:  # a full sequence by itself
            self._close([[doc_id, ids, at, at + self.tokens, n, before]])
            at += self.tokens
        if at < n:
            self.waiting.append([doc_id, ids, at, n, n, before])
        while len(self.waiting) > self.pool:
            self._fill()

    def flush(self) -> None:
        while sum(w[3] - w[2] for w in self.waiting) >= self.tokens:
            self._fill()
        while self.waiting:
            left = sum(w[3] - w[2] for w in self.waiting)
            self._fill(1 << (left.bit_length() - 1))

    def _bearing(self, w: list) -> int:
        if w[5] is None:
            return max(0, min(w[3], w[4] - 1) - w[2])
        return int(w[5][w[3]] - w[5][w[2]])

    def _within(self, w: list, loss: int) -> int:
        """How many of a piece's first ids bear at most ``loss``."""
        if w[5] is None:
            return loss if w[4] - 1 - w[2] > loss else w[3] - w[2]
        return min(w[3], int(np.searchsorted(w[5], w[5][w[2]] + loss, "right")) - 1) - w[2]

    def _fill(self, size: int | None = None) -> None:
        """Makes one sequence of ``size`` tokens, or of fewer if segments or loss run out first."""
        size = min(size or self.tokens, self.tokens)
        limits = np.array([size, self.segments, self.loss], float)
        demand = np.array([[w[3] - w[2], 1, self._bearing(w)] for w in self.waiting], float)
        left, taken, alive = limits.copy(), [], np.ones(len(self.waiting), bool)
        while left[0] and left[1] and alive.any():
            fits = alive & (demand <= left).all(axis=1)
            last = left[1] == 1  # the last segment had better fill what is left
            if fits.any() and not last:
                product = (demand / self.limits) @ (left / self.limits)
                i = int(np.argmax(np.where(fits, product, -1)))
                piece = self.waiting[i]
            else:
                i = int(np.argmax(np.where(alive, demand[:, 0], -1)))
                room = min(int(left[0]), int(demand[i, 0]))
                if room < left[0]:  # nothing reaches the end: stop at a power of two if that is ahead
                    used = size - int(left[0])
                    stop = 1 << ((used + room).bit_length() - 1)
                    room = stop - used if stop > used else room
                piece = self._cut(i, room, int(left[2]))
                if piece is None:
                    alive[i] = False
                    continue
            alive[i] = False
            taken.append((i, piece))
            left -= [piece[3] - piece[2], 1, self._bearing(piece)]
        self._close([p for _, p in taken])
        gone = {i for i, p in taken if p is self.waiting[i]}
        self.waiting = [w for i, w in enumerate(self.waiting) if i not in gone]

    def _cut(self, i: int, room: int, loss: int) -> list | None:
        """The first ``room`` tokens of a waiting piece, fewer if they bear too much loss; the rest goes on waiting."""
        w = self.waiting[i]
        room = min(room, self._within(w, loss))
        if room <= 0:
            return None
        if w[2] + room >= w[3]:
            return w
        piece = [w[0], w[1], w[2], w[2] + room, w[4], w[5]]
        w[2] += room
        return piece

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, ids, start, end, n, _ in pieces:
            self.out.append((doc_id, start, end - start, zlib.crc32(ids[start:end].tobytes()), n, self.sequence, at))
            at += end - start
        self.sequence += bool(pieces)


def encoder(json_path: str, ranks_path: str | None):
    """text -> unsigned 32-bit ids that the tokenizer in ``json_path`` gives without adding special tokens of its own.

    ``ranks_path``: the same vocabulary as merge ranks. Texts of ASCII, Latin-1 and Latin Extended-A characters, on whose
    classes every Unicode version agrees, go through it because it takes a third of the time; all others, and those in
    which the string of an added token occurs, go through the json.
    """
    import functools

    @functools.cache
    def tokenizer():  # takes much memory, and most tasks do without
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(json_path)

    def plain(text: str) -> np.ndarray:
        return np.array(tokenizer().encode(text, add_special_tokens=False).ids, "<u4")

    if not ranks_path:
        return plain
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(json_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    other = re.compile("|".join(["[^\x00-ſ]", *map(re.escape, added)]))

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return plain(text)
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def pack(documents: DataFrame, json_path: str, ranks_path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids (null text: none), then id 0, which bears no loss. Every id is in exactly one piece;
    a sequence has at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens (default: ``tokens``).
    On documents that limit never binds beside that on tokens; ``pack_conversations`` packs under all three. Repeated rows
    and equal or null doc_ids are packed as rows of their own; other columns are ignored; an empty table
    gives no rows. sequence_id is unique: the task's number in the upper bits, a count in the lower 33.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def example(encode, text):
        return np.append(encode(text or ""), np.zeros(1, "<u4")).astype("<u4"), None

    return _packed(rows, example, json_path, ranks_path, tokens, segments, loss)


def pack_conversations(conversations: DataFrame, json_path: str, ranks_path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, answers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """As ``pack`` for instruction data, with ``part``: TURNS turns of a conversation (conv_id, turn, role, text) are an example, doc_id its conv_id.

    The turns' ids follow one another by turn (ties: by role, then text), each turn's text (null: none) followed by id 0.
    Ids of the roles ``answers`` bear loss, with the id 0 that ends them; all others are prompt and bear none. ``part`` counts
    the examples of a conversation by turn div TURNS, so that one of any length is never gathered whole; start and doc_tokens
    are within the part. Rows without a conv_id or turn are an example of their own each (part null); repeated rows repeat;
    other columns are ignored; an empty table gives no rows.
    """
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text").cast("string").alias("text"))
    part = F.when(F.col("conv_id").isNotNull(), F.floor(F.col("turn") / TURNS).cast("long"))
    own = F.when(part.isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col("conv_id").cast("long").alias("id"), part.alias("part"), own.alias("own"), turn.alias("said"))
    rows = rows.groupBy("id", "part", "own").agg(F.transform(F.array_sort(F.collect_list("said")), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("said"))

    def example(encode, said):
        ids, bearing = [], []
        for turn in said:
            own = np.append(encode(turn["text"] or ""), np.zeros(1, "<u4")).astype("<u4")
            ids.append(own)
            bearing.append(np.full(len(own), turn["role"] in answers))
        return np.concatenate(ids), np.concatenate(bearing)

    keyed = rows.select(F.struct("id", "part").alias("id"), "said")
    return _packed(keyed, example, json_path, ranks_path, tokens, segments, loss).select("doc_id.id", "doc_id.part", "*").drop("doc_id").withColumnRenamed("id", "doc_id")


def _packed(rows: DataFrame, example, json_path: str, ranks_path: str | None, tokens: int, segments: int, loss: int | None) -> DataFrame:
    """``rows``: an id of any type, and what ``example`` makes ids and loss-bearing marks of."""
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    target = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        packer = Packer(TaskContext.get().partitionId() << 33, tokens, segments, loss)

        def made() -> Iterator[pa.RecordBatch]:
            if packer.out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*packer.out), target)], schema=target)
                packer.out = []

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, *example(encode, value))
            yield from made()
        packer.flush()
        yield from made()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)
