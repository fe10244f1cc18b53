"""Exact top-k inner products over norm-sorted vectors (after Teflioudi and Gemulla, 2015; Li et al., 2017).

Vectors are range-partitioned and sorted by descending length. A query's first threshold comes from the longest vectors of
the table; vectors too short to reach any query's threshold are never read, as the scan skips their row groups. Queries, in
blocks of bounded size, walk each part from its longest vector on; a chunk is left alone where length times query length
cannot reach the k-th best score known so far, before anything is rotated. What passes is scored on the first SVD-rotated
dimensions and kept only if that partial sum plus the Cauchy-Schwarz bound of the residuals can still reach it. Survivors
are scored in whole integers, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import arrow_schema, small_batches, table

#: Bytes of queries broadcast at once, queries and vectors that meet in one block of scores, longest vectors that give first thresholds, leading dimensions.
QUERY_BYTES, QUERIES, CHUNK, HEAD, LEADING = 16 << 20, 4096, 512, 512, 16
LEAST, MOST = -(2**63), 2**63 - 1
PARTIAL = "query_id long, vec_id long, score long, below boolean"


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<double>, v array<long>, norm2 long): v is floor(scale * x), norm2 its squared length.

    Left out: null vectors, empty ones, those with a null or non-finite component, and rows without an id. v and norm2 are
    null if a component is so large that products of such vectors may not fit a long (2 ** 31 over the root of the number
    of components, after scaling).
    """
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = rows.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    small = F.forall("x", lambda c: F.abs(c) < F.sqrt(F.lit(2.0**62) / F.size("x")) / scale)
    rows = rows.withColumn("v", F.when(small, F.transform("x", lambda c: F.floor(c * scale).cast("long"))))
    return rows.withColumn("norm2", F.when(F.col("v").isNotNull(), F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by ``every``; candidates are all vectors with another id and as many
    components. Vectors with null, non-finite or no components take no part. Vectors of huge components (see
    ``quantised``) are scored in Python integers; ArithmeticError if a score of the answer does not fit a long. Other columns
    are ignored. Repeated rows of a query id are asked once (the smallest vector); repeated candidate rows each count. An
    empty table gives no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    # x is kept where there is no v only, before rows are dealt
    every_row = quantised(embeddings, scale).withColumn("x", F.when(F.col("v").isNull(), F.col("x")))
    sorted_rows = every_row.repartitionByRange(F.desc_nulls_first("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc_nulls_first("norm2"), "vec_id")
    all_rows = table(sorted_rows, "vectors")
    vectors, huge = all_rows.where(F.col("v").isNotNull()), all_rows.where(F.col("v").isNull())
    asked = all_rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.coalesce("x", F.transform("v", lambda c: c.cast("double"))).alias("order"), "v", "x")).alias("q"))
    asked = table(asked.select("vec_id", "q.v", "q.x", F.size(F.coalesce("q.v", "q.x")).alias("size")), "queries")
    some_huge = not huge.isEmpty()
    found = []
    for size in [r["size"] for r in asked.select("size").distinct().sort("size").collect()]:
        same, own = vectors.where(F.size("v") == size), asked.where(F.col("size") == size)
        rotation = _rotation(same, size)
        head = same.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).collect()
        blocks = max(1, -(-own.count() * size * 8 // query_bytes))
        for block in range(blocks):
            rows = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
            plain, large = [r for r in rows if r["v"] is not None], [r for r in rows if r["v"] is None]
            partial = []
            if plain and head:
                ids, q = np.array([r["vec_id"] for r in plain], np.int64), np.array([r["v"] for r in plain], np.int64)
                partial.append(_search(same, ids, q, _first(ids, q, head, k), rotation, k))
            if some_huge:
                with_size = F.size(F.coalesce("v", "x")) == size
                partial.append(_in_integers(huge.where(with_size), plain, k, scale))
                partial.append(_in_integers(all_rows.where(with_size), large, k, scale))
            for i, p in enumerate(partial[1:]):
                partial[0] = partial[0].unionAll(p)
            best = Window.partitionBy("query_id").orderBy("below", F.desc("score"), "vec_id")
            for ranked in [p.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) for p in partial[:1]]:
                score = F.when(F.col("below"), F.raise_error(F.lit("a score of the answer does not fit a long")).cast("long")).otherwise(F.col("score")) if some_huge else F.col("score")
                ranked = ranked.select("query_id", "rank", "vec_id", score.alias("score"))
                found.append(ranked if blocks == 1 else table(ranked, "top"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for f in found:
        out = out.unionAll(f)
    return out


def _rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of the whole table, from the sum of each task's Gram matrix (size * size numbers a task)."""
    n = size * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, size).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total.ravel())], names=["at", "x"])

    sums = vectors.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(n)
    for r in sums:
        gram[r["at"]] = r["x"]
    return np.linalg.eigh(gram.reshape(size, size))[1][:, ::-1].copy()


def _first(ids: np.ndarray, q: np.ndarray, head: list, k: int) -> np.ndarray:
    """The k-th best score of each query among the longest vectors: no answer is below it."""
    v, own = np.array([r["v"] for r in head], np.int64), np.array([r["vec_id"] for r in head])
    out = []
    for at in range(0, len(q), QUERIES):
        scores = np.where(own[None, :] == ids[at : at + QUERIES, None], LEAST, _products(q[at : at + QUERIES], v))
        out.append(np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), LEAST))
    return np.concatenate(out)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of both."""
    if not a.size or not b.size or a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    starts = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    return list(zip(sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)]))


def shortest(length: np.ndarray, floor: np.ndarray) -> int:
    """The least squared length of a vector that can reach the floor of some query of these lengths."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(floor > 0, floor / length, 0.0)
    return int(max(0.0, np.nanmin(least) ** 2 * (1 - 1e-9) - 1)) if len(least) else 0


def _search(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int) -> DataFrame:
    spark = vectors.sparkSession
    target, size = arrow_schema(spark, PARTIAL), q.shape[1]
    shared = spark.sparkContext.broadcast((ids, q, floor, rotation))
    cut = shortest(np.sqrt((q.astype(float) ** 2).sum(1)), floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor, rotation = shared.value
        floor = floor.copy()
        lead = min(LEADING, size)
        rotated = q @ rotation
        length, rest = np.sqrt((rotated**2).sum(1)), np.sqrt((rotated[:, lead:] ** 2).sum(1))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        for b in batches:
            every, norms = np.asarray(b.column(1).flatten()).reshape(-1, size), np.sqrt(np.asarray(b.column(2)).astype(float))
            for at in range(0, len(every), CHUNK):
                # by length alone, before anything is rotated; a slack of 1e-9 of the product of lengths covers rounding
                longest = norms[at : at + CHUNK].max()
                everyone = np.flatnonzero(length * longest * (1 + 1e-9) + 1e-6 >= floor)
                if not len(everyone):
                    continue
                v, own = every[at : at + CHUNK], np.asarray(b.column(0))[at : at + CHUNK]
                r = v @ rotation
                tail = np.sqrt((r[:, lead:] ** 2).sum(1))
                for begin in range(0, len(everyone), QUERIES):
                    alive = everyone[begin : begin + QUERIES]
                    bound = rotated[alive, :lead] @ r[:, :lead].T
                    bound += rest[alive, None] * tail[None, :] + (1e-9 * length[alive, None] * longest + 1e-6)
                    may = bound >= floor[alive, None]
                    some_q, some_v = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                    if not len(some_q):
                        continue
                    # whole products of what is left, in one block; doubles are exact below 2 ** 53
                    asked = alive[some_q]
                    exact = _products(q[asked], v[some_v])
                    hit_q, hit_v = np.nonzero(may[np.ix_(some_q, some_v)] & (exact >= floor[asked, None]) & (own[some_v][None, :] != ids[asked, None]))
                    for at_q, start, end in _runs(hit_q):
                        i, c = asked[at_q], hit_v[start:end]
                        score = np.concatenate([best[i][0], exact[at_q, c]])
                        ident = np.concatenate([best[i][1], own[some_v[c]]])
                        order = np.lexsort((ident, -score))[:k]
                        best[i] = (score[order], ident[order])
                        if len(order) == k:
                            floor[i] = max(floor[i], score[order][-1])
        rows = [(i, e, s, False) for i, (score, ident) in zip(ids.tolist(), best) for e, s in zip(ident.tolist(), score.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return vectors.where(F.col("norm2") >= cut).select("vec_id", "v", "norm2").mapInArrow(run, PARTIAL)


def _whole(v: list | None, x: list | None, scale: int) -> list[int]:
    """floor(scale * x) as Python integers; doubles from 2 ** 53 on are whole numbers themselves."""
    return v if v is not None else [int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale) for c in x]


def _in_integers(vectors: DataFrame, queries: list, k: int, scale: int) -> DataFrame:
    """As ``_search`` for vectors (vec_id, v or x) and queries of any size, one by one; ``below`` marks scores below a long."""
    spark = vectors.sparkSession
    target = arrow_schema(spark, PARTIAL)
    shared = spark.sparkContext.broadcast([(r["vec_id"], _whole(r["v"], r["x"], scale)) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {i: [] for i, _ in shared.value}
        for b in batches:
            for c, v, x in zip(*(b.column(j).to_pylist() for j in range(3))):
                own = _whole(v, x, scale)
                for i, q in shared.value:
                    if i != c:
                        best[i].append((-sum(p * r for p, r in zip(q, own)), c))
            best = {i: sorted(found)[:k] for i, found in best.items()}
        rows = [(i, c, max(-s, LEAST), -s < LEAST) for i, found in best.items() for s, c in found]
        if any(s > MOST for _, _, s, _ in rows):
            raise ArithmeticError("a score of the answer does not fit a long")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return vectors.select("vec_id", "v", "x").mapInArrow(run, PARTIAL)
