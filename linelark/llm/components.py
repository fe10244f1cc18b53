"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table

#: Up to this many edges (4 MB) one task joins them directly; rounds over all tasks give the same roots beyond.
ONE_TASK = 250_000


def roots(n: int, pairs) -> list[int]:
    """For each of 0 to n - 1 the smallest number that ``pairs`` connect it with."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    f = pd.concat(frames)
    codes, ids = pd.factorize(pd.concat([f["u"], f["v"]]), sort=True)
    found = roots(len(ids), zip(codes[: len(f)].tolist(), codes[len(f) :].tolist()))
    yield pd.DataFrame({"node": ids, "root": [ids[r] for r in found]}, dtype="int64")


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int | None = None) -> DataFrame:
    """(node, root): root is the smallest id reachable; one row for each id that occurs in an edge other than a loop.

    Groups are reduced by min before any join, and joins on a hub's key are equi-joins of written tables that adaptive
    execution can split, so a component of any size never meets in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = table(e, "cc")
    seen = _digest(e)
    if 0 < seen[0] <= (ONE_TASK if one_task is None else one_task):
        return table(e.coalesce(1).mapInPandas(_join, "node long, root long"), "cc")
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each minimum is written first: the join then deals both sides anew, and a hub's edges can be split over tasks
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "cc")
        low = table(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).unionAll(low.select("u", "m"))
        e = table(small.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
