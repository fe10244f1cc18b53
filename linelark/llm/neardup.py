"""Near-duplicate documents by a chosen-path set similarity join (Christiani and Pagh, 2017; Christiani et al., 2018).

A document's set holds 64-bit hashes of its word shingles. Equal sets collapse first. Each of ``trees`` independent
trees splits the rest by the minwise token at a coordinate chosen from the path so far. A node with up to ``leaf``
sets is compared exhaustively. In a larger one random pivots are compared with every member; once all members outside
its largest cluster have been pivots, no pair is left that could connect anything. If too many are outside, the node
branches on (1 or 2 children, 1.25 on average = 1 / 0.8, so a pair at the threshold keeps one common child on average).
Paths depend only on a set's own sketch, so branching gathers nothing: only (path, id) rows are shuffled. At the
root every tree keeps a pair of similarity s with probability s, so small nodes miss it with (1 - s) ** trees. Sketches
only propose; full sets confirm each link.

Candidates form groups. A group within ``group_sets`` sets and ``group_hashes`` hashes is settled in one task, all its
pairs by exact intersection. A larger one is dealt in chunks that meet blocks of pivots: random ones first, then
every member that is not yet in the group's largest component. What is not compared is connected already, and a huge
group of copies never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots as _roots
from .scratch import arrow_schema, small_batches, table
from .shingles import mix, shingle_set, text_buffers

COORDINATES = 128
#: Allowed error of a similarity estimated from the sketch: over four standard deviations at 0.8.
SLACK = 0.15
#: Ids up to this number are broadcast (16 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Levels between two counts of a large node, and the deepest level.
STEP, DEEPEST = 3, 48
#: Random pivots of a large node or group, pivots of one block, members of one chunk and hashes of one chunk or block.
PIVOTS, BLOCK, CHUNK, CHUNK_HASHES = 64, 512, 1024, 1_000_000

_rng = np.random.default_rng(71)
_XOR = _rng.integers(0, 2**32, (COORDINATES, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, (COORDINATES, 1), dtype=np.uint32) | np.uint32(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minwise token at each coordinate."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, ((x[at : at + 4096] ^ _XOR) * _MUL).min(axis=1), out=low)
    return low


def _path(key: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + (coordinate.astype(np.uint64) << np.uint64(32)) + token.astype(np.uint64))


def sketches(documents: DataFrame, k: int, trees: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (a 128-bit fingerprint of the set), paths (root child of each tree), sketch."""
    schema = "doc_id long, n long, f1 long, f2 long, paths array<long>, sketch binary"
    target, roots = arrow_schema(documents.sparkSession, schema), np.arange(trees, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, paths, made = [], [], [], [], []
            for buffer in text_buffers(batch.column(1)):
                s = shingle_set(buffer, k) if buffer is not None else np.empty(0, np.uint64)
                n.append(len(s))
                if not len(s):
                    f1.append(None), f2.append(None), paths.append(None), made.append(None)
                    continue
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)))
                low = sketch(s)
                paths.append(_path(roots, roots, low[np.arange(trees) % COORDINATES]).view(np.int64))
                made.append(low.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())] + [pa.array(c, f.type) for c, f in zip((n, f1, f2, paths, made), list(target)[1:])], schema=target)

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _deeper(rows: DataFrame) -> DataFrame:
    """(node, path, sketch) to (node, path) STEP levels down; which coordinates are chosen depends on the path alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            low = np.frombuffer(b"".join(f["sketch"]), np.uint32).reshape(len(f), COORDINATES)
            at, key = np.arange(len(f)), f["path"].to_numpy().astype(np.int64).view(np.uint64)
            for _ in range(STEP):
                children = []
                for child in (0, 1):
                    h = mix(key + np.uint64(0x632BE59BD9B4E019 + child))
                    keep = slice(None) if not child else (h >> np.uint64(33)) % np.uint64(4) == 0
                    c = (h[keep] & np.uint64(0xFFFF)) % np.uint64(COORDINATES)
                    children.append((at[keep], _path(key[keep] + np.uint64(child), c, low[at[keep], c.astype(int)])))
                at, key = np.concatenate([c[0] for c in children]), np.concatenate([c[1] for c in children])
            yield pd.DataFrame({"node": f["node"].to_numpy()[at], "path": key.view(np.int64)}).drop_duplicates()

    return rows.select("node", "path", "sketch").mapInPandas(run, "node long, path long")


def _agreement(low: np.ndarray) -> np.ndarray:
    """Share of coordinates at which each two sketches agree."""
    m = len(low)
    out = np.zeros((m, m), np.int32)
    for at in range(0, COORDINATES, 16):
        part = low[:, at : at + 16]
        out += (part[:, None, :] == part[None, :, :]).sum(axis=2, dtype=np.int32)
    return out / COORDINATES


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, trees: int = 16, leaf: int = 128, group_sets: int = 1024, group_hashes: int = 2_000_000) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``k``-word shingles (A-Z in
    lower case; words split at ASCII white space); component_id is the smallest doc_id reachable and kept marks it.
    Null or wordless text: n_shingles 0, linked with nothing. Repeated rows repeat; rows that share a doc_id are linked with each
    other, whatever their texts, and n_shingles is that of the row's text. A null doc_id takes no part: component_id null,
    kept true. An empty table gives no rows.
    """
    all_docs = table(sketches(documents, k, trees), "sketches")
    sets = all_docs.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    sets = table(sets, "sets")
    labels = _group(documents, sets, k, percent, leaf, group_sets, group_hashes)
    changed = sets.join(labels, "node", "left").where("copies > 1 or component is not null").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    out = all_docs.drop("paths", "sketch").join(changed, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).cast("long").alias("component_id"))
    out = _one_component_an_id(all_docs, out)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_component_an_id(all_docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` (doc_id, n_shingles, component_id) with components joined that hold rows of the same doc_id."""
    ids = all_docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("a"), F.max(F.struct("f1", "f2")).alias("b"))
    shared = table(ids.where("a <> b").select("doc_id"), "shared")
    if shared.isEmpty():
        return out
    out = table(out, "rows")
    merged = components(_among(out.withColumnRenamed("doc_id", "node"), shared.withColumnRenamed("doc_id", "node")), "node", "component_id")
    merged = _checked(merged.withColumnRenamed("node", "component_id"))
    return out.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def representatives(documents: DataFrame, **limits) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``near_duplicates`` keeps: one document of each group, and all without an id.

    Repeated rows of a document that stays all stay; null and wordless texts stay; an empty table stays empty.
    """
    name = "gone"
    while name in documents.columns:
        name += "_"
    gone = table(near_duplicates(documents, **limits).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return documents.join(_checked(gone), F.col("doc_id") == F.col(name), "left_anti")


def _group(documents: DataFrame, sets: DataFrame, k: int, percent: int, leaf: int, group_sets: int, group_hashes: int) -> DataFrame:
    """(node, component) of the sets that are linked with another."""
    spark = documents.sparkSession
    threshold = percent / 100 - SLACK
    lists, edges = _leaves(sets, leaf, threshold)
    rows = _among(sets.select("node", "sketch"), lists.select(F.explode("nodes").alias("node")).distinct())
    rows = lists.select("list", F.explode("nodes").alias("node")).join(rows, "node")
    members = rows.groupBy("list").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    edges.append(members.select("members").mapInPandas(_compare(threshold), "a long, b long"))
    found = edges[0]
    for e in edges[1:]:
        found = found.unionAll(e)
    groups = components(found)
    if groups.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    groups = groups.join(sets.groupBy("node").agg(F.sum("n").alias("n")), "node")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    above = table(sizes.where((F.col("size") > group_sets) | (F.col("total") > group_hashes)), "above")
    groups = table(groups.join(_checked(above), "root", "left").select("node", "root", "size", "total", F.col("size").isNotNull().alias("large")), "groups")
    with_sets = _sets_of(documents, groups, k)
    if above.isEmpty():
        return _settle(with_sets, percent)
    with_sets = table(with_sets, "texts")
    return _settle(with_sets.where("not large"), percent).unionAll(_pivoted(with_sets.where("large"), percent))


def _leaves(sets: DataFrame, leaf: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """The distinct member lists (list, nodes) of all trees' nodes of 2 to ``leaf`` sets, and the edges found in larger nodes."""
    level, lists, depth, hot, edges = sets.select("node", F.explode("paths").alias("path")), None, 1, None, []
    while True:
        sizes = table(level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        # the few keys of large nodes are told apart first, so that only small nodes are gathered by their path
        above = _checked(sizes.where(F.col("size") > leaf))
        below = level.join(above, "path", "left_anti").join(sizes, "path")
        small = table(below.groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").distinct(), "small")
        lists = small if lists is None else lists.unionAll(small)
        large = level.join(above, "path")
        if large.isEmpty():
            break
        if hot is None:
            hot = table(_among(sets.select("node", F.col("sketch").alias("value")), large.select("node").distinct()), "hot")
        rows = table(large.join(hot, "node").select(F.col("path").alias("key"), "size", "node", "value"), "rows")
        rows = rows.withColumn("chunks", F.ceil(F.col("size") / CHUNK))
        chosen = F.pmod(F.xxhash64("node", "key"), F.col("size")) < PIVOTS
        edges.append(table(_against(rows, rows.where(chosen).withColumn("blocks", F.lit(1)), _alike(threshold)), "edges"))
        outside = table(_outside(rows, edges).where(~chosen), "outside")
        counts = table(outside.groupBy("key").agg(F.count("*").alias("left")), "counts")
        few = F.lit(True) if depth > DEEPEST else F.col("left") <= BLOCK
        pivots = outside.join(_checked(counts.where(few)), "key").withColumn("blocks", F.ceil(F.col("left") / BLOCK))
        edges.append(table(_against(rows.join(_checked(counts.where(few)), "key", "left_semi"), pivots, _alike(threshold)), "edges"))
        level = table(_deeper(rows.join(_checked(counts.where(~few)), "key", "left_semi").select("node", F.col("key").alias("path"), F.col("value").alias("sketch"))).distinct(), "level")
        depth += STEP
    return table(lists.where(F.size("nodes") > 1).distinct().withColumn("list", F.monotonically_increasing_id()), "lists"), edges


def _outside(rows: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """``rows`` (key, node, ...) that are not in the largest cluster of their key, clusters being what ``edges`` connect."""
    found = edges[0]
    for e in edges[1:]:
        found = found.unionAll(e)
    own = table(rows.join(components(found), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "parts")
    counts = own.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    return own.join(_checked(table(counts, "largest")), "key").where("part <> largest").drop("part", "largest")


def _against(members: DataFrame, pivots: DataFrame, compare) -> DataFrame:
    """Edges that ``compare`` finds between pivots and members (key, node, value, chunks) of the same key.

    Members of a key are dealt to its chunks, its pivots to ``blocks``, and every chunk meets every block in a row of its own.
    """
    blocks = _checked(table(pivots.groupBy("key").agg(F.max("blocks").alias("blocks")), "blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    own = members.join(blocks, "key").select("key", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), each(F.col("blocks")).alias("block"), "node", "value", F.lit(False).alias("pivot"))
    met = pivots.select("key", each(F.col("chunks")).alias("chunk"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "value", F.lit(True).alias("pivot"))
    groups = own.unionAll(met).groupBy("key", "chunk", "block").agg(F.collect_list(F.struct("node", "value", "pivot")).alias("members"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = [], []
            for members in f["members"]:
                pivots = [m for m in members if m["pivot"]]
                others = [m for m in members if not m["pivot"]]
                if pivots and others:
                    both, n = [m["node"] for m in pivots + others], len(pivots)
                    for i, r in enumerate(_roots(len(both), [(int(i), n + int(j)) for i, j in compare(pivots, others)])):
                        if r != i and both[r] != both[i]:
                            a.append(both[i]), b.append(both[r])
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()

    return groups.select("members").mapInPandas(run, "a long, b long")


def _alike(threshold: float):
    def compare(pivots: list, others: list) -> Iterator[tuple[int, int]]:
        low = np.frombuffer(b"".join(m["value"] for m in others), np.uint32).reshape(len(others), COORDINATES)
        for i, p in enumerate(pivots):
            for j in np.flatnonzero((low == np.frombuffer(p["value"], np.uint32)).sum(axis=1) >= threshold * COORDINATES):
                yield i, j

    return compare


def _sharing(percent: int):
    """Exact links: shared hashes of all pivots are counted for each member at once, from the pivots' postings."""

    def compare(pivots: list, others: list) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(m["value"], np.uint64) for m in pivots]
        size = np.array([len(s) for s in sets])
        order = np.argsort(hashes := np.concatenate(sets), kind="stable")
        hashes, holder = hashes[order], np.repeat(np.arange(len(sets)), size)[order]
        for j, m in enumerate(others):
            own = np.frombuffer(m["value"], np.uint64)
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            lengths = high - low
            picks = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            both = np.bincount(holder[picks], minlength=len(sets))
            for i in np.flatnonzero(100 * both >= percent * (len(own) + size - both)):
                yield i, j

    return compare


def _pivoted(rows: DataFrame, percent: int) -> DataFrame:
    """Exact components of groups too large for one task (root, node, size, total hashes, hashes)."""
    rows = rows.select(F.col("root").alias("key"), "node", F.col("hashes").alias("value"), "size", "total", F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("total") / CHUNK_HASHES)).alias("chunks"))
    share = F.least(4 * PIVOTS / F.col("size"), CHUNK_HASHES / F.col("total"))
    chosen = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)
    links = [table(_against(rows, rows.where(chosen).withColumn("blocks", F.lit(1)), _sharing(percent)), "links")]
    outside = table(_outside(rows, links).where(~chosen), "outside")
    counts = outside.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("value")) / (8 * CHUNK_HASHES))).alias("blocks"))
    links.append(table(_against(rows, outside.join(_checked(counts), "key"), _sharing(percent)), "links"))
    return components(links[0].unionAll(links[1])).select("node", F.col("root").alias("component"))


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose node is in ``nodes`` (distinct ids), by a broadcast only if their number is within BROADCAST_IDS."""
    return rows.join(_checked(nodes), "node", "left_semi")


def _checked(narrow: DataFrame) -> DataFrame:
    """``narrow`` (rows of a few numbers) to be broadcast if it has at most BROADCAST_IDS rows; else it is joined by a shuffle."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_IDS else narrow


def _compare(threshold: float):
    """Within each list, (a, b) from every member to the smallest one that sketches connect it with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = [], []
            for members in f["members"]:
                members = sorted(members, key=lambda m: m["node"])
                low = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint32).reshape(len(members), COORDINATES)
                near = np.triu(_agreement(low) >= threshold, 1)
                for i, r in enumerate(_roots(len(members), np.argwhere(near).tolist())):
                    if r != i:
                        a.append(members[i]["node"]), b.append(members[r]["node"])
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()

    return run


def _sets_of(documents: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``nodes`` with the whole set of each, from a second pass over the texts of just those documents."""
    schema = "node long, hashes binary"
    target = arrow_schema(documents.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(b, k).tobytes() if b is not None else b"" for b in text_buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, target.field(1).type)], schema=target)

    texts = _among(documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")), nodes.select("node"))
    return texts.mapInArrow(run, schema).where(F.length("hashes") > 0).join(nodes, "node")


def _settle(rows: DataFrame, percent: int) -> DataFrame:
    """Exact components of bounded groups (root, node, hashes): every pair of a group's sets is counted."""

    def one(members: list) -> tuple[list, list]:
        members = sorted(members, key=lambda m: m["node"])
        node, sets = [m["node"] for m in members], [np.frombuffer(m["hashes"], np.uint64) for m in members]
        size = np.array([len(s) for s in sets])
        same: dict = {}
        pairs = [(same.setdefault(x, i), i) for i, x in enumerate(node)]  # rows that share an id are one document
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
        starts = np.concatenate(([0], np.cumsum(np.bincount(token))))
        at = np.concatenate(([0], np.cumsum(size)))
        for i in range(len(sets)):
            own = token[at[i] : at[i + 1]]
            lengths = starts[own + 1] - starts[own]
            picks = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            both = np.bincount(holder[picks], minlength=len(sets))
            pairs += [(i, j) for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)).tolist() if j > i]
        return node, [node[r] for r in _roots(len(sets), pairs)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(m) for m in f["members"]]
            yield pd.DataFrame({"node": [x for m in made for x in m[0]], "component": [x for m in made for x in m[1]]}, dtype="int64").drop_duplicates()

    groups = rows.groupBy("root").agg(F.collect_list(F.struct("node", "hashes")).alias("members"))
    return groups.select("members").mapInPandas(run, "node long, component long")
