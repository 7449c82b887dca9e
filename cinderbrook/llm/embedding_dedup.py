"""Embedding near-dedup by a forest of random-projection trees.

Vectors of one length grow a forest of their own. A tree splits a node by a random projection near its median, and vectors within
a margin of the cut go down both sides. Trees grow in Spark, a few levels a round: the cuts of a node come from a bounded sample
of its vectors, and each vector is then sent down. Nodes become leaves when they are small, or when a split would send so many
down both sides that it saves no comparisons, so leaves stay as small as the data allow whatever the size of the table.

Vectors are compared within their leaves in double precision, large leaves in tiles. A pair that meets in several leaves counts in
the first of them only, so that links are counted without being written out; a leaf returns link counts and a spanning forest,
which components then unite. Equal vectors are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_batches, join_counted
from .components import connected_components
from .tiles import runs, tiled

THRESHOLD = 0.9
TREES = 5
#: Vectors that a node is split beyond.
LEAF = 1_024
#: Levels that trees grow in a round.
LEVELS = 4
#: Vectors that the cuts of a node's next levels come from, about; of a small node one in SAMPLE_PART.
SAMPLE = 2_048
SAMPLE_PART = 4
#: Random directions tried for a split; the one with the fewest sampled vectors around the cut is taken.
DIRECTIONS = 4
#: Part of a node's vectors that may go down both sides; beyond sqrt(2) - 1 the halves cost more than the node.
MOST_SPILL = 0.4
#: Half-width of the overlap, in standard deviations of how far the farthest linked pair lies apart in projection.
OVERLAP = 0.5
#: Rows of a leaf that a task compares; larger leaves are tiled.
TILE_ROWS = 4_000
#: Rows of a block of the matrix of cosines.
BLOCK = 1_024

NODE = ["tree", "width", "node"]


def directions(seed: int, tree: int, width: int, node: int) -> np.ndarray:
    """The unit vectors that a node's split is chosen from; the same wherever they are drawn."""
    drawn = np.random.default_rng([seed, tree, width, node]).standard_normal((DIRECTIONS, width))
    return drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-12)


def margin_of(width: int, threshold: float, overlap: float) -> float:
    return overlap * math.sqrt(max(0.0, 2 - 2 * threshold) / width)


def grow(sample: np.ndarray, rows: int, seed: int, tree: int, node: int, leaf: int, margin: float, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(choices, cuts) of the splits below a node of `rows` vectors, as its sample shows, in the order of `below`; choice -1: none."""
    choices, cuts = np.full(1 << levels, -1, np.int8), np.zeros(1 << levels)
    waiting = [(1, np.arange(len(sample)))]
    while waiting:
        at, held = waiting.pop()
        if at >> levels or len(held) < 2 or len(held) * rows <= leaf * len(sample):
            continue
        along = sample[held] @ directions(seed, tree, sample.shape[1], below(node, at)).T
        middle = np.median(along, axis=0)
        spill = (np.abs(along - middle) < margin).mean(axis=0)
        choice = int(spill.argmin())
        if spill[choice] > MOST_SPILL:
            continue
        side, choices[at], cuts[at] = along[:, choice], choice, middle[choice]
        waiting += [(2 * at, held[side < cuts[at] + margin]), (2 * at + 1, held[side >= cuts[at] - margin])]
    return choices, cuts


def below(node: int, at: int) -> int:
    """The node that is `at` in the subtree of `node`; in both, the root is 1 and the children of n are 2n and 2n + 1."""
    depth = at.bit_length() - 1
    return (node << depth) + at - (1 << depth)


def descend(vectors: np.ndarray, choices: np.ndarray, cuts: np.ndarray, seed: int, tree: int, node: int, margin: float) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) of the nodes without a split that the vectors come to from `node`: more than one where they are near a cut."""
    waiting = [(1, np.arange(len(vectors)))]
    while waiting:
        at, rows = waiting.pop()
        if at >= len(choices) or choices[at] < 0:
            yield below(node, at), rows
            continue
        along = vectors[rows] @ directions(seed, tree, vectors.shape[1], below(node, at))[choices[at]] - cuts[at]
        for child, chosen in ((2 * at, along < margin), (2 * at + 1, along >= -margin)):
            if chosen.any():
                waiting.append((child, rows[chosen]))


def usable_vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """The rows of a list column as bytes; null for those that are null, empty or zero or hold null or non-finite components."""
    numbers = column.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # nulls become nan; no negative zeros
    offsets = column.offsets.to_numpy()
    found: list[bytes | None] = []
    for low, high, valid in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist()):
        vector = numbers[low:high]
        found.append(vector.tobytes() if valid and high > low and np.isfinite(vector).all() and vector.any() else None)
    return found


def units(stored: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one length stored as bytes."""
    vectors = np.frombuffer(b"".join(x.as_py() for x in stored), kind).reshape(len(stored), -1).astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def earlier_leaves(lists: list[list[int]], here: int) -> np.ndarray:
    """A bit set per row of the leaves before `here` that it shares with another row."""
    sizes = [len(x) for x in lists]
    rows, codes = np.repeat(np.arange(len(lists)), sizes), np.fromiter((c for x in lists for c in x), np.int64, sum(sizes))
    before = codes < here
    rows, codes = rows[before], codes[before]
    _, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    bits = np.zeros((len(lists), 64 * max(1, -(-int((times > 1).sum()) // 64))), np.uint8)
    bits[rows[shared], number[place[shared]]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the smallest row of each row's component) after the links between the rows i and j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def leaf_links(vectors: np.ndarray, weights: np.ndarray, lists: list[list[int]], here: int, threshold: float, chunk_of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row that first meet here, the smallest row of each row's component by the links here).

    weights: how many equal vectors a row stands for. lists: each row's leaves. chunk_of: in a tile of two chunks, the rows'
    chunks; pairs within a chunk have a tile of their own.
    """
    counts, root, seen = np.zeros(len(vectors), np.int64), np.arange(len(vectors)), None
    for a in range(0, len(vectors), BLOCK):
        for b in range(a, len(vectors), BLOCK):
            i, j = np.nonzero(vectors[a : a + BLOCK] @ vectors[b : b + BLOCK].T >= threshold)
            i, j = i + a, j + b
            once = i < j if chunk_of is None else (i < j) & (chunk_of[i] != chunk_of[j])
            i, j = i[once], j[once]
            if not len(i):
                continue
            root = unite(root, i, j)
            seen = earlier_leaves(lists, here) if seen is None else seen
            step = max(1, (1 << 22) // seen.shape[1])
            for low in range(0, len(i), step):
                p, q = i[low : low + step], j[low : low + step]
                first = ~(seen[p] & seen[q]).any(axis=1)
                np.add.at(counts, p[first], weights[q[first]])
                np.add.at(counts, q[first], weights[p[first]])
    return counts, root


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, overlap: float = OVERLAP, tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE, seed: int = 7) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other vectors linked directly (copies included); component_id is the smallest id that links reach; kept is
    id = component_id. Vectors of different lengths don't link; those that are null, empty or zero or hold null or non-finite
    components link with nothing. Rows that repeat an id count as vectors of their own; rows without an id link, but don't name a
    component unless it has no id. An empty table gives an empty result; other columns aren't read.
    """
    scratch = Scratch(df.sparkSession, "embeddings")
    element = df.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def stored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(usable_vectors(batch.column(1), kind), pa.binary())], names=["id", "vector"])

    rows = scratch.keep(source.mapInArrow(stored, "id long, vector binary"), "rows")
    distinct = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.keep(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    placed = leaves(scratch, distinct, kind, trees, leaf, threshold, overlap, sample_rows, seed)
    links, counts = compare_leaves(scratch, distinct, placed, kind, threshold, tile_rows)
    labels = scratch.keep(connected_components(scratch, links), "labels")
    own = distinct.join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    own = own.select("vector", "least_id", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    least = own.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    own, least = scratch.keep(own, "own"), scratch.keep(least, "least")
    named = scratch.keep(join_counted(own, least, ["component"], "size").select("vector", "copies", "n_links", "component_id"), "named")
    for label in ("distinct", "labels", "own", "least", "met"):
        scratch.drop(label)
    linked = join_counted(rows.where("vector is not null"), named, ["vector"], "copies").select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = linked.unionByName(alone)
    return found.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def leaves(scratch: Scratch, distinct: DataFrame, kind: str, trees: int, leaf: int, threshold: float, overlap: float, sample_rows: int, seed: int) -> DataFrame:
    """(key, leaf, width): the leaves of each vector, in all trees; a leaf's number is a hash of its tree, length and node."""
    item = int(kind[-1])
    root = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), (F.octet_length("vector") / item).cast("int").alias("width"), F.lit(1).cast("long").alias("node"), "key", "vector")
    split_schema = "tree int, width int, node long, n long, choices binary, cuts binary, splits boolean"
    row_schema = "tree int, width int, node long, key long, vector binary"
    names = ["tree", "width", "node", "key", "vector"]

    def grown(table: pa.Table) -> pa.Table:
        tree, width, node, n = (table[c][0].as_py() for c in (*NODE, "n"))
        # in a fixed order, so that a task that is run again draws the same cuts
        sample = units(table.sort_by("key")["vector"].combine_chunks(), kind)
        choices, cuts = grow(sample, n, seed, tree, node, leaf, margin_of(width, threshold, overlap))
        arrays = [pa.array([choices.tobytes()]), pa.array([cuts.tobytes()]), pa.array([bool(choices[1] >= 0)])]
        return pa.table([table[c][:1] for c in (*NODE, "n")] + arrays, names=[*NODE, "n", "choices", "cuts", "splits"])

    def sent_down(batches):
        def work(table: pa.Table):
            (tree, width, node, choices, cuts), margin = (table[c][0].as_py() for c in (*NODE, "choices", "cuts")), margin_of(table["width"][0].as_py(), threshold, overlap)
            vectors = units(table["vector"].combine_chunks(), kind)
            for child, rows in descend(vectors, np.frombuffer(choices, np.int8), np.frombuffer(cuts), seed, tree, node, margin):
                some = table.take(pa.array(rows))
                yield pa.table([some["tree"], some["width"], pa.array(np.full(len(rows), child, np.int64)), some["key"], some["vector"]], names=names)

        for batch in batches:  # sorted by node: a batch has few of them
            for table in runs(iter([batch]), NODE, work):
                yield from table.to_batches()

    done, waiting, turn = [], root, 0
    while True:
        counts = scratch.keep(waiting.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")), f"counts-{turn}")
        large = counts.where(F.col("n") > leaf)
        chosen = join_counted(waiting, large, NODE, "n").where(F.pmod(F.xxhash64(F.lit(seed), "key", *NODE), F.col("n")) < F.least(F.lit(sample_rows), F.ceil(F.col("n") / SAMPLE_PART)))
        splits = scratch.keep(chosen.groupBy(*NODE).applyInArrow(grown, split_schema), f"splits-{turn}").where("splits")
        still = counts.join(splits.select(*NODE), NODE, "left_anti")
        done.append(scratch.keep(join_counted(waiting, still, NODE, "n").select(*NODE, "key"), f"done-{turn}"))
        if not splits.limit(1).count():
            break
        below = join_counted(waiting, splits, NODE, "n").select(*names, "choices", "cuts").sortWithinPartitions(*NODE).mapInArrow(sent_down, row_schema)
        waiting = scratch.keep(below, f"waiting-{turn}")
        for label in ("counts", "splits", "waiting"):
            scratch.drop(f"{label}-{turn - 1}")
        turn += 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    placed = scratch.keep(every.select("key", F.xxhash64(*NODE).alias("leaf"), "width"), "leaves")
    for k in range(turn + 1):
        for label in ("counts", "splits", "waiting", "done"):
            scratch.drop(f"{label}-{k}")
    return placed


def compare_leaves(scratch: Scratch, distinct: DataFrame, placed: DataFrame, kind: str, threshold: float, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) by key, counts (key, n_links))."""

    def compared(batches):
        def work(table: pa.Table):
            keys = table.column("key").to_numpy()
            chunk = table.column("__chunk").to_numpy() if table.column("__cross")[0].as_py() else None
            vectors = units(table.column("vector").combine_chunks(), kind)
            counts, root = leaf_links(vectors, table.column("copies").to_numpy(), table.column("leaves").to_pylist(), table.column("leaf")[0].as_py(), threshold, chunk)
            for k in np.flatnonzero(counts).tolist():
                yield int(keys[k]), None, int(counts[k])
            for k in np.flatnonzero(root != np.arange(len(root))).tolist():
                yield int(keys[k]), int(keys[root[k]]), None

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        yield from in_batches(runs(batches, ["width", "leaf", "__tile"], work), schema)

    lists = placed.groupBy("key").agg(F.first("width").alias("width"), F.collect_list("leaf").alias("leaves"))
    dealt = lists.join(distinct.select("key", "vector", "copies"), "key").withColumn("leaf", F.explode("leaves"))
    met = scratch.keep(tiled(dealt.select("width", "leaf", "key", "vector", "copies", "leaves"), ["width", "leaf"], "key", tile_rows).mapInArrow(compared, "a long, b long, n long"), "met")
    scratch.drop("leaves")
    counts = met.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    return met.where("b is not null").select("a", "b"), counts
