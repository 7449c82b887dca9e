"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

A 64-bit fingerprint is cut into blocks, four more than a key holds: fingerprints at up to four differing bits agree in all
blocks of at least one key. Documents with one fingerprint are one row from there on. Rows that share a key are compared within
a task (large keys in tiles), and a task returns a spanning forest of the links it verified, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, whole_bytes
from .components import connected_components
from .tiles import runs, tiled

#: Differing bits up to which fingerprints link.
DISTANCE = 4
#: Words in a shingle.
SHINGLE = 4
#: Rows of one key that a task compares; larger keys are tiled.
TILE_ROWS = 20_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of a whole text; 0 if it has no words. A bit is set if it is set in over half the shingles' XXH64, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    set_bits = np.zeros(64, np.int64)
    stops = (ends[shingle - 1 :] - 1).tolist()
    for low in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[low : low + (1 << 16)], stops[low : low + (1 << 16)])), np.uint64)
        set_bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    schema = df.select(F.col(id_col).alias("id")).schema.add("fp", "long")

    def hashed(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x, shingle) for x in whole_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(hashed, schema)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of all keys: each joins `blocks - distance` of `blocks` nearly equal blocks of the 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(single, blocks - distance)]


def blocks_for(rows: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys have few rows each: any number gives the same links, with another mix of rows and comparisons."""
    return next((b for b in range(distance + 2, distance + 5) if rows < 1 << (64 * (b - distance) // b + 4)), distance + 5)


def block_keys(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("block"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")) for k, mask in enumerate(masks))))


def spanning_links(values: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """Links (pairs of positions) at up to `distance` differing bits that connect whatever all such links connect."""
    if len(values) <= 24:
        plain = values.tolist()
        left = list(range(len(plain)))
        while left:
            queue = [left.pop()]
            while queue and left:
                one = queue.pop()
                near = [k for k in left if (plain[k] ^ plain[one]).bit_count() <= distance]
                if near:
                    yield from ((one, k) for k in near)
                    gone = set(near)
                    left = [k for k in left if k not in gone]
                    queue += near
        return
    left = np.arange(len(values))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(values[left] ^ values[one]) <= distance
            if near.any():
                found = left[near].tolist()
                yield from ((one, k) for k in found)
                left = left[~near]
                queue += found


def fingerprint_links(distinct: DataFrame, blocks: int, distance: int = DISTANCE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that are within the distance."""
    masks = block_masks(blocks, distance)
    keyed = distinct.select("fp", block_keys(F.col("fp"), masks).alias("key")).select("fp", "key.block", "key.bits")

    def compared(batches):
        def work(table):
            values = table.column("fp").to_numpy().view(np.uint64)
            for a, b in spanning_links(values, distance):
                yield int(values[a].view(np.int64)), int(values[b].view(np.int64))

        links = list(runs(batches, ["block", "bits", "__tile"], work))
        if links:
            ends = np.array(links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return tiled(keyed, ["block", "bits"], "fp", tile_rows).mapInArrow(compared, "a long, b long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    A null or wordless text has fingerprint zero and links like any other; a text of fewer words than a shingle is one shingle.
    A row with a null id links as others do, but is never a component's smallest id unless the component has no id at all.
    Repeated rows are in one component. An empty table gives an empty result; other columns aren't read.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(df, id_col, text_col, shingle), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    links = fingerprint_links(distinct, blocks or blocks_for(distinct.count(), distance), distance, tile_rows)
    labels = scratch.keep(connected_components(scratch, scratch.keep(links, "links")), "labels")
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = scratch.keep(labelled.join(least, "component").select("fp", "component_id"), "placed")
    return prints.join(placed, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of its component, with all columns; rows that share an id stay or go together."""
    kept = simhash_groups(df, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept_id"))
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
