"""Exact dedup by Grace hash partitioning.

Spark's shuffle is the first partitioning: every map task first collapses its own copies, so that a text sends at most one
record per task however many copies it has. Each reduce task then partitions its records on to spill files, four digest bits
at a time, until the distinct contents of a bucket fit an open-addressing table that compares whole contents. The table also
proves that equal digests mean equal contents, so documents find their group by digest in a join whose hot keys Spark splits.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_batches, whole_bytes

#: Bytes of distinct contents that one table may hold.
TABLE_BYTES = 64 << 20


class ContentTable:
    """Open addressing with linear probing; an entry is [digest, content, largest id, count]."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, top_id, count: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == digest:
                if entry[1] != content:
                    raise ValueError("two different texts have one SHA-256 digest")
                entry[2] = larger(entry[2], top_id)
                entry[3] += count
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, top_id, count])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def normalised(text: bytes | None) -> bytes:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return (text or b"").lower()  # bytes.lower() touches ASCII letters only


def grace(records: Iterator[tuple], limit: int, level: int = 0) -> Iterator[tuple]:
    """(digest, content, id, count) with equal contents merged, in memory bounded by `limit` and one content."""
    table = ContentTable()
    for record in records:
        table.add(*record)
        if table.bytes > limit and len(table.entries) > 1 and level < 64:
            break
    else:
        yield from map(tuple, table.entries)
        return
    with ExitStack() as stack:
        folder = stack.enter_context(tempfile.TemporaryDirectory(prefix="grace-"))
        files = [stack.enter_context(open(f"{folder}/{k}", "w+b")) for k in range(16)]

        def spill(record) -> None:
            half_byte = record[0][level >> 1] >> (4 if level & 1 == 0 else 0) & 15
            pickle.dump(tuple(record), files[half_byte], protocol=5)

        for entry in table.entries:
            spill(entry)
        del table
        for record in records:
            spill(record)
        for file in files:
            file.seek(0)
            yield from grace(unspilled(file), limit, level + 1)
            file.truncate(0)


def unspilled(file) -> Iterator[tuple]:
    while file.peek(1):
        yield pickle.load(file)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of a group the largest id stays.
    A null id never wins against an id; in a group without any id, keep_id is null and its rows are kept. Rows that repeat an id
    and its text share `kept`, and each counts in group_size. An empty table gives an empty result; other columns aren't read.
    """
    id_type = df.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    member_schema = pa.schema([("id", arrow_id), ("digest", pa.binary())])
    record_schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", arrow_id), ("group_size", pa.int64())])
    group_schema = pa.schema([record_schema.field(0), record_schema.field(2), record_schema.field(3)])

    def digests(batches):
        for batch in batches:
            found = [hashlib.sha256(normalised(x)).digest() for x in whole_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=member_schema)

    def collapsed(batches):
        table = ContentTable()
        for batch in batches:
            for one_id, text in zip(batch.column(0), whole_bytes(batch.column(1))):
                content = normalised(text)
                table.add(hashlib.sha256(content).digest(), content, one_id.as_py(), 1)
                if table.bytes > table_bytes:
                    yield from in_batches(map(tuple, table.entries), record_schema, lambda row: len(row[1]) + 64)
                    table = ContentTable()
        yield from in_batches(map(tuple, table.entries), record_schema, lambda row: len(row[1]) + 64)

    def grouped(batches):
        def records():
            for batch in batches:
                rest = [batch.column(k).to_pylist() for k in (2, 3)]
                yield from zip(whole_bytes(batch.column(0)), whole_bytes(batch.column(1)), *rest)

        merged = ((digest, keep_id, size) for digest, _, keep_id, size in grace(records(), table_bytes))
        yield from in_batches(merged, group_schema)

    def spark_schema(schema, types):
        return T.StructType([T.StructField(name, types.get(name, T.BinaryType())) for name in schema.names])

    types = {"id": id_type, "keep_id": id_type, "group_size": T.LongType()}
    members = source.mapInArrow(digests, spark_schema(member_schema, types))
    records = source.mapInArrow(collapsed, spark_schema(record_schema, types))
    groups = records.repartition("digest").mapInArrow(grouped, spark_schema(group_schema, types))
    return members.join(groups, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id exact_dedup keeps, with all columns; rows that share an id, or have none, stay or go together."""
    kept = exact_dedup(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id"))
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
