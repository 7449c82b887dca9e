"""What the corpus operators share: scratch tables in the shared folder, checked joins and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in every contract of this subpackage: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side of at most so many bytes, as measured, is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Keys with over one part in so many of the rows are hot: join_counted broadcasts what they are joined with.
HEAVY = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="cinderbrook-")
    spark.sparkContext.setCheckpointDir(folder)
    return f"file://{folder}"


class Scratch:
    """Tables of one operator run, written below the shared folder; they cut lineage and outlive executors.

    drop() frees a table once the next one is written. What a returned DataFrame still reads goes with the `freed` block in which
    its result is written, or else when the driver's Python or JVM ends, whether the session was stopped before or not.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path(self.root))
        self._open.append(self)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")

    def drop(self, label: str = "") -> None:
        self.files.delete(self.path(f"{self.root}/{label}"), True)

    def close(self) -> None:
        if self in self._open:
            self._open.remove(self)
            self.drop()


@contextmanager
def freed() -> Iterator[None]:
    """Frees on leaving the scratch tables that operators made inside; write their results before."""
    before = list(Scratch._open)
    try:
        yield
    finally:
        for scratch in [s for s in Scratch._open if s not in before]:
            scratch.close()


@atexit.register
def free_all() -> None:
    for scratch in list(Scratch._open):
        try:
            scratch.close()
        except (OSError, Py4JError, RuntimeError):  # the JVM is gone already; its own hook deletes the folder
            pass


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.lit(16) if not isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.lit(64)
        return F.greatest(F.size(column), F.lit(0)) * inner + 16
    if isinstance(kind, T.StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows were measured to take at most `limit` bytes; else as it is, for a shuffled join.

    df should be cheap to read, such as a scratch table.
    """
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit else df


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined (inner) with `keyed`, which has a row per key and in `count` how many of `rows` have that key.

    A key with over 1 / HEAVY of all counted rows goes by broadcast: there are at most HEAVY such keys whatever the table. The
    others are joined by a shuffle, in which no key is hot. Both sides should be cheap to read; `keyed` is broadcast whole if
    it is small.
    """
    if keyed.limit(HEAVY + 1).count() <= HEAVY:
        return rows.join(F.broadcast(keyed), keys)
    total = keyed.agg(F.sum(count)).first()[0]
    is_heavy = F.col(count) > F.lit(total) / HEAVY
    heavy = keyed.where(is_heavy)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(keyed.where(~is_heavy), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def whole_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """A string or binary column's values as bytes, one at a time."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 64, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `limit` bytes by `size`."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes >= limit:
            yield to_batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)], schema=schema)
