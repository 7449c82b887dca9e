"""Assertions and functional rewrites: what constraints, upserts and swaps become on immutable tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregates import duplicate_keys
from .joins import not_in
from .windows import first_per_key


class QualityError(ValueError):
    """A table violates what an operator asks of it."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = duplicate_keys(df, keys).limit(3).collect()
    if found:
        raise QualityError(f"keys {', '.join(keys)} repeat, such as {[tuple(r) for r in found]}")
    return df


def require_labels(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    odd = df.where(~F.col(column).isin(*labels)).select(column).distinct().limit(3).collect()
    if odd:
        raise QualityError(f"unexpected {column}: {[r[0] for r in odd]}")
    return df


def require_none(df: DataFrame, violation: Column, message: str) -> DataFrame:
    """Raises if any row shows the violation; the count is in the message."""
    n = df.where(violation).count()
    if n:
        raise QualityError(f"{message}: {n} groups")
    return df


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise QualityError(f"missing tables: {', '.join(missing)}")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def new_rows(candidates: DataFrame, present: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Candidates whose keys aren't present yet, one per key: what an insert that ignores conflicts would add."""
    order = order or [c for c in candidates.columns if c not in keys] or list(keys)
    return first_per_key(not_in(candidates, present, keys), keys, order)


def insert_ignore(present: DataFrame, candidates: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    return present.unionByName(new_rows(candidates, present, keys, order))


def replace_where(present: DataFrame, condition: Column, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows that fulfil the condition, and the candidates that are new to what is left."""
    left = present.where(~F.coalesce(condition, F.lit(False)))
    return insert_ignore(left, candidates, keys)


def updated(df: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """UPDATE ... FROM: the column's new value where the keys match, else the old one. The changes have one row per key."""
    new = changes.select(*keys, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    joined = df.join(new, list(keys), "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).select(*df.columns)


@dataclass
class Outcome:
    """What a step did: status success, warning or error."""

    step: str
    status: str
    message: str = ""


def swapped_write(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Writes a staging table, checks its keys, then puts it in the path's place; a failure leaves the old table as it was."""
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if keys:
            require_unique(spark.read.parquet(staging), keys)
    except QualityError:
        fs.delete(fs_path(staging), True)
        raise
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(staging), fs_path(path))
    fs.delete(fs_path(old), True)


def unexpected_columns(df: DataFrame, allowed: Sequence[str], pattern: str = r"[0-9]+_\d{5}_\d{5}(_cd)?") -> list[str]:
    return [c for c in df.columns if re.fullmatch(pattern, c) and c not in allowed]
