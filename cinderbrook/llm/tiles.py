"""Groups of rows that tasks compare, with groups beyond a bound dealt out as tiles of two chunks each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """The rows whose key others share, dealt out by (keys, tile) and sorted by it.

    A group of up to `most` rows is one tile. A larger one is cut by a hash of `by` into chunks of about that many, and each
    two chunks (and each with itself) make a tile: any two rows of the group meet in a tile, none of which holds much more
    than twice `most` rows. __chunk is a row's chunk; __cross says that a tile is of two chunks, whose inner pairs have other tiles.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    chunks = F.ceil(F.col("__n") / F.lit(most)).cast("int")
    dealt = rows.join(counts, keys).withColumn("__s", chunks)
    chunk = F.pmod(F.xxhash64(F.lit(17), by), F.col("__s")).cast("int")
    low, high = (lambda j: F.least(j, F.col("__c"))), (lambda j: F.greatest(j, F.col("__c")))
    tiles = F.transform(F.sequence(F.lit(0), F.col("__s") - 1), lambda j: F.struct((low(j) * F.col("__s") + high(j)).alias("tile"), (low(j) != high(j)).alias("cross")))
    alone = F.array(F.struct(F.lit(0).alias("tile"), F.lit(False).alias("cross")))
    dealt = dealt.withColumn("__c", chunk).withColumn("__at", F.explode(F.when(F.col("__s") == 1, alone).otherwise(tiles)))
    dealt = dealt.select(*rows.columns, F.col("__c").alias("__chunk"), F.col("__at.tile").alias("__tile"), F.col("__at.cross").alias("__cross"))
    return dealt.repartition(*keys, "__tile").sortWithinPartitions(*keys, "__tile")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[tuple]]) -> Iterator[tuple]:
    """work(table) for each run of rows with equal keys, over the record batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        tuples = list(zip(*columns))
        for at, key in enumerate(tuples):
            if key != held_key:
                if held_key is not None:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    yield from work(pa.Table.from_batches(held))
                held, held_key, start = [], key, at
        held.append(batch.slice(start))
    if held:
        yield from work(pa.Table.from_batches(held))
