"""Writers: ordered CSV, tables that must not exist yet, appended checkpoints, GeoJSON layers, binary polygons, commented columns."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import set_text
from ..operators.quality import require_unique


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, removed when the driver's JVM ends; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"file://{tempfile.gettempdir()}/cinderbrook"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = (), *, single_file: bool = False) -> None:
    """CSV with header in the order given, arrays as {a,b}; range-sorted part files, or one file for small exports."""
    flat = df.select(*(set_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema))
    ordered = flat.orderBy(*order) if order else flat
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, site: str | None = None, *, mode: str = "errorifexists", keys: Sequence[str] = ()) -> None:
    """Parquet, clustered and sorted by site, so that a site's rows lie in few files; keys are checked first."""
    if keys:
        require_unique(df, keys)
    clustered = df.repartition(site).sortWithinPartitions(site) if site else df
    clustered.write.mode(mode).parquet(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def commented(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """df with comments in the columns' metadata."""
    return df.select(*(F.col(c).alias(c, metadata={**df.schema[c].metadata, "comment": comments[c]}) if c in comments else F.col(c) for c in df.columns))


def write_layers(layers: Mapping[str, DataFrame], folder: str) -> dict[str, bool]:
    """Writes each layer that has rows as GeoJSON feature lines; returns which had any. A layer has `rings` and properties."""
    written = {}
    for name, df in layers.items():
        written[name] = not df.isEmpty()
        if written[name]:
            properties = F.struct(*(c for c in df.columns if c != "rings"))
            rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
            feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
            df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.geojsonl")
    return written


@F.arrow_udf(T.BinaryType())
def well_known_binary(polygons: pa.Array) -> pa.Array:
    """Polygons (rings of points) as little-endian well-known binary, rings closed; null stays null."""

    def packed(rings) -> bytes:
        out = [struct.pack("<BII", 1, 3, len(rings))]
        for ring in rings:
            points = [(p["x"], p["y"]) for p in ring]
            points += points[:1] if points and points[0] != points[-1] else []
            out.append(struct.pack(f"<I{2 * len(points)}d", len(points), *(c for p in points for c in p)))
        return b"".join(out)

    return pa.array([None if rings is None else packed(rings) for rings in polygons.to_pylist()], pa.binary())
