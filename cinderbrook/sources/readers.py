"""Typed readers: CSV with its own tokens for missing values, commented tab-separated files, workbooks, polygons, replayed fetches."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import blank_to_null

#: Fixed value: the namespace of spreadsheet parts.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, na: Sequence[str] = ("",), sep: str = ",", comment: str | None = None) -> DataFrame:
    """CSV by header, staged as text; tokens for missing values and texts that don't convert become null."""
    wanted = as_schema(schema)
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False)
    staged = (reader.option("comment", comment) if comment else reader).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])).csv(path)
    clean = lambda name: F.when(~F.trim(F.col(f"`{name}`")).isin(*na), F.trim(F.col(f"`{name}`")))
    return staged.select(*(clean(f.name).try_cast(f.dataType).alias(f.name) for f in wanted))


def read_commented_tsv(spark: SparkSession, path: str, date_col: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated text with # lines and a row of type tokens under the header: rows whose date isn't one are dropped."""
    staged = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    for old, new in (renames or {}).items():
        staged = staged.withColumnRenamed(old, new)
    return staged.withColumn(date_col, F.col(date_col).try_cast("date")).where(F.col(date_col).isNotNull())


def unexpected_columns(df: DataFrame, allowed: Sequence[str], pattern: str = r"[0-9]+_\d{5}_\d{5}(_cd)?") -> DataFrame:
    """(column): headers of the pattern that aren't allowed."""
    found = [(c,) for c in df.columns if re.fullmatch(pattern, c) and c not in allowed]
    return df.sparkSession.createDataFrame(found, "column string")


def first_column(df: DataFrame, pattern: str) -> str:
    """The first column whose name the pattern is found in."""
    found = next((c for c in df.columns if re.search(pattern, c)), None)
    if found is None:
        raise ValueError(f"no column matches {pattern!r}")
    return found


def stacked(tables: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    tables = list(tables)
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table, allowMissingColumns=True)
    return found


def read_directory(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All parquet tables of a folder as one."""
    return spark.read.schema(as_schema(schema)).option("recursiveFileLookup", True).parquet(path)


def with_header(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """df with the expected names, given by position if any of them is missing."""
    return df if set(expected) <= set(df.columns) else df.toDF(*expected)


FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def feature_polygons(features: DataFrame) -> DataFrame:
    """(properties map, type, rings) of features in a column f; a multipolygon gives a row per polygon."""
    each = features.select("f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>"))
    xy = lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return each.select("properties", "type", F.explode(polygons).alias("polygon")).select("properties", "type", xy(F.col("polygon")).alias("rings"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The polygons of GeoJSON feature collections; a collection is read whole by one task."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"struct<features:array<{FEATURE}>>").alias("doc"))
    return feature_polygons(whole.select(F.explode("doc.features").alias("f")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The polygons of GeoJSON with a feature a line, which is read by stretches."""
    return feature_polygons(spark.read.text(path).select(F.from_json("value", FEATURE).alias("f")))


def parse_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The polygons (rings of points) of a well-known binary polygon or multipolygon; further ordinates and an SRID are skipped."""

    def shape(at: int) -> tuple[list, int]:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 9 if code & 0x20000000 else 5
        plain = code & 0x0FFFFFFF
        ordinates = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[plain // 1000]
        (count,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if plain % 1000 == 6:
            polygons = []
            for _ in range(count):
                part, at = shape(at)
                polygons += part
            return polygons, at
        if plain % 1000 != 3:
            raise ValueError(f"geometry type {plain} is no polygon")
        rings = []
        for _ in range(count):
            (points,) = struct.unpack_from(order + "I", data, at)
            values = struct.unpack_from(f"{order}{points * ordinates}d", data, at + 4)
            rings.append(list(zip(values[::ordinates], values[1::ordinates])))
            at += 4 + 8 * points * ordinates
        return [rings], at

    return shape(0)[0]


def wkb_polygons(df: DataFrame, column: str) -> DataFrame:
    """df with `rings` in place of a well-known binary column; a multipolygon gives a row per polygon, a null column none."""
    @F.arrow_udf("array<array<array<struct<x:double,y:double>>>>")
    def polygons(values: pa.Array) -> pa.Array:
        xy = lambda rings: [[{"x": x, "y": y} for x, y in ring] for ring in rings]
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.array([None if value is None else [xy(polygon) for polygon in parse_wkb(value)] for value in values.to_pylist()], kind)

    return df.withColumn("rings", F.explode(polygons(F.col(column)))).drop(column)


def read_workbook(spark: SparkSession, path: str, schema: T.StructType | str, sheet: int = 1) -> DataFrame:
    """The rows of one sheet of spreadsheet files, by the header in its first row; cells that don't convert become null.

    A workbook is read whole by one task. Days given as numbers count from the end of 1899.
    """
    wanted = as_schema(schema)
    names = [f.name for f in wanted]

    def rows(frames):
        for frame in frames:
            out = []
            for content in frame["content"]:
                header, *body = workbook_rows(bytes(content), sheet) or [[]]
                at = [header.index(name) if name in header else None for name in names]
                out += [[None if k is None or k >= len(row) else row[k] for k in at] for row in body]
            yield pd.DataFrame(out, columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    staged = files.mapInPandas(rows, T.StructType([T.StructField(name, T.StringType()) for name in names]))

    def cell(field: T.StructField):
        text = blank_to_null(F.col(f"`{field.name}`"))
        if isinstance(field.dataType, T.DateType):
            return F.coalesce(F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("double").cast("int")), text.try_cast("date")).alias(field.name)
        return (text.try_cast("double").try_cast(field.dataType) if isinstance(field.dataType, T.IntegralType) else text.try_cast(field.dataType)).alias(field.name)

    return staged.select(*map(cell, wanted))


def workbook_rows(content: bytes, sheet: int) -> list[list[str | None]]:
    """A sheet's cells as texts; rows and columns that the file leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        shared = []
        if "xl/sharedStrings.xml" in parts.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        root = ElementTree.fromstring(parts.read(f"xl/worksheets/sheet{sheet}.xml"))
    found: list[list[str | None]] = []
    for row in root.iter(f"{SHEET}row"):
        while len(found) < int(row.get("r", len(found) + 1)) - 1:
            found.append([])
        cells: list[str | None] = []
        for cell in row.iter(f"{SHEET}c"):
            letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
            column = reduce(lambda n, letter: n * 26 + ord(letter) - 64, letters, 0) - 1 if letters else len(cells)
            cells += [None] * (column - len(cells))
            value = cell.find(f"{SHEET}v")
            if cell.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in cell.iter(f"{SHEET}t")))
            else:
                text = None if value is None else value.text
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
        found.append(cells)
    return found


def cast_staged(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """An all-text table with declared types; blank and unreadable texts become null."""
    return df.select(*(blank_to_null(F.col(f"`{f.name}`").cast("string")).try_cast(f.dataType).alias(f.name) for f in as_schema(schema)))


def replay_fetch(spark: SparkSession, sites: DataFrame, fetch: Callable[[str], Iterable[dict]], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, failed sites) of a fetch for each site, run in tasks: for replayed files, or services that allow many callers.

    A site whose fetch raises yields no rows; it is listed with the error's text.
    """
    wanted = as_schema(schema)
    site = sites.columns[0]

    def run(frames):
        for frame in frames:
            out = []
            for one in frame[site]:
                try:
                    out += [(one, json.dumps(row, default=str), None) for row in fetch(one)]
                except Exception as error:  # noqa: BLE001  one site's failure is a row, not the job's
                    out.append((one, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["site", "row", "error"])

    found = sites.select(F.col(site).alias(site)).mapInPandas(run, "site string, row string, error string")
    rows = found.where("row is not null").select(F.from_json("row", wanted).alias("r")).select("r.*")
    return rows, found.where("error is not null").select("site", "error")
