"""Rebuilding the stored tables in order: base, a series per analyte, counts, largest valid groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import checked_identifier
from ..operators.quality import Outcome
from .chemistry import ANALYTES, analyte_series, standardise_chemistry
from .prepost import counts_before_after, gated_groups, largest_group, paired


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{checked_identifier(name)}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rebuild(results: DataFrame, others: DataFrame, study_sites: DataFrame, flow: DataFrame, groups: DataFrame, folder: str, analytes: Iterable[str] = tuple(ANALYTES)) -> list[Outcome]:
    """Writes <analyte>, <analyte>_counts and <analyte>_largest below the folder, and the standardised base first.

    A failure of the base ends the rebuild with its error; an analyte's failure is a warning and the others go on. The last outcome
    says whether all tables are there.
    """
    spark = results.sparkSession
    outcomes: list[Outcome] = []
    base = stored(standardise_chemistry(results, study_sites), folder, "water_chem_std")
    outcomes.append(Outcome("water_chem_std", "success"))
    wanted = ["water_chem_std"]
    for analyte in analytes:
        wanted += [analyte, f"{analyte}_counts", f"{analyte}_largest"]
        try:
            series = stored(analyte_series(base, others, analyte), folder, analyte)
            pairs = paired(series, flow)
            stored(counts_before_after(pairs, groups), folder, f"{analyte}_counts")
            stored(largest_group(gated_groups(pairs, groups)), folder, f"{analyte}_largest")
            outcomes.append(Outcome(analyte, "success"))
        except Exception as error:  # noqa: BLE001  one analyte doesn't stop the others
            outcomes.append(Outcome(analyte, "warning", str(error).splitlines()[0][:300]))
    missing = [name for name in wanted if not there(spark, f"{folder}/{name}")]
    outcomes.append(Outcome("check", "error" if missing else "success", ", ".join(missing)))
    return outcomes


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
