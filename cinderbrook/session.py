"""Session settings, and shipping the library to executors that haven't got it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(name: str = "cinderbrook", **conf: str) -> SparkSession:
    """A session with the settings that the operators' results assume: UTC, ANSI arithmetic, adaptive plans."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the library's sources to the executors, once a session, unless PYTHONPATH or an installation has them there."""
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT.parent) in on_path or "site-packages" in ROOT.parts or getattr(spark, "_cinderbrook_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="cinderbrook-")) / "cinderbrook.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(ROOT.rglob("*.py")):
            out.write(source, source.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark._cinderbrook_shipped = True
