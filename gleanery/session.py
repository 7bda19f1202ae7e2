"""Session construction and the one rule about shared intermediate storage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator is written for (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on this machine alone (tests) is a local one set; on a cluster a folder
    of one machine would lose what other executors need, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        path = named
    elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        path = os.path.join(tempfile.gettempdir(), "gleanery-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of any executor.

    Spark removes the files once nothing refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per application.

    Needed wherever the workers do not find it on their own path (a cluster without an installed copy).
    """
    sc = spark.sparkContext
    if getattr(sc, "_gleanery_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gleanery-"), "gleanery_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(path)
    sc._gleanery_shipped = True
