"""The session that the engine is meant for: Arrow on, UTC, ANSI, adaptive plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with CONF; keyword arguments use __ for dots: session("local[8]", spark__sql__shuffle__partitions="8")."""
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    return builder.config(map=CONF | {k.replace("__", "."): str(v) for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if they are one
    process (tests); on a cluster it raises."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = getattr(sc, "_cohortis_base_dir", None)
        if told is None:
            told = sc._cohortis_base_dir = f"file://{tempfile.mkdtemp(prefix='cohortis-base-')}"
    return told.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: computed once, and a lost executor costs nothing that was done."""
    path = f"{shared_dir(df.sparkSession)}/cohortis-base/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that executors need no copy of the repository."""
    sc = spark.sparkContext
    name = f"cohortis-{sc.applicationId}.zip"
    if any(str(p).endswith(name) for p in sc._python_includes):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="cohortis-"), name)
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
