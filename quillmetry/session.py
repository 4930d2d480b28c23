"""Session factory and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "quillmetry", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (AQE, UTC, few shuffle partitions)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster. Where that is unset on a single machine
    (tests) a temporary folder is made once and kept in the setting; on a cluster it's an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = os.path.join(tempfile.gettempdir(), f"quillmetry-{uuid.uuid4().hex[:8]}")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        folder = "file://" + place
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and lets a result that
    several branches need be computed once. The folder belongs to the session and is
    left for whoever owns ``spark.checkpoint.dir`` to clear.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are cores (one small file, many cores)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't find it by themselves.

    Where it lies on ``PYTHONPATH`` nothing is done; else it is sent along as a zip, once a
    context.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quillmetry_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillmetry-")
    archive = os.path.join(folder, "quillmetry.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for place, _, files in os.walk(os.path.join(root, "quillmetry")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._quillmetry_shipped = True
