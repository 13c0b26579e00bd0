"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import site
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, where they could not import it by themselves: neither installed
    nor on PYTHONPATH, which workers inherit."""
    sc, home = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), site.getusersitepackages()]
    if getattr(sc, "_gleaner_shipped", False) or home in map(os.path.abspath, filter(None, known)):
        return
    sc._gleaner_shipped = True
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(os.path.join(home, "gleaner")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, home))
    before = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = before  # the driver keeps the package it runs from


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder; column pruning and filters reach the scan from here."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only where none is set (tests) make one on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: ends the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
