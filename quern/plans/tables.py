"""Access to the Parquet tables of a data directory, and session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "quern-checkpoints")
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there: survives the loss of executors and ends the lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it wherever they run.

    Each task has a core, so the linear algebra of a worker gets one thread unless the caller chose otherwise.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        sc.environment.setdefault(name, "1")
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"quern/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle the caller sizes itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
