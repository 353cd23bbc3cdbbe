"""Sessions, tables and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "skein", cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | more
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()


#: Rows and bytes that pass to a Python worker at once; texts are long, so fewer than Spark's default.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def steady(spark: SparkSession) -> None:
    """Keeps a union from claiming the partitioning of its parts.

    Adaptive execution can leave the parts with different numbers of partitions,
    and a plan that relies on the claim then fails ("can't zip").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", False)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds their batches."""
    sc = spark.sparkContext
    steady(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_skein_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="skein-"), f"skein-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    sc._skein_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark whatever store it is in."""
    steady(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The URI of a new folder that the driver and all executors see.

    It lies in the folder that the cluster names in spark.checkpoint.dir. Only
    where that is unset and Spark runs on one machine, as in tests, a local one is
    set; on a cluster without such a folder this fails.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    if "://" not in base:
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/skein/{sc.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"


def tidy(spark: SparkSession) -> None:
    """Removes everything that this application has put into the shared folder; results that still read from there must be written before."""
    drop_folder(spark, shared_folder(spark, "none").rsplit("/", 1)[0])


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the shared folder and read again.

    This cuts the lineage: what follows never recomputes what came before, also
    when executors are lost.
    """
    at = shared_folder(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Removes a folder made by shared_folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
