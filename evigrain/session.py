"""Session pinning, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings that make a run repeatable; the time zone matters for every timestamp comparison.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own session to the operators, after ``ship``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("evigrain")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in PINNED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that they can import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_evigrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="evigrain-")) / "evigrain_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(Path("evigrain") / file.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._evigrain_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the parquet tables under ``root`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors see: what ``spark.checkpoint.dir`` names. Only where it is unset one is
    chosen: a temporary folder for a local master (tests), else one beside the warehouse, which a cluster shares."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master.startswith("local"):
            folder = os.path.join(tempfile.gettempdir(), f"evigrain-checkpoints-{os.getpid()}")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_evigrain_checkpoints"
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no
    recomputation of what lies before and the work is done once for several readers."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions before costly Python work."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)
