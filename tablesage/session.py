"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tablesage") -> SparkSession:
    """A session for tests and the local bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only in local mode, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="tablesage-")


def stable(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder.

    Used after steps that must not be run twice (model answers, query timings) and for
    small results that several later steps read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes of a materialized table that may be sent to every task, a little less than Spark's own threshold.
FEW = 8 << 20


def few(rows: DataFrame, size: Column) -> bool:
    """Whether the rows of a materialized table, of ``size`` bytes each, are small in sum. Spark's estimates of such tables are its plan's."""
    return (rows.agg(F.sum(size)).first()[0] or 0) <= FEW


def sent_if_few(rows: DataFrame, size: Column) -> DataFrame:
    return F.broadcast(rows) if few(rows, size) else rows


def wide_parts(spark: SparkSession) -> int:
    """Tasks for rows of few bytes with much work each, which adaptive execution would put into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application; they need it for the few Python steps."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="tablesage-package-")) / "tablesage"), "zip", root.parent, root.name
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
