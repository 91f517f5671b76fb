"""Session plumbing shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.materialize import let_go

#: Spark's default of rows an Arrow batch, and ours: texts are thousands of bytes each.
_DEFAULT_ROWS, _ROWS = "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, and keep Arrow batches of texts small.

    The driver serves the archive itself, so no shared folder is needed.  A
    batch size that the user has set stays.
    """
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(rows, _ROWS)
    # Spark 4.1 may take unions of children that were coalesced differently for partitioned alike.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._tessera_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset and
    all runs on one machine, as in tests, is a temporary one chosen.  The
    shuffle files behind a checkpoint are let go.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    kept = df.select("*").checkpoint(eager=True)  # a plan of its own: df would hold on to the shuffles
    let_go(spark)
    return kept


def width(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
