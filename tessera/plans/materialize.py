"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine, as in tests.

    The shuffle files it was made from are of no more use, and are let go.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    kept = df.select("*").checkpoint(eager=True)  # a plan of its own: df would hold on to the shuffles
    let_go(spark)
    return kept


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no plan needs any more.

    It does so only when the driver's garbage is collected.  Before that Python's
    handles must be gone, which py4j gives up from a queue it looks at once a
    second, and the listeners must have seen the event that holds a plan that
    has just run.  Something of the run still lives for a moment then, so that a
    single collection leaves its files until some later one: hence two.
    """
    sc = spark.sparkContext
    gc.collect()
    queue = getattr(sc._gateway._gateway_client, "finalizer_deque", None)
    while queue:
        try:
            task = queue.pop()
        except IndexError:  # py4j's own worker was faster
            break
        if not isinstance(task, tuple):  # it is told to end
            queue.append(task)
            break
        task[0].garbage_collect_object(task[1], False)
    with contextlib.suppress(Py4JJavaError):  # listeners that lag so much only delay the deletion
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    sc._jvm.System.gc()
    time.sleep(0.2)
    sc._jvm.System.gc()


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, broadcast if it has so few rows; counted, so it should be a checkpoint of one or two numbers a row."""
    return F.broadcast(df) if df.count() <= most else df
