"""Written steps of long jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.session import write_once

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``write_once``, and the step's shuffle files go as soon as it is written.

    What comes later reads the written rows, so the disks of a job hold the shuffles of one step at a time.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return write_once(df, label)
    finally:
        conf.set(_CLEANUP, before)
