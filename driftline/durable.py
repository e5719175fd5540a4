"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that lost executors cost nothing.

    What the frame has shuffled is deleted as soon as it is written. The folder is the one that ``spark.checkpoint.dir`` names. Only where that is unset and all runs in one process on
    one machine, as in tests, a temporary one is made; elsewhere that is an error, as executors would not see it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftline-checkpoint-"))
    spark, kept = df.sparkSession, df.sparkSession.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # for the frame that is made next; frames of the caller keep their shuffles
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, kept)
