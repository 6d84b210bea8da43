"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written to the checkpoint folder that the cluster names in spark.checkpoint.dir, and read from there.

    Only where the session has no such setting and no folder, as in tests on
    one machine, is a temporary folder set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-"))
    return df.checkpoint()
