"""Where intermediate relations live: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from policylog.errors import Code, DatalogError


def settle(df: DataFrame) -> DataFrame:
    """Compute a relation once and cut its lineage; survives the loss of executors. The folder is the session's
    spark.checkpoint.dir, and a temporary one only where that is unset and all runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise DatalogError(Code.INVALID_STATE, "spark.checkpoint.dir names no folder", "set it to one that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="policylog-"))
    return df.checkpoint(eager=True)
