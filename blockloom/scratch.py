"""Tables that are made once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder of spark.checkpoint.dir, so that what follows neither decodes nor asks a model
    again, also after an executor is lost. Without that setting a local master gets a folder of its own; others fail."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='blockloom-')}")
    return df.checkpoint()
