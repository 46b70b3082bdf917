"""Tables written to a folder that the driver and all executors share, so that several uses read files in place of one lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # the temporary folder of a session on one machine


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine without that setting, below a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="rollprobe-")) if app not in _LOCAL else _LOCAL[app]
    return f"{base.rstrip('/')}/rollprobe-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in a new folder, read back; a table that this function gave is itself.

    The folder stays until the scratch folder is cleared.
    """
    if getattr(df, "_written", False):
        return df
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = True
    return out
