"""Folders for tables between the steps of an operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def work_folder(df: DataFrame, label: str) -> str:
    """A new folder in the folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset and the master is this machine alone (tests), it is a temporary one; on a cluster RuntimeError says
    what is missing, as executors would write where none can read.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meridia-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
