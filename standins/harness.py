"""What a test or benchmark session needs besides the library."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def name_checkpoint_folder(spark: SparkSession) -> SparkSession:
    """Gives a local session that names no shared folder a private one; a cluster must name its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="storygauge-"))
    return spark
