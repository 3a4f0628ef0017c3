"""Session helpers: a tuned builder for jobs and tests, and durable lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_KEYS = 500_000  # rows of a narrow table that may be sent to every executor


def build_session(app: str = "storygauge", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution on; extra ``conf`` entries win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged data that the session names in ``spark.checkpoint.dir``.

    The setting is static: a running session is given a folder by ``sparkContext.setCheckpointDir``. Without one this is
    an error; the library never chooses a machine's own folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder, so that a lost executor costs no rework."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def staged_keys(keys: DataFrame) -> tuple[DataFrame, bool]:
    """A narrow table staged by ``durable``, and whether it was counted to be small enough to broadcast.

    If so it comes with the hint, so that a join against it leaves the other side where it is.
    """
    staged = durable(keys)
    small = staged.count() <= BROADCAST_KEYS
    return (F.broadcast(staged) if small else staged), small
