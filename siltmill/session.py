"""Session helpers: settings for the engine and a shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of the engine's own starts with; a cluster's settings go before them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "siltmill", **settings: str) -> SparkSession:
    """A session with DEFAULTS, or the running one. Settings' dots are given as underscores."""
    conf = DEFAULTS | {k.replace("_", "."): str(v) for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset, one is made in local mode (tests); on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltmill-"))
    return context.getCheckpointDir() or folder


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut, written once to the shared folder: later reads survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
