"""Session defaults. A cluster's own settings always win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cuewise")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df):
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def work_dir(spark) -> str:
    """New folder under the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a local
    session gets a temporary one; any other is an error, since its executors could not see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="run-"))
    return spark.conf.get("spark.checkpoint.dir")
