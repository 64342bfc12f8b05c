"""Session for tests and timing runs, and the folder for written intermediate tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "lendframe", shared: str | None = None) -> SparkSession:
    """Local session, with `shared` as its shared folder. On a cluster the submitting job brings its own settings; the
    library sets none."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names in spark.checkpoint.dir.

    Without that setting a local session, whose one process does all the work, gets one for its lifetime; a cluster
    session is refused, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.local.dir', None) or '/tmp'}/lendframe-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/lendframe-{uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write a frame as parquet and return it as read back: a cut in the lineage that survives executor loss."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
