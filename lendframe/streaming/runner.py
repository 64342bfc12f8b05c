"""Run a stream over all files that are there, into parquet files written once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FEED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("book_id", T.LongType()),
        T.StructField("member_id", T.LongType()),
        T.StructField("action", T.StringType()),
    ]
)


def open_feed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The feed folder as a stream; `files_per_batch` bounds what one micro-batch holds."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process what is available and return all emitted rows with their micro-batch number as `batch`.

    A batch that is repeated after a failure overwrites its own folder, so no row is emitted twice.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(
        f"{folder}/out"
    )
