"""File-source streams that append: the run ledger and the registration of raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import ledger_entries, register_sources


def stream_ledger(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """New event files -> ledger rows appended as parquet, each file exactly once (file sink and its log)."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    entries = ledger_entries(reader.parquet(folder))
    return (
        entries.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_sources(spark: SparkSession, folder: str, schema: StructType, roots: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """New source files -> registrations.  A micro-batch writes its own folder, so a repeated batch replaces it."""

    def register(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        try:
            existing = session.read.parquet(target).where(f"batch_id <> {batch_id}").select("root_id", "raw_path").withColumnRenamed("raw_path", "path")
        except Exception as error:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            existing = session.createDataFrame([], "root_id string, path string")
        register_sources(batch, existing, roots).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(register)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
