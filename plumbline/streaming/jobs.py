"""Runs a finite streaming query to its end and hands back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.session import checkpoint_folder
from plumbline.streaming.ordered import write_closing


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input, write it beside the session's
    checkpoints, and read it back as a batch. Append results are files of the
    exactly-once sink; complete results are replaced per micro-batch. A stream
    in event order (``ordered.fold_stream``) is closed at the end, so that the
    rows which still wait for the watermark are told as well."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"

    def run() -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            query = writer.outputMode("append").format("parquet").option("path", out).start()
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()

    run()
    closing = vars(stream).get("closing")
    if closing:
        write_closing(spark, closing, "event_time")
        run()
    return spark.read.schema(stream.schema).parquet(out)
