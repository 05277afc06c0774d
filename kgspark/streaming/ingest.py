"""Edge records that arrive as JSON lines, appended to a saved graph batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.sources.folders import shared_dir
from kgspark.sources.store import from_json, save_edges


def append_edges(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads new files of a folder and adds their edges to a saved graph, in its layout; a batch that is run again takes its own place."""
    lines = spark.readStream.schema("value string").text(folder)

    def put(batch: DataFrame, number: int) -> None:
        seq = F.lit((number + 1) << 40) + F.monotonically_increasing_id()
        edges = from_json(batch.limit(0).select(F.col("value").alias("json"), F.lit(0).cast("long").alias("seq")), batch.select(F.col("value").alias("json"), seq.alias("seq"))).edges
        save_edges(edges, target, number + 1)

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted(rows: DataFrame, key: str, time_col: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Records of each key and window of event time in a stream; what is later than `late` is left out."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("records")).select("window.start", "window.end", key, "records")


def edge_counts(spark: SparkSession, folder: str, schema: str, time_col: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Records of each predicate and window, from JSON lines."""
    return counted(spark.readStream.schema(schema).json(folder), "predicate", time_col, late, window)


def drained(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has given when all input that is there now is read, as a table in the shared folder."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")
