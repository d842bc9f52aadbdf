"""Streams: files that arrive, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalens.sources.tables import Table


def arriving_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files as they arrive below path."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("content").cast("string").alias("content"))


def on_arrival(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every file that is new goes to handle, at least once: a batch that was under way when the stream stopped comes
    again, with its number. stored() and ingest() count such a batch once."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(stream: DataFrame, table: Table, name: str, checkpoint: str) -> StreamingQuery:
    """The stream's rows in a stored table, each once: the table's commit holds the number of the last batch of the
    sink `name`, and a batch that is there is skipped. A new checkpoint begins its numbers anew and needs a new name."""
    return on_arrival(stream, lambda rows, batch: _once(table, rows, name, batch), checkpoint)


def _once(table: Table, rows: DataFrame, name: str, batch: int) -> int:
    return table.append(rows, (name, batch))


STATUS = "path string, status string, error string, rows bigint, batch bigint"


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], table: Table, status: Table, name: str, checkpoint: str) -> StreamingQuery:
    """Files (path, content) that arrive, parsed to the table's rows, and a row of the status table for each file.

    parse: files to rows (path, error, the table's columns); rows with an error are not
    stored and make the file `failed`, a file of which no row comes is `empty`
    (Spark passes over files of no bytes), others are `processed`. Table and
    status take a batch once each, so a stop between the two is made good when the batch comes again.
    """

    def handle(batch_rows: DataFrame, batch: int) -> None:
        batch_rows = batch_rows.persist()
        try:
            parsed = parse(batch_rows).persist()
            try:
                _once(table, parsed.where("error IS NULL"), name, batch)
                facts = parsed.groupBy("path").agg(F.min("error").alias("error"), F.count_if(F.col("error").isNull()).alias("rows"))
                kind = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("rows", F.lit(0)) == 0, "empty").otherwise("processed")
                said = batch_rows.select("path").join(facts, "path", "left").select("path", kind.alias("status"), "error", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(batch).cast("bigint").alias("batch"))
                _once(status, said, name, batch)
            finally:
                parsed.unpersist()
        finally:
            batch_rows.unpersist()

    return on_arrival(files, handle, checkpoint)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
