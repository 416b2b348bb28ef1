"""Push events as a stream: deduplication, keyed pending jobs, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.events import first_deliveries


def table_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A given table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def deduplicated_within(events: DataFrame, horizon: str = "7 days") -> DataFrame:
    """The same with bounded state: a delivery later than ``horizon`` may count again."""
    timed = events.filter("external_id is not null and new_commit is not null").withColumn("received", F.col("received_at").cast("timestamp")).withWatermark("received", horizon)
    return timed.dropDuplicatesWithinWatermark(["external_id", "new_commit"])


def keep_first_deliveries(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's first deliveries and counts as a part of the table at ``path``.

    A part is overwritten where its batch is replayed, so nothing counts twice; ``first_of_all`` puts the parts together.
    Batches never read what is there, and no key is kept in memory between them.
    """

    def step(batch: DataFrame, number: int) -> None:
        first = first_deliveries(batch, "received_at")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_all(spark: SparkSession, path: str) -> DataFrame:
    """``external_id, new_commit, event_no, deliveries``: over all parts the first event received of each commit, whatever the batches were."""
    parts = spark.read.parquet(path)
    return parts.groupBy("external_id", "new_commit").agg(F.min_by("event_no", F.struct("received_at", "event_no")).alias("event_no"), F.sum("deliveries").alias("deliveries"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their values by window and type; windows close once the watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events that follow one another within ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), "n_events")


def closed_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window to the files at ``path`` once the watermark has passed its end; its state is then dropped."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
