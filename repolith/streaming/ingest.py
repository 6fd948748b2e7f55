"""Continuous ingest of knowledge documents: new files of a folder are upserted into a store, the latest row of each id wins.

State lies in the store and in the stream's checkpoint folder, so that a restarted stream neither loses nor repeats rows. A batch is
deduplicated before it is merged; only the repositories that occur in it are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolith.sources.tables import latest


def merge_batch(spark: SparkSession, batch: DataFrame, store: str) -> None:
    """Writes batch into the store at `store`, a parquet folder partitioned by repository."""
    new = latest(batch, ["doc_id"], F.col("indexed_at").desc_nulls_last(), F.col("title"), F.col("source_path")).where("repo_id is not null")
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    touched = new.select("repo_id").distinct()
    if exists:
        kept = spark.read.schema(batch.schema).parquet(store).join(touched, "repo_id", "left_semi")
        new = latest(kept.unionByName(new), ["doc_id"], F.col("indexed_at").desc_nulls_last(), F.col("title"), F.col("source_path"))
    # the partitions that are read are replaced, so the result is written out before
    staged = new.checkpoint(eager=True)
    staged.repartition("repo_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(store)


def ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Starts a stream over the parquet files that appear in `source`; each micro-batch takes all that is there, then the stream ends."""
    from repolith.session import checkpoint_dir

    checkpoint_dir(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and errors per window and user, from a stream or a table; rows later than `late` behind the newest are dropped by a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        marked.groupBy(F.window("ts", width).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(F.col("w.start").alias("window_start"), "user_id", "events", "errors")
    )
