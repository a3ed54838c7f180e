"""Incremental ingestion of article files as streams: passages, then their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators.chunking import ChunkRules, chunk_documents
from siltstone.operators.embedding import Embedder, embedded, hashed

ARTICLE = "doc_id long, title string, url string, text string"


def _stored(spark: SparkSession, target: str, number: int, key: str) -> DataFrame | None:
    """Keys that other batches have written, or None where nothing is written yet."""
    try:
        return spark.read.parquet(target).where(F.col("batch") != number).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _each(stream: DataFrame, make, target: str, checkpoint: str, poll: str | None, key: str) -> StreamingQuery:
    """Write what ``make`` gives of each batch, without keys that are stored. A batch that is run again overwrites its
    own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        rows, old = make(batch), _stored(batch.sparkSession, target, number, key)
        rows = rows if old is None else rows.join(old, key, "left_anti")
        rows.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=poll) if poll else query.trigger(availableNow=True)).start()


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, rules: ChunkRules = ChunkRules(), poll: str | None = None, failures: str | None = None) -> StreamingQuery:
    """Passages of every new file under ``source``, appended to ``target``; once over what is there, or every
    ``poll``. Passages that are stored already, of an article that comes again, are passed over. Articles that fail
    go to ``failures`` with the error, where that is given."""

    def make(batch: DataFrame) -> DataFrame:
        made = chunk_documents(batch, rules)
        if failures:
            made.where("error is not null").select("doc_id", "title", "error").write.mode("append").parquet(failures)
        return made.where("error is null").drop("error")

    return _each(spark.readStream.schema(ARTICLE).parquet(source), make, target, checkpoint, poll, "chunk_id")


def embed_stream(spark: SparkSession, passages: str, target: str, checkpoint: str, embed: Embedder = hashed(), poll: str | None = None) -> StreamingQuery:
    """Vectors of every new file of passages, a second stream behind ``ingest``."""
    stream = spark.readStream.schema("chunk_id long, text string").parquet(passages)
    return _each(stream, lambda batch: embedded(batch, embed), target, checkpoint, poll, "chunk_id")


def rolling_latency(logs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean by window and endpoint over a stream or a table of (ts, event_type, value)."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if logs.isStreaming else logs
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
