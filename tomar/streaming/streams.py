"""Structured Streaming: feedback counts, windowed events, the live tail and the index that follows its register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomar.operators.metrics import feedback_patterns
from tomar.sources.readers import FEEDBACK


def json_stream(spark: SparkSession, folder: str, schema: str = FEEDBACK) -> DataFrame:
    """A folder of line-delimited JSON as a stream; bad lines give rows of nulls, which are left out."""
    frame = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)
    return frame.where(" or ".join(f"{c} is not null" for c in frame.columns))


def feedback_counts(rows: DataFrame) -> DataFrame:
    """Counts of corrections by pattern, kept up to date."""
    return feedback_patterns(rows, "tahmin_tur", "dogru_tur")


def windowed(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) in tumbling or sliding windows; events later than the mark are left out."""
    frame = events.withWatermark("ts", late) if events.isStreaming else events
    return frame.groupBy(F.window("ts", length, slide or length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events(ts, user_id) with a gap."""
    frame = events.withWatermark("ts", late) if events.isStreaming else events
    return frame.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tail(rows: DataFrame, n: int = 6, order: str = "id") -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest rows of a stream in the view 'son_kayitlar'."""
    kept: list = []

    def run(batch: DataFrame, _: int) -> None:
        nonlocal kept
        kept = sorted([*kept, *batch.orderBy(F.desc(order)).limit(n).collect()], key=lambda r: -r[order])[:n]
        batch.sparkSession.createDataFrame(kept, batch.schema).createOrReplaceTempView("son_kayitlar")

    return run


def refreshing(build: Callable[[DataFrame], None], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends a stream to a register and builds its index anew when it has grown."""
    size = -1

    def run(batch: DataFrame, _: int) -> None:
        nonlocal size
        batch.write.mode("append").parquet(path)
        whole = batch.sparkSession.read.parquet(path)
        now = whole.count()
        if now != size:
            size = now
            build(whole)

    return run


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into a memory table and stop."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
