"""The event pipeline in Structured Streaming: ingest, filter, count, slices, sessions, repeats, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


def lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Complete lines of a growing folder; the checkpoint is the durable cursor."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def parsed(rows: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; what does not parse has no seq and is left to the caller."""
    return rows.select(F.from_json(column, EVENT).alias("e"), column).select("e.*", column)


def received(bodies: DataFrame, *keep: str) -> DataFrame:
    """(ts, content, event_type, source, and the columns to keep) of posted bodies (ts, path, body): JSON or plain text; empty strings count as absent."""
    j = lambda name: F.nullif(F.get_json_object("body", f"$.{name}"), F.lit(""))
    path = F.nullif(F.regexp_replace("path", "^/+", ""), F.lit(""))
    return bodies.select(
        "ts",
        F.coalesce(j("message"), j("content"), j("text"), F.col("body")).alias("content"),
        F.coalesce(j("event_type"), j("type"), F.lit("webhook")).alias("event_type"),
        F.coalesce(j("source"), path, F.lit("unknown")).alias("source"),
        *keep,
    )


def fates(rows: DataFrame, noise: dict[str, str]) -> DataFrame:
    """Rows with ``fate``: completed jobs whose text is known noise are dropped, anything else is delivered."""
    quiet = F.lit(False)
    for job, pattern in noise.items():
        quiet = quiet | ((F.col("meta")["job"] == job) & F.col("content").rlike(pattern))
    done = (F.col("meta")["event_type"] == "job_complete") & (F.col("meta")["status"] == "ok")
    return rows.withColumn("fate", F.when(F.coalesce(done & quiet, F.lit(False)), "dropped").otherwise("delivered"))


def slices(rows: DataFrame, key: str, at: str = "ts", late: str = "10 minutes", least: int = 3) -> DataFrame:
    """Ten-minute windows every five minutes with enough rows."""
    out = rows.withWatermark(at, late).groupBy(F.window(at, "10 minutes", "5 minutes"), key).agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(key, F.col("window.start").alias("start"), "n")


def sessions(rows: DataFrame, key: str, at: str = "ts", gap_minutes: int = 120, late: str = "10 minutes") -> DataFrame:
    """Sessions that end where the gap is reached; the window's own gap is closed, hence a microsecond less."""
    gap = f"{gap_minutes * 60_000_000 - 1} microseconds"
    out = rows.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return out.select(key, F.col("session_window.start").alias("start"), "last", "n")


def once(rows: DataFrame, key: str, at: str = "ts", ttl: str = "60 seconds") -> DataFrame:
    """The first row of each key within the time that it is remembered."""
    return rows.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def replayed(rows: DataFrame, cursor: int | None, now, hours: float = 2) -> DataFrame:
    """What a returning consumer gets: rows behind its cursor that are not too old; without a cursor, none."""
    if cursor is None:
        return rows.limit(0)
    return rows.where((F.col("seq") > cursor) & (F.col("ts") >= F.lit(now) - F.make_dt_interval(mins=F.lit(int(hours * 60)))))


def pruned(rows: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows (value) of a queue without old ones; unparseable ones stay."""
    at = F.try_to_timestamp(F.get_json_object("value", "$.ts"))
    return rows.where(at.isNull() | (at >= F.lit(now) - F.make_dt_interval(days=F.lit(days))))


def run_all(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and end; the sink is exactly once by its checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered(rows: DataFrame, order: list[str], line: str, most: int = 10 << 20) -> DataFrame:
    """Rows of a log with file and seq: a file ends once ``most`` bytes are written, and seq begins anew in each.

    One log is one sequence; ``order`` must tell its rows apart. Bytes are added up by windows over the log's key.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy("log").orderBy(*order)
    size = F.octet_length(line) + 1
    before = F.coalesce(F.sum(size).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("file", F.floor(before / most).cast("long"))
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("log", "file").orderBy(*order)) - 1).cast("long"))


def unseen(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Rows (file, seq) behind the last seq seen of their file; a file not seen before counts whole."""
    return rows.join(last.select("file", F.col("seq").alias("_last")), "file", "left").where("_last is null or seq > _last").drop("_last")


def leases(beats: DataFrame, now, stale: int = 120) -> DataFrame:
    """(queue, holder, live) of heartbeats (queue, holder, at): the newest beat holds the lease, until it is stale."""
    last = beats.groupBy("queue").agg(F.max(F.struct("at", "holder")).alias("l"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("l.at").cast("timestamp"))
    return last.select("queue", F.col("l.holder").alias("holder"), (age <= stale).alias("live"))


def run_every(stream: DataFrame, path: str, checkpoint: str, seconds: int = 2):
    """A query that polls by micro-batches until it is stopped."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
