"""Streaming forms of ingest, daily usage and stale-item detection; each ends with all available files and equals its batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..sources.store import first_by


def read_files(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream over the Parquet files at a path (a file, a folder or a pattern), with the schema they have now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")


def _written(spark: SparkSession, pattern: str) -> dict[int, str]:
    """Folders of a pattern that were written whole, by the number that ends their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    folders = [f.getPath().getParent() for f in found or []]
    return {int("".join(c for c in f.getName() if c.isdigit())): f.toString() for f in folders}


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def merged(spark: SparkSession, target: str, key: str) -> DataFrame | None:
    """The table of ``ingest`` as it stands: the last version and the deltas after it, merged as they are read; None if nothing ever came.

    Of a key, the row of the last batch counts, with the id of the first.
    """
    versions, deltas = _written(spark, f"{target}/v*"), _written(spark, f"{target}/delta/batch*")
    last = max(versions, default=-1)
    parts = [(last, versions[last])] if versions else []
    parts += [(n, path) for n, path in sorted(deltas.items()) if n > last]
    rows = None
    for n, path in parts:
        some = spark.read.parquet(path).withColumn("_batch", F.lit(n))
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    if rows is None or len(parts) == 1 and versions:
        return rows.drop("_batch") if rows is not None else None
    columns = [c for c in rows.columns if c not in (key, "id", "_batch")]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("r"), F.min_by("id", "_batch").alias("id"))
    return one.select(key, "r.*", "id")


def ingest(stream: DataFrame, target: str, key: str, order: str) -> str | None:
    """Upsert every micro-batch into a table by key; returns the path of its last version.

    A micro-batch writes the first of its rows for each key as a delta, in proportion to itself; run again after a failure it writes the same delta.
    The deltas are merged as they are read (``merged``), and once all available files are in, into a new version of the
    table, which replaces them. A restart without new files returns the version that is there; None only if nothing ever came.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        rows = first_by(df, key, order).withColumn("id", F.concat(F.lit("new-"), F.col(order).cast("string")))
        rows.write.mode("overwrite").parquet(f"{target}/delta/batch{number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    versions, deltas = _written(spark, f"{target}/v*"), _written(spark, f"{target}/delta/batch*")
    last = max(versions, default=-1)
    if max(deltas, default=-1) > last:
        last = max(deltas)
        merged(spark, target, key).write.mode("overwrite").parquet(f"{target}/v{last}")
        for n, path in deltas.items():
            if n <= last:
                _remove(spark, path)
    return f"{target}/v{last}" if last >= 0 else None


def _closed(events: DataFrame, aggregate, target: str | None = None, end: bool = True) -> DataFrame:
    """What a windowed aggregation of a stream (with ts) gives in append mode, as a table in the shared folder.

    Windows are emitted once the watermark has passed them, and their state is dropped; later rows
    for them are not counted. With ``end`` a sentinel row of the far future follows all available
    rows and closes the windows that are still open; without it a later call with the same ``target`` goes on. Once ended,
    a target takes no more calls, as every later row would be late.
    """
    spark = events.sparkSession
    target = target or scratch(spark)
    far = F.lit("9000-01-01 00:00:00").cast("timestamp")
    blank = spark.range(1).select(*[(far if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    blank.where(F.lit(False)).write.mode("append").parquet(f"{target}/sentinel")
    if not spark.read.schema(events.schema).parquet(f"{target}/sentinel").isEmpty():
        raise ValueError(f"{target} was ended: later rows would all be late")
    ends = spark.readStream.schema(events.schema).parquet(f"{target}/sentinel")

    def run() -> DataFrame:
        rows = aggregate(events.unionByName(ends))
        sink = lambda found, number: found.write.mode("overwrite").parquet(f"{target}/out/batch={number}")
        query = rows.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return rows

    rows = run()
    if end:
        blank.write.mode("append").parquet(f"{target}/sentinel")
        run()
    return spark.read.schema(rows.schema).parquet(f"{target}/out")


def daily_usage(events: DataFrame, delay: str = "1 day", target: str | None = None, end: bool = True) -> DataFrame:
    """(day, attempts, errors) of a stream of events (ts, event_type), by tumbling windows of a day; rows later than ``delay`` are dropped."""

    def by_day(rows: DataFrame) -> DataFrame:
        return rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors"))

    found = _closed(events.select("ts", "event_type"), by_day, target, end)
    return found.where("window.start < timestamp'8999-01-01'").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "attempts", "errors")


def stale_items(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour", finished: tuple[str, ...] = ("purchase",), target: str | None = None, end: bool = True) -> DataFrame:
    """(user_id, started, events, last_type) of items left unfinished: no event for ``gap`` after one that does not finish the item.

    Each run of activity of an item is a session; it is emitted once, when the watermark has passed its end, and its state goes. A session whose
    last event is one of ``finished`` is never emitted.
    """

    def by_session(rows: DataFrame) -> DataFrame:
        found = rows.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
        return found.where(F.col("last_type").isNull() | ~F.col("last_type").isin(*finished))

    found = _closed(events.select("user_id", "ts", "event_id", "event_type"), by_session, target, end)
    return found.where("w.start < timestamp'8999-01-01'").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events", "last_type")
