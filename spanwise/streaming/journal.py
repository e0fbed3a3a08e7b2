"""Journals as streams: deduplicated events, windows with late data, and incremental exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanwise.functions.text import canonical
from spanwise.operators.lexical import grams


def counted(events: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "10 days") -> DataFrame:
    """Events by window and kind, each event id once; events later than ``late`` are dropped. Works on streams and tables."""
    out = events.withWatermark(ts, late)
    out = out.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else out.dropDuplicates(["event_id"])
    return out.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def new_lines(lines: DataFrame, items: DataFrame, k: int = 13, per_line: int | None = None) -> DataFrame:
    """(line, item, gram) for a stream of (line, text) against the fixed items: what new corpus lines expose."""
    own = grams(items, "item", k)
    texts = lines.select("line", canonical(F.col("text")).alias("text"))
    return grams(texts, "line", k, per_line).join(own, "gram").select("line", "item", "gram")


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there and writes parquet, exactly once a micro-batch."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 days") -> DataFrame:
    """(by, start, end, n): runs of events of one kind with less than ``gap`` between them, each event id once. Works on streams and tables."""
    out = events.withWatermark(ts, late)
    out = out.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else out.dropDuplicates(["event_id"])
    return out.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(by, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def latest_per_key(df: DataFrame, key: str, ts: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key. A micro-batch rewrites only the buckets of keys that it touches; ``latest_rows`` reads the table.

    Each version holds the buckets that it rewrote, and an index of which version holds each bucket. A batch that is repeated writes the same
    version again. Buckets that no index of the last two versions names are removed.
    """

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
        index = _index(spark, path, version - 1)
        old = _read(spark, path, {b: index[b] for b in touched if b in index})
        both = batch if old is None else old.select(*batch.columns).unionByName(batch)
        newest = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where("_r = 1").drop("_r")
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{version}")
        spark.createDataFrame([*{**index, **dict.fromkeys(touched, version)}.items()], "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{path}/index/v{version}")
        before = _index(spark, path, version - 2)
        for b in touched:
            if b in before and index.get(b) != before[b]:
                _remove(spark, f"{path}/v{before[b]}/bucket={b}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The table that ``latest_per_key`` keeps, as of a version; None where there is none."""
    return _read(spark, path, _index(spark, path, version))


def _index(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    if version < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").json(f"{path}/index/v{version}").collect()}


def _read(spark: SparkSession, path: str, index: dict[int, int]) -> DataFrame | None:
    parts = [spark.read.option("basePath", f"{path}/v{v}").parquet(*[f"{path}/v{v}/bucket={b}" for b in sorted(index) if index[b] == v]) for v in sorted(set(index.values()))]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
