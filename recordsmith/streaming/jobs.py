"""Stream jobs over the lookup log; each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import instruction_risk, sanitize_text


def read_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 1000) -> DataFrame:
    """A file stream over one table of a folder, a file or a folder of files, so many files a batch, its time as a zoned timestamp."""
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    files_of = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if files_of.exists(table) and files_of.getFileStatus(table).isDirectory():
        df = reader.parquet(f"{folder}/{name}.parquet")
    else:
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def record_state(events: DataFrame) -> DataFrame:
    """The latest outcome of each record: state is one row a record, updated by key."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"), F.max("event_id").alias("last_event"))


def daily_rollup(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Counts and sums by day; a day is final, and its state dropped, once the watermark passes it."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    day = F.window("ts", "1 day")
    out = timed.groupBy(day).agg(F.count("*").alias("records"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total_value"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "records", "failed", F.round("total_value", 4).alias("total_value"))


def daily_sketches(events: DataFrame, delay: str = "2 days", k: int = 1000) -> DataFrame:
    """(date, records, sketch): a quantile sketch (KLL) of each day's values, which adds up to longer periods.

    The state of a day is one sketch of bounded size, whatever its rows.
    """
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", "1 day")).agg(F.count("value").alias("records"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "records", "sketch")


def monthly_percentiles(days: DataFrame, points: dict[str, float]) -> DataFrame:
    """(month, records, one column for each point) from daily sketches, merged and never made again from rows.

    With k = 1000 the rank of a point is within 1 percent of the wanted one.
    """
    merged = days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.sum("records").alias("records"), F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select("month", "records", *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(name) for name, p in points.items()])


#: What cache_uses() makes of a request.
USE = "user_id long, event_id long, live boolean"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Uses(StatefulProcessor):
    """The last use of a key, forgotten by a timer when the horizon has passed."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        us, ids = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("us", "event_id"))
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        before = self.last.get()[0] if self.last.exists() else None
        start = -(2**62) if before is None else before
        latest = np.maximum(np.maximum.accumulate(us), start)
        live = us - np.concatenate([[start], latest[:-1]]) >= self.horizon
        if before is not None:
            self.handle.deleteTimer((before + self.horizon) // 1000 + 1)
        self.last.update((int(latest[-1]),))
        self.handle.registerTimer((int(latest[-1]) + self.horizon) // 1000 + 1)
        yield pd.DataFrame({"user_id": np.full(len(ids), key[0]), "event_id": ids, "live": live})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"user_id": [], "event_id": [], "live": []}).astype({"user_id": "int64", "event_id": "int64", "live": "bool"})

    def close(self) -> None:
        pass


def cache_uses(events: DataFrame, horizon: timedelta, delay: str = "1 hour") -> DataFrame:
    """(user_id, event_id, live): whether a request is live, or a hit of what its key's last request left in the cache.

    A use keeps the entry for the horizon; after that it is forgotten, and the key's next request is
    live again. On a stream the state is one time a key, and a timer takes it away; rows
    later than the watermark are dropped. The batch twin looks at each request's predecessor.
    """
    long = int(horizon.total_seconds() * 1_000_000)
    if events.isStreaming:
        keyed = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay).groupBy("user_id")
        return keyed.transformWithStateInPandas(_Uses(long), USE, "append", "eventTime")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    previous = F.lag(us).over(by)
    return events.select("user_id", "event_id", (previous.isNull() | (us - previous >= long)).alias("live"))


def redaction(docs: DataFrame) -> DataFrame:
    """Cleaned text and risk of each row; stateless, so the same on a stream."""
    return docs.select("doc_id", F.md5(sanitize_text(F.col("text"))).alias("clean_md5"), instruction_risk(F.col("text")).alias("risk"))


def retention(events: DataFrame, cutoff: str, delay: str = "1 day") -> DataFrame:
    """Rows at or after the cutoff, once each by event_id.

    On a stream, rows later than the watermark are dropped too; run_counted() tells how many.
    """
    kept = events.where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else kept.dropDuplicates(["event_id"])


def run_available(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Run a stream over what is there now; its result as a table of the shared folder.

    A micro-batch that is run again overwrites its own folder, so nothing counts
    twice. In update mode every batch brings the rows that changed, which go to an UpsertTable by key.
    """
    return run_counted(spark, stream, folder, mode, key)[0]


def run_counted(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", key: str | None = None) -> tuple[DataFrame, int]:
    """As run_available, with the number of rows that came later than the watermark and were dropped, from the query's progress."""
    run = uuid.uuid4().hex
    out, state = f"{folder}/stream-{run}", f"{folder}/state-{run}"
    table = UpsertTable(spark, out, key) if mode == "update" else None

    def sink(batch: DataFrame, epoch: int) -> None:
        if table:
            table.merge(batch, epoch)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)  # timers need this store
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if table:
        return table.read(stream.schema), dropped
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(*stream.columns), dropped


class UpsertTable:
    """A table of one row a key, which micro-batches of changed rows are merged into.

    Rows are dealt to buckets by the hash of the key. A batch rewrites the buckets
    that it changes as a version of its own (epoch=e/bucket=b), from the latest versions
    of earlier batches. So a batch that is run again changes nothing, and a
    reader takes each bucket's latest version. What earlier batches replaced is
    deleted when the next one begins: there are two versions of a bucket at most.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _versions(self, until: int | None = None) -> dict[int, list[int]]:
        """The epochs of each bucket, the latest last; only whole batches before `until` count."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[int, list[int]] = {}
        for batch in files.listStatus(place) if files.exists(place) else []:
            name = batch.getPath().getName()
            epoch = int(name[6:]) if name.startswith("epoch=") else -1
            if epoch >= 0 and (until is None or epoch < until) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")):
                for bucket in files.listStatus(batch.getPath()):
                    if bucket.getPath().getName().startswith("bucket="):
                        found.setdefault(int(bucket.getPath().getName()[7:]), []).append(epoch)
        return {b: sorted(epochs) for b, epochs in found.items()}

    def _load(self, latest: dict[int, int], schema: T.StructType) -> DataFrame:
        if not latest:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/epoch={e}/bucket={b}" for b, e in sorted(latest.items())])

    def merge(self, changed: DataFrame, epoch: int) -> None:
        """The rows of changed replace those of their keys; a key stands in it once."""
        versions = self._versions(epoch)
        for b, epochs in versions.items():
            for e in epochs[:-1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={e}/bucket={b}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        incoming = f"{self.path}-incoming"  # the batch is computed once, and aside
        changed.write.mode("overwrite").parquet(incoming)
        new = self.spark.read.schema(changed.schema).parquet(incoming)
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most the buckets
        old = self._load({b: versions[b][-1] for b in touched if b in versions}, changed.schema)
        merged = old.join(new.select(self.key), self.key, "left_anti").select(*changed.columns).unionByName(new)
        merged.withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")

    def read(self, schema: T.StructType) -> DataFrame:
        return self._load({b: epochs[-1] for b, epochs in self._versions().items()}, schema)


def run_with_late(spark: SparkSession, stream: DataFrame, folder: str, *, time: str = "ts", delay: timedelta = timedelta(days=1)) -> tuple[DataFrame, DataFrame]:
    """(kept, late): a stream's rows, those that came later than the watermark in a table of their own.

    The watermark of a batch is the latest time of the batches before it, less the
    delay; each batch notes its latest time beside its rows, so one that is run again splits alike.
    """
    run = uuid.uuid4().hex
    out, state = f"{folder}/split-{run}", f"{folder}/state-{run}"
    kind = stream.schema[time].dataType

    def sink(batch: DataFrame, epoch: int) -> None:
        seen = None
        if epoch:
            noted = spark.read.schema(T.StructType([T.StructField("latest", kind), T.StructField("epoch", T.IntegerType())])).parquet(f"{out}/latest")
            seen = noted.where(F.col("epoch") < epoch).agg(F.max("latest")).first()[0]
        late = F.lit(False) if seen is None else F.coalesce(F.col(time) < F.lit(seen - delay).cast(kind), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/epoch={epoch}")
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{out}/latest/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField("late", T.BooleanType())])).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    return tuple(rows.where(F.col("late") == which).select(*stream.columns) for which in (False, True))
