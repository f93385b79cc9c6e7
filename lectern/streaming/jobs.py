"""Structured Streaming counterparts of the table operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions import gates
from lectern.operators import cache, ingest, ordered, progress
from lectern.session import shared_folder
from lectern.sinks import tables

OUT_ROWS = 1 << 16


def read_table_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files of one table in a folder: a file of that name, or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # A stream reads folders: a single file is picked from its own by name.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Run what has arrived through ``foreachBatch``, then stop (availableNow)."""
    where = checkpoint or shared_folder(stream.sparkSession, "stream")
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()


def attempt_counters(attempts: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running counters kept in a keyed table; only changed counters are written."""
    keys = ["user_id", *progress.QUESTION_KEY]

    def write(batch: DataFrame, _: int) -> None:
        tables.upsert(batch, path, keys, ["attempts"])

    return start(progress.attempt_counts(attempts), write, "update", checkpoint)


def feedback(logs: DataFrame, path: str, review: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append every log row as JSON, and the low-confidence ones to a review log."""

    def write(batch: DataFrame, number: int) -> None:
        # One folder per micro-batch: a retried batch replaces its own output.
        batch.persist()
        batch.write.mode("overwrite").json(f"{path}/batch={number}")
        batch.where(gates.low_confidence(F.col("confidence"))).write.mode("overwrite").json(f"{review}/batch={number}")
        batch.unpersist()

    return start(logs, write, "append", checkpoint)


def incremental_ingest(
    docs: DataFrame, path: str, checkpoint: str | None = None, failed: str | None = None, order: str | None = None, **size
) -> StreamingQuery:
    """Chunk arriving documents; a document seen again replaces all its chunks, also by fewer or none.

    The newest document by the column ``order`` stays, or by time of arrival where
    there is none, whatever the checkpoint. Documents that fail are appended to
    ``failed`` (beside the table unless given) and leave stored chunks alone.
    """
    failures = failed or f"{path.rstrip('/')}-failed"
    keys = ["collection", "doc_id"]

    def write(batch: DataFrame, number: int) -> None:
        seq = F.col(order).cast("long") if order else F.unix_micros(F.current_timestamp())
        # A document that comes twice in one batch: the newest, and of equals the one with the greatest columns.
        once = tables.latest(batch.withColumn("seq", seq), keys, ["seq", *[c for c in batch.columns if c not in keys]]).persist()
        chunks = ingest.chunk_documents(once, **size)
        # One folder per checkpoint and batch: a batch that is retried replaces its own output.
        run = hashlib.md5(where.encode()).hexdigest()[:12]
        chunks.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{failures}/run={run}/batch={number}")
        rows = chunks.where("error IS NULL").withColumn("id", ingest.chunk_key(F.col("collection"), F.col("doc_id"), F.col("chunk_id")))
        sound = once.where("text IS NOT NULL").select(*keys, "seq")
        tables.replace_groups(rows.where("text IS NOT NULL").drop("error"), sound, path, keys, "seq", within=["collection"], buckets=4)
        once.unpersist()

    where = checkpoint or shared_folder(docs.sparkSession, "stream")
    return start(docs, write, "append", where)


def semantic_cache(
    requests: DataFrame, entries_path: str, hits_path: str, threshold: float = 0.88, ttl: int = cache.TTL, checkpoint: str | None = None
) -> StreamingQuery:
    """Answer each micro-batch from the cache table, then add its misses as new entries. The table may not exist yet.

    What a batch writes lies under its checkpoint's name and its number, so a batch
    that is retried replaces its own rows, and another run adds to them.
    """
    where = checkpoint or shared_folder(requests.sparkSession, "stream")
    run = hashlib.md5(where.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        entries = tables.read_table(spark, entries_path)
        if entries is None:
            entries = batch.withColumnRenamed("request_id", "entry_id").limit(0)
        else:
            entries = entries.where(~((F.col("run") == run) & (F.col("batch") >= number)))
        hits = cache.semantic_hits(batch, entries, threshold, ttl)
        here = f"run={run}/batch={number}"
        hits.write.mode("overwrite").parquet(f"{hits_path}/{here}")
        answered = spark.read.parquet(f"{hits_path}/{here}")
        new = cache.misses(batch, answered).withColumnRenamed("request_id", "entry_id")
        new.write.mode("overwrite").parquet(f"{entries_path}/{here}")
        batch.unpersist()

    return start(requests, write, "append", where)


def keyed_scan(stream: DataFrame, key: str, us: str, tie: str, step: ordered.Step, keep: int, name: str, delay: str = "10 minutes") -> DataFrame:
    """R2 / R3 as keyed streaming state.

    ``stream`` needs an event time column ``ts``. Rows of a micro-batch are taken
    in time order; the state of a key is dropped ``keep`` microseconds after its
    last row, once the watermark is past it. The same ``step`` serves the table
    form, so both give the same answers on rows that arrive in order.
    """
    cols = [f for f in stream.schema.fields]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values([us, tie])
        state = ordered.restore(list(held.get[0])) if held.exists else None
        answers = []
        for time in rows[us]:
            state, answer = step(state, time)
            answers.append(answer)
        held.update((ordered.dump(state),))
        until = int(rows[us].iloc[-1] + keep) // 1000 + 1
        held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))
        for at in range(0, len(rows), OUT_ROWS):
            yield rows.iloc[at: at + OUT_ROWS].assign(**{name: answers[at: at + OUT_ROWS]})

    return stream.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        run, f"{fields}, `{name}` boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limiter(stream: DataFrame, key: str, us: str, tie: str, span: int = 60_000_000, limit: int = 10) -> DataFrame:
    """R3"""
    return keyed_scan(stream, key, us, tie, ordered.limit_step(span, limit), span, "accepted")


def ttl_cache(stream: DataFrame, key: str, us: str, tie: str, ttl: int = cache.TTL) -> DataFrame:
    """R2"""
    return keyed_scan(stream, key, us, tie, ordered.ttl_step(ttl), ttl + 1, "hit")


def append_to(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once."""
    where = checkpoint or shared_folder(stream.sparkSession, "stream")
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", where)
        .outputMode("append").trigger(availableNow=True).start()
    )
