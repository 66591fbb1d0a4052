"""The same logic over arriving rows.

Late rows: a watermark bounds state; rows later than it reach only the ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.conf import DEFAULT, Config
from attestry.operators import store
from attestry.operators.ledger import audit_row, latest_per_key
from attestry.session import cut_lineage, own_stages
from attestry.sources.corpus import spread
from attestry.streaming import ordered

TERMINAL = ("ok", "error", "skipped")


# --- running ------------------------------------------------------------------------------


def land(
    stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append",
    change: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Process everything available, one folder per batch under `path`.

    A batch replayed after a failure overwrites its own folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_on_disk(stream.sparkSession):
        return (
            stream.writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need and
    which leaves large state out of the heap.  A stream takes its settings along when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with their number in `batch`."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


# --- T1 -----------------------------------------------------------------------------------


def writer_of(checkpoint: str) -> str:
    """A stream's name in a store: batch numbers mean something beside their checkpoint only."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def merge_batch(
    spark: SparkSession, screen: Callable[[DataFrame], DataFrame], path: str, writer: str
) -> Callable[[DataFrame, int], None]:
    """What is done with a micro-batch: its reports become one commit of the store under the
    batch's number.  A batch that comes again after a failure finds its commit and changes nothing.

    The batch is written first, as a plan reads it in several branches, and read in the caller's
    session: a stream's own one plans without adaptive execution.  Its rows are spread over
    all cores, as a landed file is one part or a few.  The plan's stage tables go when its commit
    is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if any(v.endswith(f".{writer}.{batch_id}") for v in store.committed(spark, path)):
            return
        with own_stages(spark):
            store.commit(screen(spread(cut_lineage(batch, spark))), path, batch_id, writer)

    return write


def stream_screen(
    documents: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Screen newly landed documents into the store at `path`.  `screen` is the batch plan
    itself, so a streamed corpus and a batch corpus give the same rows."""
    return (
        documents.writeStream.foreachBatch(merge_batch(documents.sparkSession, screen, path, writer_of(checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_reports(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest report per key over all batches."""
    return store.current(spark, path, store.newest(keys))


# --- T2 -----------------------------------------------------------------------------------


def stage_rank(status: Column) -> Column:
    """Terminal states win over anything that arrives later."""
    return F.when(status.isin(*TERMINAL), 1).otherwise(0)


def progress(stages: DataFrame, keys: list[str], *, status: str = "status", ts: str = "ts") -> DataFrame:
    """Status per key; the first terminal status sticks, otherwise the latest one.

    A plain aggregate, so the same expression serves the batch and (in update mode) the stream.
    """
    terminal = F.col(status).isin(*TERMINAL)
    return stages.groupBy(*keys).agg(
        F.coalesce(
            F.min_by(F.when(terminal, F.col(status)), F.when(terminal, F.col(ts))),
            F.max_by(status, ts),
        ).alias("status"),
        F.max(ts).alias("last_seen"),
    )


def stream_progress(stages: DataFrame, key: str, conf: Config = DEFAULT, *, keep_hours: float = 24.0) -> DataFrame:
    """T2 over a stream: a row for each key a batch touches.  A key that has been silent for
    `keep_hours` behind the watermark leaves the state; `progress_of` merges what was told."""
    return ordered.progress_stream(stages, key, TERMINAL, conf.watermark, keep_hours)


def progress_of(told: DataFrame, key: str) -> DataFrame:
    """Of each key the first terminal status that was told, else the latest one."""
    return told.groupBy(key).agg(
        F.coalesce(
            F.min(F.when(F.col("done_at").isNotNull(), F.struct("done_at", "status")))["status"],
            F.max_by("status", F.struct("last_seen", "batch")),
        ).alias("status"),
        F.max("last_seen").alias("last_seen"),
    )


def close_open_stages(progress_: DataFrame) -> DataFrame:
    """Stages that never finished are reported as skipped once their run has ended."""
    return progress_.withColumn(
        "status",
        F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("skipped"),
    )


# --- T3 -----------------------------------------------------------------------------------

def _after_ttl(ttl_us: float) -> Callable[[float | None, int], tuple[float, tuple]]:
    def step(last: float | None, now: int) -> tuple[float, tuple]:
        fresh = last is None or now - last >= ttl_us
        return (float(now) if fresh else last), (fresh, 0.0)

    return step


def ttl_dedup(fetches: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """fetches(key, event_id, ts, status_code) → those that are processed.

    An artefact fetched again within the TTL of the fetch that was processed is not processed
    again; only definitive answers are remembered.  Fetches are told once the watermark has
    passed them, in time order; an artefact's state is one number and goes with its TTL.
    """
    definitive = fetches.where(F.col("status_code").isin(200, 404)).select("key", "event_id", "ts")
    ttl_us = conf.ttl_hours * 3600e6
    told = ordered.in_order(definitive, "key", _after_ttl(ttl_us), lambda last: last + ttl_us, conf.watermark)
    return told.where("allowed").select("key", "event_id", "ts")


# --- T4 -----------------------------------------------------------------------------------


def schedule(free_at: float, now: float, spacing: float, burst: float) -> tuple[float, float]:
    """Admit a request or say how long to wait: (new free_at, wait, 0 when admitted).

    A client's requests are spaced evenly on a schedule whose next free place is `free_at`.
    Every admitted request takes a place; one may run ahead of the schedule by burst - 1
    places, and who has paused does not save up more than that.
    """
    place = max(free_at, now)
    ahead = place - now - (burst - 1) * spacing
    return (place + spacing, 0.0) if ahead <= 0 else (free_at, ahead)


def _spacing_us(conf: Config) -> float:
    """Microseconds between two requests at the allowed rate; no rate admits the burst alone."""
    return 60e6 / conf.rate_per_min if conf.rate_per_min > 0 else conf.closed_wait_s * 1e6


def stream_rate_audit(events: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """T4: events(client, event_id, ts) → every event with its verdict; state is one number.

    A client's events are judged in time order whatever batch they come in, as long as they are
    not behind the watermark; a verdict is told when the watermark has passed its event.
    """
    spacing, burst = _spacing_us(conf), conf.burst

    def step(free_at: float | None, now: int) -> tuple[float, tuple]:
        free_at, wait = schedule(free_at or 0.0, now, spacing, burst)
        return free_at, (wait == 0.0, wait / 1e6)

    # a free place in the past says nothing any more
    told = ordered.in_order(events, "client", step, lambda free_at: free_at, conf.watermark)
    return told.select("client", "event_id", "ts", "allowed", "wait_s")


def busy_periods(
    events: DataFrame, key: str, gap_s: float, *, ts: str = "ts", tie: str = "event_id",
    slice_s: int = 86_400,
) -> DataFrame:
    """Add `period`: the start of the run of events without a pause of `gap_s` or more.

    Pauses are found inside fixed slices of time; what came before a slice is read from a small
    table with one row per (key, slice).  A very busy key therefore spreads over as many tasks
    as it has slices, and nothing sorts all of its rows together.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn(
        "_s", F.floor(F.unix_micros(ts) / (slice_s * 1_000_000))
    )
    over = Window.partitionBy(key).orderBy("_s")
    ends = (
        rows.groupBy(key, "_s")
        .agg(F.max(ts).alias("_end"))
        .select(key, "_s", F.lag("_end").over(over).alias("_before"))
    )
    inside = Window.partitionBy(key, "_s").orderBy(ts, tie)
    pause = (F.unix_micros(ts) - F.unix_micros("_prev")) / 1e6
    marked = (
        rows.join(ends, [key, "_s"])
        .withColumn("_prev", F.coalesce(F.lag(ts).over(inside), "_before"))
        .withColumn("_new", F.when(F.col("_prev").isNull() | (pause >= gap_s), F.col(ts)))
    )
    carried = (
        marked.groupBy(key, "_s")
        .agg(F.max("_new").alias("_last"))
        .select(
            key,
            "_s",
            F.last("_last", ignorenulls=True)
            .over(over.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry"),
        )
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(carried, [key, "_s"])
        .withColumn(
            "period", F.coalesce(F.last("_new", ignorenulls=True).over(upto), "_carry")
        )
        .drop("_s", "_before", "_prev", "_new", "_carry")
    )


def rate_audit(events: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """T4 in batch.  After a pause long enough for the whole burst what came before no longer
    matters, so the schedule is followed per (client, busy period).  It streams sorted batches
    and carries one number, so a period is never held in memory.
    """
    spacing, burst = _spacing_us(conf), conf.burst
    periods = busy_periods(events.select("client", "event_id", "ts"), "client", burst * spacing / 1e6)
    # the fold sees plain numbers, so no time zone can touch them on the way through Arrow
    ordered = (
        periods.select(
            "client",
            "event_id",
            F.unix_micros("ts").alias("us"),
            F.unix_micros("period").alias("period"),
        )
        .repartition("client", "period")
        .sortWithinPartitions("client", "period", "us", "event_id")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free_at = None, 0.0
        for batch in batches:
            waits = []
            for client, period, now in zip(batch["client"], batch["period"], batch["us"].tolist(), strict=True):
                if (client, period) != current:
                    current, free_at = (client, period), 0.0
                free_at, wait = schedule(free_at, now, spacing, burst)
                waits.append(wait / 1e6)
            done = batch[["client", "event_id", "us"]].assign(wait_s=waits)
            yield done.assign(allowed=done["wait_s"] == 0.0)[["client", "event_id", "us", "allowed", "wait_s"]]

    done = ordered.mapInPandas(
        fold, "client string, event_id bigint, us bigint, allowed boolean, wait_s double"
    )
    return done.select(
        "client", "event_id", F.timestamp_micros("us").alias("ts"), "allowed", "wait_s"
    )


# --- T5, T6 -------------------------------------------------------------------------------


def stalled(events: DataFrame, key: str, conf: Config = DEFAULT, *, ts: str = "ts") -> DataFrame:
    """T5: work whose events stop for longer than the gap; closed sessions leave the state."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, conf.watermark)
        .groupBy(F.session_window(ts, conf.stall_gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("started"), F.col("w.end").alias("stalled_at"), "n")
    )


def stalled_batch(
    events: DataFrame, key: str, gap_s: float, *, ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """T5 in batch: the same sessions from busy periods."""
    periods = busy_periods(events, key, gap_s, ts=ts, tie=tie)
    return periods.groupBy(key, F.col("period").alias("started")).agg(
        (F.max(ts) + F.make_dt_interval(secs=F.lit(gap_s))).alias("stalled_at"),
        F.count(F.lit(1)).alias("n"),
    )


def audit_counts(events: DataFrame, kind: str, *, ts: str = "ts", width: str = "1 day",
                 conf: Config = DEFAULT) -> DataFrame:
    """Tumbling counts per kind."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, conf.watermark)
        .groupBy(F.window(ts, width).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), kind, "n")
    )


def route_late(
    events: DataFrame, kind: str, path: str, checkpoint: str, *, ts: str = "ts", width: str = "1 day",
    conf: Config = DEFAULT,
) -> StreamingQuery:
    """T6 without loss: tumbling counts of the rows in time, and every other row kept.

    The watermark of a batch is the latest time of all batches before it, less the allowed
    delay, as the engine's own is; a row is late when its window ended at or before it.  A
    batch makes three commits: its counts to `path`/counts, its late rows to `path`/late, and
    last the latest time it has seen to `path`/marks.  Each is known by the batch's number, so
    a batch that comes again adds nothing, and one that was cut short is completed.

    Rows without a time can be in no window and go to the late ones.
    """
    writer, spark = writer_of(checkpoint), events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        with own_stages(spark):
            rows = cut_lineage(batch.withColumn(ts, F.col(ts).cast("timestamp")), spark)
            seen = watermark(spark, path, writer, batch_id)
            # `window` itself drops rows without a time
            timed = rows.where(F.col(ts).isNotNull()).withColumn("_window", F.window(ts, width))
            closed = F.lit(False)
            if seen is not None:
                closed = F.col("_window.end") <= F.lit(seen) - F.expr(f"INTERVAL {conf.watermark}")
            counts = timed.where(~closed).groupBy(F.col("_window.start").alias("day"), kind).agg(F.count(F.lit(1)).alias("n"))
            late = timed.where(closed).drop("_window").unionByName(rows.where(F.col(ts).isNull()))
            store.commit(counts, f"{path}/counts", batch_id, writer)
            store.commit(late, f"{path}/late", batch_id, writer)
            mark = rows.agg(F.max(ts).alias("latest")).select(F.lit(batch_id).alias("batch"), "latest")
            store.commit(mark, f"{path}/marks", batch_id, writer)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watermark(spark: SparkSession, path: str, writer: str, batch_id: int) -> datetime | None:
    """The latest event time of the writer's batches before this one: one row for each."""
    marks = store.stored(spark, f"{path}/marks")
    if marks is None:
        return None
    own = marks.where(F.col("version").contains(f".{writer}.") & (F.col("batch") < batch_id))
    return own.agg(F.max("latest")).first()[0]


def routed_counts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Counts per window and kind over all batches."""
    return store.current(spark, f"{path}/counts", store.summed(["day", kind], ["n"]))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their window had closed."""
    return store.current(spark, f"{path}/late", lambda rows: rows)


def late_ledger(late: DataFrame, key: str, kind: str, at: Column, *, ts: str = "ts") -> DataFrame:
    """Late rows as entries of the append-only ledger."""
    return late.select(*audit_row(F.col(key), "late_row", F.struct(kind, ts), at))
