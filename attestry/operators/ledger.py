"""The append-only ledger around the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import store

AUDIT = "candidate_id string, event string, payload string, at timestamp"


# --- reports ------------------------------------------------------------------------------


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as an aggregate so that a hot key combines early."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    )
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Later rows replace earlier ones of the same key."""
    return latest_per_key(current.unionByName(incoming), keys, order)


def write_reports(reports: DataFrame, path: str, *, number: int | None = None, writer: str = "batch") -> bool:
    """Add reports to the store at `path` as one commit; False if it is already there.

    Without a number it is the writer's next one.  `stored_reports` reads the newest of each key.
    """
    if number is None:
        number = store.next_number(reports.sparkSession, path, writer)
    return store.commit(reports, path, number, writer)


def stored_reports(spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Of each key the report that is last by `order`, else by commit."""
    return store.current(spark, path, store.newest(keys, order))


def append_audit(events: DataFrame, path: str) -> None:
    """Rows are only ever added."""
    events.write.mode("append").parquet(path)


def audit_row(key: Column, event: str | Column, payload: Column, at: Column) -> list[Column]:
    return [
        key.cast("string").alias("candidate_id"),
        (event if isinstance(event, Column) else F.lit(event)).alias("event"),
        F.to_json(payload).alias("payload"),
        at.alias("at"),
    ]


# --- progress -----------------------------------------------------------------------------


def screening_progress(
    items: DataFrame, key: str, done: Column, *, restarted: Column | None = None
) -> DataFrame:
    """Total, done and status; unfinished work found at a restart is interrupted."""
    open_status = F.lit("processing")
    if restarted is not None:
        open_status = F.when(restarted, "interrupted").otherwise("processing")
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.sum(done.cast("int")).alias("done")
    ).withColumn(
        "status", F.when(F.col("done") == F.col("total"), "complete").otherwise(open_status)
    )


# --- decisions and visibility -------------------------------------------------------------


def decision_history(decisions: DataFrame, notes: DataFrame, *, key: str = "audit_id") -> DataFrame:
    """The erasable note beside each decision; entries from before notes moved keep theirs."""
    joined = decisions.join(notes.select(key, F.col("note").alias("_note")), key, "left")
    return joined.withColumn(
        "note",
        F.when(F.col("note_present").isNotNull(), F.coalesce("_note", F.lit(""))).otherwise(
            F.col("legacy_note")
        ),
    ).drop("_note", "legacy_note", "note_present")


def visible_to(rows: DataFrame, acl: DataFrame, *, owner: str = "owner") -> DataFrame:
    """J20 for many readers: a row is kept when any reader may see it."""
    return rows.join(acl.select(owner).distinct(), owner, "left_semi")


def visible_rows(rows: DataFrame, actor: str, *, admin: bool, owner: str = "owner") -> DataFrame:
    """J20 for one reader: admins see everything, others their own; ownerless rows stay hidden."""
    return rows if admin else rows.where(F.col(owner) == actor)


# --- erasure and retention ----------------------------------------------------------------


def erase(
    tables: dict[str, DataFrame], ids: DataFrame, at: Column, *, key: str = "candidate_id",
    processing: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the erased ids, and the ledger rows to append.

    Ids that are still being processed are left alone.  Each erased id gets one row with the
    number of rows removed per table.
    """
    due = ids.select(key).distinct()
    if processing is not None:
        due = due.join(processing.select(key), key, "left_anti")
    kept = {name: df.join(due, key, "left_anti") for name, df in tables.items()}
    counts = due
    for name, df in tables.items():
        n = df.join(due, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias(name))
        counts = counts.join(n, key, "left")
    counts = counts.fillna(0, list(tables))
    total = sum((F.col(n) for n in tables), F.lit(0))
    events = counts.where(total > 0).select(
        *audit_row(F.col(key), "erased", F.struct(*tables), at)
    )
    return kept, events


def retention(
    tables: dict[str, DataFrame], retain_days: int, now: Column, *, created: str = "created_at"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table's rows that are at most `retain_days` old, and one ledger row.

    The row says how many rows of each table were dropped, and the days; there is none when
    nothing was.
    """
    cutoff = now - F.make_dt_interval(days=F.lit(retain_days))
    kept = {name: df.where(F.col(created) >= cutoff) for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        n = df.where(F.col(created) < cutoff).agg(F.count(F.lit(1)).alias(name))
        counts = n if counts is None else counts.join(F.broadcast(n))
    payload = F.struct(*tables, F.lit(retain_days).alias("retain_days"))
    event = counts.where(sum((F.col(n) for n in tables), F.lit(0)) > 0).select(
        *audit_row(F.lit("*"), "retention_purge", payload, now)
    )
    return kept, event
