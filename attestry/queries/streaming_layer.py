"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from attestry.conf import DEFAULT
from attestry.operators import copies
from attestry.plans.assess import Evidence
from attestry.plans.screen import results_rows, screen_corpus
from attestry.queries.metrics_layer import _SCREEN, _SCREEN_RESULT, CONF, _screening_inputs
from attestry.queries.registry import Tables, query
from attestry.queries.text_layer import _SHINGLES
from attestry.session import shared_dir
from attestry.sources.corpus import as_layout
from attestry.streaming import jobs


def _stream(t: Tables, name: str):
    """The table as a file stream, whether it is one file or a folder of files."""
    schema = getattr(t, name).schema
    # a pattern, as a path without one has to be a folder
    return t.spark.readStream.schema(schema).parquet(f"{t.root}/{name}.parque[t]")


def _unordered(t: Tables, name: str, files: int = 3):
    """A table with `ts` as a stream of small files that are not in time order, one a batch, and
    at the end a row far behind all others, with nothing but its time: a heartbeat that moves
    the watermark past every row."""
    home = f"{shared_dir(t.spark)}/landing-{uuid.uuid4().hex}"
    rows = getattr(t, name)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    for k in range(files):
        rows.where(part == k).write.parquet(f"{home}/{k}")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "ts"]
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select("ts", *blank)
    beat.select(rows.columns).write.parquet(f"{home}/{files}")
    return (
        t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(home)
    )


# wide enough for files in any order
_WIDE = replace(DEFAULT, watermark="400 days")


def _run(t: Tables, stream, **kw):
    home = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.land(stream, f"{home}/out", f"{home}/state", **kw).awaitTermination()
    return jobs.landed(t.spark, f"{home}/out")


@query(f"""
    WITH RECURSIVE {_SHINGLES}
    SELECT doc_id, copied_words, longest_run FROM runs""")
def stream_screen(t):
    benchmark = t.benchmark
    home = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.stream_screen(
        _stream(t, "documents"), lambda batch: copies.copied_from_any(batch, benchmark),
        f"{home}/out", f"{home}/state",
    ).awaitTermination()
    return jobs.merged_reports(t.spark, f"{home}/out", ["doc_id"])


@query(f"""
    WITH {_SCREEN}
    {_SCREEN_RESULT}""")
def stream_screen_corpus(t):
    """Documents land in two files, each a micro-batch of whole screenings; the store is read back."""
    apps, docs, jds = _screening_inputs(t)
    home = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    docs.repartition(2).write.parquet(f"{home}/in")
    stream = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    evidence = Evidence.of(t.spark)

    def screen(batch):
        own = apps.join(batch.select("doc_id"), "doc_id", "left_semi")
        return results_rows(screen_corpus(own, as_layout(batch), jds, evidence, CONF).reports)

    jobs.stream_screen(stream, screen, f"{home}/out", f"{home}/state").awaitTermination()
    return jobs.merged_reports(t.spark, f"{home}/out", ["candidate_id"]).select(
        "candidate_id", "overall_match_score", "score_confidence", "recommendation",
        "authenticity_band", "integrity_action",
    )


_STAGE = "CASE WHEN value < 10 THEN 'ok' WHEN value < 12 THEN 'error' ELSE 'started' END"


@query(f"""
    WITH e AS (SELECT user_id, event_type, ts, event_id, {_STAGE} AS status FROM events)
    SELECT user_id, event_type, coalesce(arg_min(status, ts) FILTER (status <> 'started'), 'skipped') AS status
    FROM e GROUP BY user_id, event_type""")
def stream_progress(t):
    key = F.concat_ws(":", "user_id", "event_type").alias("key")
    stages = _unordered(t, "events").where("user_id IS NOT NULL").select(key, "ts", F.expr(_STAGE).alias("status"))
    told = jobs.progress_of(_run(t, jobs.stream_progress(stages, "key", _WIDE), mode="update"), "key")
    return jobs.close_open_stages(told).select(
        F.substring_index("key", ":", 1).cast("bigint").alias("user_id"),
        F.substring_index("key", ":", -1).alias("event_type"), "status",
    )


@query("""
    WITH RECURSIVE f AS (SELECT user_id || ':' || event_type AS key, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
                         FROM events WHERE event_id % 5 <> 0),
    w AS (SELECT key, rn, event_id, ts AS last, true AS kept FROM f WHERE rn = 1
          UNION ALL SELECT f.key, f.rn, f.event_id, CASE WHEN f.ts - w.last >= INTERVAL 48 HOUR THEN f.ts ELSE w.last END, f.ts - w.last >= INTERVAL 48 HOUR
          FROM w JOIN f ON f.key = w.key AND f.rn = w.rn + 1)
    SELECT key, event_id FROM w WHERE kept""")
def stream_ttl_dedup(t):
    code = F.when(F.col("event_id") % 5 == 0, 500).when(F.col("event_id") % 5 == 1, 404).otherwise(200)
    # the heartbeat has no id and counts as an answer, or the watermark would not see it
    fetches = _unordered(t, "events").select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts",
        F.coalesce(code, F.lit(200)).alias("status_code"),
    )
    out = _run(t, jobs.ttl_dedup(fetches, replace(_WIDE, ttl_hours=48)))
    return out.select("key", "event_id")


# One token in four hours and a bucket of three, so that the sparse test events hit the limit.
_SLOW = replace(DEFAULT, rate_per_min=1 / 240, burst=3.0)
_BUCKET = """
    f AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT client, rn, event_id, now, 2.0::DOUBLE AS tokens, true AS allowed FROM f WHERE rn = 1
          UNION ALL SELECT client, rn, event_id, now, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (
            SELECT f.client, f.rn, f.event_id, f.now, least(3.0::DOUBLE, w.tokens + (f.now - w.now) / 14400.0) AS t FROM w JOIN f ON f.client = w.client AND f.rn = w.rn + 1))"""


def _clients(events):
    return events.select(F.col("user_id").cast("string").alias("client"), "event_id", "ts")


@query(f"""
    WITH RECURSIVE {_BUCKET} SELECT client, event_id, allowed FROM w""")
def stream_rate_audit(t):
    out = _run(t, jobs.stream_rate_audit(_clients(_unordered(t, "events")), replace(_SLOW, watermark=_WIDE.watermark)))
    return out.select("client", "event_id", "allowed")


@query(f"""
    WITH RECURSIVE {_BUCKET} SELECT client, event_id, allowed FROM w""")
def rate_audit(t):
    return jobs.rate_audit(_clients(t.events), _SLOW).select("client", "event_id", "allowed")


@query("""
    WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS stalled, count(*) AS n
    FROM s GROUP BY user_id, sid""")
def stalled_work(t):
    out = jobs.stalled_batch(t.events, "user_id", 6 * 3600.0)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select(
        "user_id", shown("started").alias("started"), shown("stalled_at").alias("stalled"), "n"
    )


# the last sessions stay open: a session is told once the watermark, an hour behind, has passed its end
@query("""
    WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    w AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS stalled, count(*) AS n FROM s GROUP BY user_id, sid)
    SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(stalled, '%Y-%m-%d %H:%M:%S.%f') AS stalled, n
    FROM w WHERE stalled <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_stalled(t):
    conf = replace(DEFAULT, stall_gap="6 hours", watermark="1 hour")
    out = _run(t, jobs.stalled(_stream(t, "events"), "user_id", conf))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("user_id", shown("started").alias("started"), shown("stalled_at").alias("stalled"), "n")


@query("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_audit(t):
    counts = jobs.audit_counts(_stream(t, "events"), "event_type")
    out = _run(t, counts, mode="update")
    latest = jobs.latest_per_key(out, ["day", "event_type"], ["batch"])
    return latest.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


# Clicks arrive in a second file, after all others: those whose day had ended by then are late.
_ARRIVAL = "event_type = 'click'"


@query(f"""
    WITH seen AS (SELECT max(ts) AS latest FROM events WHERE NOT ({_ARRIVAL})),
    e AS (SELECT *, ({_ARRIVAL}) AND latest IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= latest - INTERVAL 36 HOUR AS late FROM events, seen)
    SELECT CASE WHEN late THEN 'late' ELSE 'counted' END AS output, strftime(ts, '%Y-%m-%d') AS day, event_type,
           count(*) AS n, CAST(CASE WHEN late THEN sum(event_id) END AS BIGINT) AS ids
    FROM e GROUP BY 1, 2, 3, late""")
def stream_late_rows(t):
    home = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "ts", "event_type")
    for k, part in enumerate((f"NOT ({_ARRIVAL})", _ARRIVAL)):
        rows.where(part).coalesce(1).write.parquet(f"{home}/in/{k}")
    stream = (
        t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{home}/in")
    )
    conf = replace(DEFAULT, watermark="36 hours")
    jobs.route_late(stream, "event_type", f"{home}/out", f"{home}/state", conf=conf).awaitTermination()
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    counted = jobs.routed_counts(t.spark, f"{home}/out", "event_type").select(
        F.lit("counted").alias("output"), day("day"), "event_type", "n", F.lit(None).cast("bigint").alias("ids")
    )
    late = jobs.late_rows(t.spark, f"{home}/out").groupBy(day("ts"), "event_type")
    late = late.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return counted.unionByName(late.select(F.lit("late").alias("output"), "day", "event_type", "n", "ids"))
