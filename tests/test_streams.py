"""Streams give what the batch gives, however the input is cut."""

import random
import uuid
from dataclasses import replace
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.conf import DEFAULT
from attestry.operators import copies, ledger, store
from attestry.streaming import jobs, ordered

SLOW = replace(DEFAULT, rate_per_min=1.0, burst=3.0, ttl_hours=24)
WIDE = replace(SLOW, watermark="400 days")  # files may come in any order


@pytest.fixture
def events(spark, tmp_path):
    """Events in four files that come in any order, and one that moves the watermark past them;
    one client has a third of the events."""
    rng = random.Random(11)
    t = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        t += timedelta(seconds=rng.choice([1, 5, 20, 400, 90000]) * rng.random())
        rows.append((i, t, rng.choice(["hot", "a", "b", "c"] + ["hot"]), 200))
    schema = "event_id bigint, ts timestamp, client string, status_code int"
    path = f"{tmp_path}/in"
    dealt = rng.sample(rows, len(rows))
    parts = [dealt[k * 150 : (k + 1) * 150] for k in range(4)] + [[(-1, t + timedelta(days=900), None, 200)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/f{k}")
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )
    return rows, spark.createDataFrame(rows, schema), stream


def run(spark, tmp_path, stream, **kw):
    home = f"{tmp_path}/{uuid.uuid4().hex}"
    jobs.land(stream, f"{home}/out", f"{home}/state", **kw).awaitTermination()
    return jobs.landed(spark, f"{home}/out")


def simulate(rows, rate, burst):
    """Admitted iff no window that ends here would hold more than burst plus its share of the rate."""
    admitted, out = {}, {}
    for i, ts, client, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        now, before = ts.timestamp(), admitted.setdefault(client, [])
        fits = all(len(before) - k + 1 <= burst + (now - since) * rate + 1e-9 for k, since in enumerate(before))
        if fits:
            before.append(now)
        out[i] = fits
    return out


def test_rate_audit_of_one_busy_client_in_any_order(spark, tmp_path):
    """25,000 events of a client, shuffled: more than one Arrow chunk in one micro-batch."""
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=3 * i + rng.randrange(3)), "hot") for i in range(25_000)]
    rng.shuffle(rows)
    schema = "event_id bigint, ts timestamp, client string"
    static = spark.createDataFrame(rows, schema)
    static.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    # far behind all of them comes a row that only moves the watermark
    beat = spark.createDataFrame([(-1, start + timedelta(days=900), None)], schema)
    beat.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, jobs.stream_rate_audit(stream, WIDE))
    batch = jobs.rate_audit(static, SLOW)
    want = {r.event_id: r.allowed for r in batch.collect()}
    assert {r.event_id: r.allowed for r in got.collect()} == want
    seconds = 3 * 25_000
    assert abs(sum(want.values()) - seconds * SLOW.rate_per_min / 60) < SLOW.burst + 2

    fetched = stream.withColumn("status_code", F.lit(200)).withColumnRenamed("client", "key")
    kept = run(spark, tmp_path, jobs.ttl_dedup(fetched, replace(WIDE, ttl_hours=1)))
    times = sorted(r.ts for r in kept.collect())
    assert len(times) == 1 + (25_000 * 3 - 3) // 3600 or len(times) == 25_000 * 3 // 3600
    assert all((b - a).total_seconds() >= 3600 for a, b in zip(times, times[1:], strict=False))


def test_rate_audit_stream_and_batch(spark, tmp_path, events):
    rows, static, stream = events
    want = simulate(rows, SLOW.rate_per_min / 60, SLOW.burst)
    assert any(want.values()) and not all(want.values())
    got = run(spark, tmp_path, jobs.stream_rate_audit(stream, WIDE))
    assert {r.event_id: r.allowed for r in got.collect()} == want
    batch = jobs.rate_audit(static, SLOW)
    assert {r.event_id: r.allowed for r in batch.collect()} == want


def test_ttl_dedup(spark, tmp_path, events):
    rows, _, stream = events
    last, want = {}, set()
    for i, ts, client, _ in rows:
        if client not in last or (ts - last[client]).total_seconds() >= 86400:
            last[client] = ts
            want.add(i)
    got = run(spark, tmp_path, jobs.ttl_dedup(stream.withColumnRenamed("client", "key"), WIDE))
    assert {r.event_id for r in got.collect()} == want


def test_progress_and_counts(spark, tmp_path, events):
    _, static, stream = events
    status = F.when(F.col("event_id") % 50 == 7, "ok").otherwise("started")
    batch = jobs.progress(static.withColumn("status", status), ["client"])
    stages = stream.where("client IS NOT NULL").withColumn("status", status)
    told = run(spark, tmp_path, jobs.stream_progress(stages, "client", WIDE), mode="update")
    latest = jobs.progress_of(told, "client").select(batch.columns)
    assert sorted(latest.collect()) == sorted(batch.collect())

    counted = stream.where("client IS NOT NULL")
    daily = run(spark, tmp_path, jobs.audit_counts(counted, "client", conf=WIDE), mode="update")
    total = jobs.latest_per_key(daily, ["day", "client"], ["batch"]).agg(F.sum("n")).first()[0]
    assert total == static.count()


def test_state_is_bounded(spark, tmp_path):
    """Keys that come, stop and are passed by the watermark leave the state."""
    start = datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp, client string, status string"
    for k in range(6):
        rows = [(100 * k + i, start + timedelta(days=10 * k, minutes=i), f"c{k}-{i % 20}", "started") for i in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    conf = replace(SLOW, watermark="1 hour", ttl_hours=24)
    for made, outputs in ((jobs.stream_rate_audit(stream, conf), 5 * 60), (jobs.stream_progress(stream, "client", conf), 6 * 20)):
        home = f"{tmp_path}/{uuid.uuid4().hex}"
        query = jobs.land(made, f"{home}/out", f"{home}/state", mode="append" if outputs == 300 else "update")
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert jobs.landed(spark, f"{home}/out").count() >= outputs
        # six files of as many clients each: what is held does not add up
        assert max(held) <= 2 * max(held[:2]), held


def test_stalled_sessions(spark, events):
    _, static, _ = events
    conf = replace(DEFAULT, stall_gap="1 hour")
    a = jobs.stalled(static, "client", conf).select("client", "started", "n")
    b = jobs.stalled_batch(static, "client", 3600.0).select("client", "started", "n")
    assert sorted(a.collect()) == sorted(b.collect())


def test_stream_screen_equals_batch(spark, tmp_path):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    ref = spark.createDataFrame([(docs[3][1],)], "text string")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    stream = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    )
    out = f"{tmp_path}/reports"
    jobs.stream_screen(
        stream, lambda b: copies.copied_from_any(b, ref), out, f"{tmp_path}/state"
    ).awaitTermination()
    batch = copies.copied_from_any(df, ref)
    got = jobs.merged_reports(spark, out, ["doc_id"]).select(batch.columns)
    assert sorted(got.collect()) == sorted(batch.collect())
    assert len(store.committed(spark, out)) == 3

    # a batch that comes again changes nothing, even with other rows; another stream's is its own
    writer = jobs.writer_of(f"{tmp_path}/state")
    again = jobs.merge_batch(spark, lambda b: b.select("doc_id", F.lit(-1).alias("copied_words")), out, writer)
    again(df, 1)
    assert len(store.committed(spark, out)) == 3
    jobs.merge_batch(spark, lambda b: copies.copied_from_any(b, ref), out, jobs.writer_of("other"))(df.limit(4), 1)
    assert len(store.committed(spark, out)) == 4
    got = jobs.merged_reports(spark, out, ["doc_id"]).select(batch.columns)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_a_landed_file_is_screened_on_all_cores(spark, tmp_path):
    seen = []

    def screen(batch):
        seen.append(batch.rdd.getNumPartitions())
        return batch

    df = spark.range(1000).select(F.col("id").alias("doc_id"))
    df.coalesce(1).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/docs")
    jobs.stream_screen(stream, screen, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism]
    assert jobs.merged_reports(spark, f"{tmp_path}/out", ["doc_id"]).count() == 1000


SHAPE = "k string, v int, at int"


def contents(spark, path, **kw):
    return {r.k: r.v for r in ledger.stored_reports(spark, path, ["k"], **kw).collect()}


def test_report_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), SHAPE)
    with pytest.raises(FileNotFoundError):
        contents(spark, path)
    assert ledger.write_reports(rows(("a", 1, 5), ("b", 2, 5)), path, number=0)
    assert ledger.write_reports(rows(("b", 3, 4), ("c", 4, 1)), path, number=1)
    assert not ledger.write_reports(rows(("b", 9, 9)), path, number=1)
    assert contents(spark, path) == {"a": 1, "b": 3, "c": 4}
    assert contents(spark, path, order=["at"]) == {"a": 1, "b": 2, "c": 4}

    # rows that no commit names are those of a writer that was lost
    rows(("a", 99, 99)).write.parquet(f"{path}/rows/version=000000000002.batch.2")
    assert contents(spark, path) == {"a": 1, "b": 3, "c": 4}
    assert ledger.write_reports(rows(("d", 5, 0)), path)
    assert contents(spark, path) == {"a": 1, "b": 3, "c": 4, "d": 5}

    merge = store.newest(["k"])
    assert store.compact(spark, path, merge) and not store.compact(spark, path, merge)
    assert store.stored(spark, path).count() == 4
    assert ledger.write_reports(rows(("a", 7, 0)), path) and store.next_number(spark, path) == 4
    assert not ledger.write_reports(rows(("a", 8, 0)), path, number=0)
    assert store.vacuum(spark, path) == 3
    assert contents(spark, path) == {"a": 7, "b": 3, "c": 4, "d": 5}
    # an empty commit, and names that could be mistaken for another's
    assert store.commit(rows().limit(0), path, 0, "other") and len(contents(spark, path)) == 4
    for name in ("base", "a.b", ""):
        with pytest.raises(ValueError):
            store.commit(rows(), path, 0, name)


def test_late_rows_are_kept(spark, tmp_path):
    """Every row is counted in its window or kept as late; which, follows from the batches before."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    parts, ids = [], iter(range(10_000))
    for k in range(4):
        times = [start + timedelta(hours=30 * k + rng.uniform(-60, 24)) for _ in range(60)]
        parts.append([(next(ids), t, rng.choice("xy")) for t in times] + [(next(ids), None, "x")])
    schema = "event_id bigint, ts timestamp, kind string"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    out = f"{tmp_path}/out"
    conf = replace(DEFAULT, watermark="6 hours")
    jobs.route_late(stream, "kind", out, f"{tmp_path}/state", conf=conf).awaitTermination()

    latest, late, counts = None, set(), {}
    for part in parts:
        bound = latest and latest - timedelta(hours=6)
        for i, t, kind in part:
            day = t and datetime(t.year, t.month, t.day)
            if t is None or (bound and day + timedelta(days=1) <= bound):
                late.add(i)
            else:
                counts[day, kind] = counts.get((day, kind), 0) + 1
        latest = max([t for _, t, _ in part if t] + ([latest] if latest else []))
    assert 10 < len(late) < 120
    assert {r.event_id for r in jobs.late_rows(spark, out).collect()} == late
    assert {(r.day, r.kind): r.n for r in jobs.routed_counts(spark, out, "kind").collect()} == counts
    entries = jobs.late_ledger(jobs.late_rows(spark, out), "event_id", "kind", F.lit(start))
    assert entries.columns == ["candidate_id", "event", "payload", "at"] and entries.count() == len(late)
    # counts may be merged at any time
    assert store.compact(spark, f"{out}/counts", store.summed(["day", "kind"], ["n"]))
    assert {(r.day, r.kind): r.n for r in jobs.routed_counts(spark, out, "kind").collect()} == counts


class Store:
    """State and timers of one key, that count the calls from the processor."""

    def __init__(self):
        self.calls, self.timers, self.maps = 0, set(), []

    def getValueState(self, name, schema):
        return State(self)

    def getMapState(self, name, key_schema, schema):
        self.maps.append(State(self))
        return self.maps[-1]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def fire(self, processor, watermark):
        """All timers up to the watermark, in order."""
        told = []
        while due := sorted(t for t in self.timers if t <= watermark):
            for at in due:
                times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
                told += processor.handleExpiredTimer(("k",), times, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
                self.timers.discard(at)
        return told


class State:
    def __init__(self, store):
        self.store, self.held = store, {}

    def _call(self, done):
        self.store.calls += 1
        return done

    def get(self):
        return self._call(self.held.get(()))

    def update(self, value):
        self._call(self.held.update({(): value}))

    def clear(self):
        self._call(self.held.clear())

    def containsKey(self, key):
        return self._call(key in self.held)

    def getValue(self, key):
        return self._call(self.held[key])

    def updateValue(self, key, value):
        self._call(self.held.update({key: value}))

    def removeKey(self, key):
        self._call(self.held.pop(key))


@pytest.mark.parametrize("hold", [20_000, 90, 10])
def test_rows_of_a_key_wait_in_few_calls(monkeypatch, hold):
    """A key's rows are let through in time order, in a call or two a batch while they are few."""
    monkeypatch.setattr(ordered, "HOLD", hold)
    rng = random.Random(5)
    gap = 7 * 60_000_000  # each row in a slice of its own
    rows = [(i * gap + rng.randrange(gap), i) for i in range(300)]
    said = []

    def step(value, us):
        said.append(us)
        return float(us), (value is None or us - value >= gap, 0.0)

    processor, handle = ordered.InOrder(step, lambda last: last + gap), Store()
    processor.init(handle)
    told, latest = [], 0
    for k in range(6):
        # rows come up to 40 late, the watermark is 60 rows behind
        part = sorted(rows[50 * k : 50 * k + 50], key=lambda r: r[0] + rng.randrange(40) * gap)
        list(processor.handleInputRows(("k",), iter([Row(us=u, event_id=i) for u, i in part]), None))
        latest = max(u for u, _ in part) // 1000
        told += handle.fire(processor, latest - 60 * gap // 1000)
        assert said == [u for u, _ in rows[: len(said)]]
    told += handle.fire(processor, latest + 10 * gap // 1000)
    assert [(r.us, r.event_id) for r in told] == rows
    want, last = [], None
    for us, _ in rows:
        want.append(last is None or us - last >= gap)
        last = us
    assert [r.allowed for r in told] == want
    # nothing stays
    assert not handle.timers and not any(m.held for m in handle.maps) and not processor._held.held
    if hold == 20_000:
        assert handle.calls < 60


@pytest.fixture
def many_keys(spark, tmp_path):
    """4,000 keys of three events each, in two files that come in any order, and a row that moves the watermark."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rng.randrange(40_000)), f"c{i % 4000}") for i in range(12_000)]
    schema = "event_id bigint, ts timestamp, client string"
    dealt = rng.sample(rows, len(rows))
    for k, part in enumerate((dealt[:6000], dealt[6000:], [(-1, start + timedelta(days=900), None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/many/{k}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/many")
    )
    return rows, spark.createDataFrame(rows, schema), stream


def run_in_few_states(spark, tmp_path, stream, **kw):
    """What a stream wrote; it may not hold a row of state for each key."""
    home = f"{tmp_path}/{uuid.uuid4().hex}"
    query = jobs.land(stream, f"{home}/out", f"{home}/state", **kw)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= ordered.BUCKETS, held
    return jobs.landed(spark, f"{home}/out")


def test_progress_of_many_keys(spark, tmp_path, many_keys):
    _, static, stream = many_keys
    status = F.when(F.col("event_id") % 7 == 3, "ok").otherwise("started")
    batch = jobs.progress(static.withColumn("status", status), ["client"])
    stages = stream.where("client IS NOT NULL").withColumn("status", status)
    told = run_in_few_states(spark, tmp_path, jobs.stream_progress(stages, "client", WIDE), mode="update")
    # a row for each key of a batch
    assert told.count() == told.select("batch", "client").distinct().count()
    assert sorted(jobs.progress_of(told, "client").select(batch.columns).collect()) == sorted(batch.collect())


def test_ttl_dedup_of_many_keys(spark, tmp_path, many_keys):
    rows, _, stream = many_keys
    last, want = {}, set()
    for i, ts, client in sorted(rows, key=lambda r: (r[1], r[0])):
        if client not in last or (ts - last[client]).total_seconds() >= 4 * 3600:
            last[client] = ts
            want.add(i)
    assert 4000 < len(want) < 12_000
    fetched = stream.withColumn("status_code", F.lit(200)).withColumnRenamed("client", "key")
    got = run_in_few_states(spark, tmp_path, jobs.ttl_dedup(fetched, replace(WIDE, ttl_hours=4)))
    assert {r.event_id for r in got.collect()} == want


@pytest.mark.parametrize("hold", [5000, 60, 7])
def test_rows_of_many_keys_wait_together(monkeypatch, hold):
    """Keys of a bucket are judged each by itself and in time order, in a call or two a batch while rows are few."""
    monkeypatch.setattr(ordered, "HOLD", hold)
    rng = random.Random(9)
    gap = 90_000_000
    rows = [(rng.randrange(400) * gap // 7, i, rng.choice("abcdefgh")) for i in range(400)]
    rows.sort(key=lambda r: r[0])

    def step(last, us):
        fresh = last is None or us - last >= gap
        return (float(us) if fresh else last), (fresh, 0.0)

    processor, handle = ordered.InOrder(step, lambda last: last + gap, ordered.told_in_lists), Store()
    processor.init(handle)
    told, latest = [], 0
    for k in range(8):
        part = sorted(rows[50 * k : 50 * k + 50], key=lambda r: r[0] + rng.randrange(3) * gap)
        list(processor.handleInputRows((3,), iter([Row(us=u, event_id=i, key=c) for u, i, c in part]), None))
        latest = max(r[0] for r in part) // 1000
        told += handle.fire(processor, latest - 4 * gap // 1000)
    told += handle.fire(processor, latest + 2 * gap // 1000)
    got, times = {}, {}
    for r in told:
        got |= dict(zip(r.event_id, map(bool, r.allowed), strict=True))
        for c, us in zip(r.key, r.us.tolist(), strict=True):
            times.setdefault(c, []).append(us)
    want, last = {}, {}
    for us, i, c in sorted(rows, key=lambda r: r[:2]):
        last[c], (want[i], _) = step(last.get(c), us)
    assert got == want and any(want.values()) and not all(want.values())
    assert all(t == sorted(t) for t in times.values())
    assert not handle.timers and not any(m.held for m in handle.maps) and not processor._held.held
    if hold == 5000:
        assert handle.calls < 80


def test_rate_audit_of_many_keys(spark, tmp_path, many_keys):
    _, static, stream = many_keys
    slow = replace(SLOW, rate_per_min=1 / 120, burst=1.0)
    want = {r.event_id: r.allowed for r in jobs.rate_audit(static, slow).collect()}
    assert any(want.values()) and not all(want.values())
    got = run_in_few_states(spark, tmp_path, jobs.stream_rate_audit(stream, replace(slow, watermark=WIDE.watermark)))
    assert {r.event_id: r.allowed for r in got.collect()} == want
