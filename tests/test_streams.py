"""Streams over several batches: late rows, repeats and updates."""

from datetime import datetime

import pytest

from recordsmith.streaming import jobs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
BATCHES = (
    [(1, datetime(2024, 1, 1), 7, "view", 1.0), (2, datetime(2024, 1, 20), 7, "click", 2.0), (3, datetime(2024, 1, 20), 8, "view", None)],
    [(2, datetime(2024, 1, 20), 7, "click", 2.0), (4, datetime(2024, 1, 12), 9, "error", 1.0), (5, datetime(2024, 1, 21), 7, "error", 3.0)],
    [(6, datetime(2024, 1, 13), 9, "view", 1.0), (7, datetime(2024, 1, 22), 9, "click", 1.0)],
)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """One file a batch, in the order of their times, read one at a time."""
    folder = tmp_path_factory.mktemp("batches")
    import os
    import shutil

    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/made-{k}")
        made = next(f for f in os.listdir(f"{folder}/made-{k}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.copy(f"{folder}/made-{k}/{made}", f"{folder}/in/{k}-events.parquet")
        os.utime(f"{folder}/in/{k}-events.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = spark.createDataFrame([], EVENTS).schema
    return lambda: jobs.read_stream(spark, f"{folder}/in", "*events", schema, files=1), str(folder)


def test_retention_drops_and_counts_late_rows(spark, source):
    make, folder = source
    kept, dropped = jobs.run_counted(spark, jobs.retention(make(), "2024-01-10"), folder)
    assert sorted(r["event_id"] for r in kept.collect()) == [2, 3, 4, 5, 7]  # 1 before the cutoff, 2 once, 6 too late
    assert dropped == 1  # a watermark holds for late rows one batch later, so 4 stays


def test_record_state_is_the_last_row_of_each_key(spark, source):
    make, folder = source
    got = {r["user_id"]: (r["outcome"], r["last_event"]) for r in jobs.run_available(spark, jobs.record_state(make()), folder, "update", "user_id").collect()}
    assert got == {7: ("error", 5), 8: ("view", 3), 9: ("click", 7)}


def test_daily_rollup_leaves_late_days_out(spark, source):
    make, folder = source
    got = {r["date"]: (r["records"], r["failed"], r["total_value"]) for r in jobs.run_available(spark, jobs.daily_rollup(make()), folder, "update", "date").collect()}
    assert got == {"2024-01-01": (1, 0, 1.0), "2024-01-12": (1, 1, 1.0), "2024-01-20": (3, 0, 4.0), "2024-01-21": (1, 1, 3.0), "2024-01-22": (1, 0, 1.0)}


def test_a_repeat_after_the_horizon_is_live_again(spark, source):
    make, folder = source
    from datetime import timedelta

    every = spark.createDataFrame([r for b in BATCHES for r in b], EVENTS).dropDuplicates(["event_id"])
    horizon = timedelta(days=10)
    batch = {r["event_id"]: r["live"] for r in jobs.cache_uses(every, horizon).collect()}
    assert batch == {1: True, 2: True, 5: False, 3: True, 4: True, 6: False, 7: False}
    batch = {r["event_id"]: r["live"] for r in jobs.cache_uses(every.where("event_id <> 6"), horizon).collect()}  # 6 comes late
    got = {r["event_id"]: r["live"] for r in jobs.run_available(spark, jobs.cache_uses(make().where("event_id <> 6"), horizon, "30 days"), folder).where("event_id <> 2").collect()}
    assert batch[7] and got == {k: v for k, v in batch.items() if k != 2}


def test_timers_forget_keys(spark, source):
    make, folder = source
    from datetime import timedelta

    uses = jobs.cache_uses(make(), timedelta(hours=6), "1 hour")
    got = {r["event_id"]: r["live"] for r in jobs.run_available(spark, uses, folder).collect()}
    assert got[1] and got[5] and got[7]  # days after each key's last request


def test_upsert_table_stays_in_proportion_to_its_keys(spark, tmp_path):
    import os

    path = str(tmp_path / "table")
    table = jobs.UpsertTable(spark, path, "k", buckets=4)
    want = {}
    for epoch in range(12):
        rows = [(k, epoch * 100 + k) for k in range(epoch % 3, 40, 3)]
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "k long, v long")
        table.merge(batch, epoch)
        if epoch % 4 == 3:  # the batch is run again
            table.merge(batch, epoch)
    assert {r["k"]: r["v"] for r in table.read(batch.schema).collect()} == want
    files = [f for top, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * 4  # two versions of each bucket at most
    assert spark.read.parquet(path).count() <= 2 * len(want)


def test_late_rows_are_kept_apart(spark, source):
    make, folder = source
    from datetime import timedelta

    kept, late = jobs.run_with_late(spark, make(), folder, delay=timedelta(days=1))
    assert sorted(r["event_id"] for r in late.collect()) == [4, 6]
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 2, 3, 5, 7]


def test_monthly_percentiles_from_daily_sketches(spark):
    import numpy as np

    rows = [(k, datetime(2024, 1 + k % 2, 1 + k % 28), 7, "view", float((k * 7919) % 10007)) for k in range(20_000)]
    days = jobs.daily_sketches(spark.createDataFrame(rows, EVENTS))
    for r in jobs.monthly_percentiles(days, {"p50": 0.5, "p90": 0.9}).collect():
        values = np.sort([x[4] for x in rows if x[1].month == int(r["month"][5:])])
        assert r["records"] == len(values)
        for name, p in (("p50", 0.5), ("p90", 0.9)):
            assert abs(np.searchsorted(values, r[name]) / len(values) - p) <= 0.01
