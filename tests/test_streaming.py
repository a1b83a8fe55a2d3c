"""Streams end where their batch forms do."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import DATA, rows_of

from haulmark import plans
from haulmark.sources.tables import table
from haulmark.streaming import events

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    rows = table(spark, SF, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props", "ntile(4) over (order by ts) as part")
    for part in range(1, 5):  # one after another, as a file source reads files in the order they came
        rows.where(f"part = {part}").drop("part").coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    return path


def test_improvements_equal_the_running_best(spark, folder, tmp_path):
    stream = events.improvements(events.source(spark, folder, 100))
    got = events.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    assert rows_of(got) == rows_of(plans.QUERIES["win_running_best"](spark, SF))


def test_latest_table_equals_the_last_records(spark, folder, tmp_path):
    events.latest_table(events.source(spark, folder, 1), f"{tmp_path}/log", f"file://{tmp_path}/ck").awaitTermination()
    got = events.read_latest(spark, f"{tmp_path}/log").select("user_id", "event_type", "event_id")
    want = table(spark, SF, "events").groupBy("user_id", "event_type").agg({"event_id": "count"}).count()
    assert got.count() == want
    last = table(spark, SF, "events").selectExpr("user_id", "event_type", "event_id", "ts").groupBy("user_id", "event_type").agg({"ts": "max"}).withColumnRenamed("max(ts)", "ts")
    assert rows_of(got) == rows_of(table(spark, SF, "events").join(last, ["user_id", "event_type", "ts"]).select("user_id", "event_type", "event_id"))


def test_windows_close_behind_the_watermark(spark, folder, tmp_path):
    stream = events.tumbling(events.source(spark, folder, 1))
    got = set(rows_of(events.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")))
    batch = set(rows_of(events.tumbling(table(spark, SF, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value"))))
    assert got and got <= batch and len(batch - got) <= 15  # the last days stay open


def test_deduplication_and_sessions_run_as_streams(spark, folder, tmp_path):
    once = events.deduplicated(events.source(spark, folder, 100), "40 days").select("identity")
    got = events.drain(once, f"file://{tmp_path}/a", f"file://{tmp_path}/ck-a")
    assert got.count() == got.distinct().count() == plans.QUERIES["record_identity_dedup"](spark, SF).count()
    sessions = events.drain(events.sessions(events.source(spark, folder, 1)), f"file://{tmp_path}/b", f"file://{tmp_path}/ck-b")
    assert sessions.count() > 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sealed_rows(spark, folder: str, tmp_path, late: str) -> list[tuple]:
    stream = events.sealed(events.source(spark, folder, 1), late)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return rows_of(events.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").where("user_id >= 0"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("order", ["part", "-part"])
def test_sealed_checkpoints_are_those_of_the_batch(spark, tmp_path, order):
    rows = table(spark, SF, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props", "ntile(3) over (order by ts) as part")
    end = rows.selectExpr("max(ts) as ts").first().ts
    for part in sorted((1, 2, 3), key=lambda p: p if order == "part" else -p):
        rows.where(f"part = {part}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # one event of nobody's, long after all others, moves the watermark past every mark
    last = spark.createDataFrame([(-1, end + timedelta(days=300), -1, "x", 0.0, "")], events.SCHEMA)
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sealed_rows(spark, f"{tmp_path}/in", tmp_path, "100 days") == rows_of(plans.QUERIES["asof_checkpoint"](spark, SF))


def test_sealed_checkpoints_refuse_what_comes_too_late(spark, tmp_path):
    at = lambda hours: datetime(2024, 3, 1) + timedelta(hours=hours)
    files = [[(1, at(0), 7, 9.0), (2, at(30), 7, 8.0)], [(3, at(24), 7, 5.0), (4, at(90), 7, 6.0)], [(5, at(23), 7, 1.0), (6, at(2000), -1, 0.0)], [(7, at(2000), -1, 0.0)]]
    for own in files:
        spark.createDataFrame([(e, t, u, "x", v, "") for e, t, u, v in own], events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = sealed_rows(spark, f"{tmp_path}/in", tmp_path, "12 hours")
    # 3 comes before the mark of day 1 is sealed, at that very time; 5 would be better, but the watermark is at hour 78
    assert sorted((u, d) for d, _, u, _ in got) == [(7, d) for d in events.MARKS]
    assert {d: (e, v) for d, e, _, v in got} == dict.fromkeys(events.MARKS, (3, 5.0))
