import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridia.operators.exchange import audit_log
from meridia.plans.streams import replay, run_to_end
from meridia.streaming import ingest, state

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Feeder:
    """A stream over files that a test adds to between runs; every file is a trigger."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/in")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def rows(self):
        return self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, make):
        return run_to_end(make(self.rows()), f"{self.path}/out", f"{self.path}/state")


def test_users_vanish_sixty_seconds_after_their_last_beat_and_survive_a_restart(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, "user_id string, ts timestamp, view string, poi string")

    def spans():
        gone = feeder.run(state.presence)
        here = state.still_present(spark, f"{feeder.path}/state")
        pick = lambda df: {(r.user_id, (r.seen - r.since) // 1_000_000, r.beats, r.view) for r in df.collect()}
        return pick(gone), pick(here)

    feeder.add([("ann", at(0), "map", None), ("ann", at(60), "list", "p1"), ("bob", at(5), None, None), (" ", at(5), None, None), (None, at(6), None, None)])
    assert spans() == (set(), {("ann", 60, 2, "list"), ("bob", 0, 1, "")})
    # another run: bob's silence is longer than a minute, ann's is a minute
    feeder.add([("ann", at(120), "map", "p2"), ("cy", at(130), "x", "y")])
    assert spans() == ({("bob", 0, 1, "")}, {("ann", 120, 3, "map"), ("cy", 0, 1, "x")})
    # a late beat is still in time to count, bob comes back
    feeder.add([("cy", at(128), "z", "y"), ("bob", at(300), "map", "p3")])
    gone, here = spans()
    assert gone == {("bob", 0, 1, ""), ("ann", 120, 3, "map"), ("cy", 2, 2, "x")} and here == {("bob", 0, 1, "map")}


def test_users_of_one_bucket_keep_their_own_spans_and_late_beats_are_dropped(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, "user_id string, ts timestamp, view string, poi string")
    make = lambda rows: state.presence(rows, buckets=1)
    # within a span of a later end, an equal time, and a silence of just over a minute
    feeder.add([("ann", at(0), "a", ""), ("bob", at(30), "b", ""), ("ann", at(60), "c", "2"), ("ann", at(60), "c", "1"), ("bob", at(90.001), "d", ""), ("cy", at(200), "e", "")])
    gone = lambda df: sorted((r.user_id, (r.seen - r.since) // 1_000_000, r.beats, r.view, r.poi) for r in df.collect())
    ended = [("ann", 60, 3, "c", "2"), ("bob", 0, 1, "b", ""), ("bob", 0, 1, "d", "")]
    assert gone(feeder.run(make)) == ended
    # the watermark is at 190: one beat is late, though another of its task is not
    feeder.add([("cy", at(189), "l", ""), ("cy", at(195), "o", ""), ("ann", at(150), "l", "")])
    assert gone(feeder.run(make)) == ended
    assert gone(state.still_present(spark, f"{feeder.path}/state")) == [("cy", 5, 2, "e", "")]


def test_consumers_of_one_bucket_have_feeds_of_their_own(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, "kind string, consumer string, row_id long, ts timestamp, ids array<long>")
    make = lambda rows: state.feed(*(rows.where(F.col("kind") == k) for k in ("update", "ack", "poll")), buckets=1)
    feeder.add([("update", "a", 1, at(1), None), ("update", "b", 2, at(2), None), ("poll", "a", 3, at(3), None)])
    feeder.run(make)
    feeder.add([("ack", "a", 4, at(4), None), ("poll", "a", 5, at(5), None), ("poll", "b", 6, at(6), None)])
    assert {(r.consumer, r.poll_id, r.update_id) for r in feeder.run(make).collect()} == {("a", 3, 1), ("b", 6, 2)}


def test_a_slice_is_written_by_many_tasks_and_is_one_trigger(spark, tmp_path):
    from pathlib import Path

    rows = spark.createDataFrame([(i, at(i)) for i in range(80)], "id long, ts timestamp").repartition(4)
    seen = []

    def run(stream):
        batch = lambda df, _: seen.append({r.id // 20 for r in df.collect()})
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    replay(rows, f"{tmp_path}/in", run)
    assert seen == [{0}, {1}, {2}, {3}] and len(list(Path(f"{tmp_path}/in").glob("*.parquet"))) == 16


def test_updates_show_again_until_they_are_acknowledged(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, "kind string, consumer string, row_id long, ts timestamp, ids array<long>")
    make = lambda rows: state.feed(*(rows.where(F.col("kind") == k) for k in ("update", "ack", "poll")), shown=3)

    def shown():
        out = {}
        for r in feeder.run(make).orderBy("poll_id", "place").collect():
            out.setdefault((r.consumer, r.poll_id), []).append(r.update_id)
        return out

    feeder.add([("update", "a", 1, at(1), None), ("update", "a", 2, at(2), None), ("poll", "a", 10, at(3), None), ("poll", "b", 11, at(3), None), ("update", None, 3, at(3), None), ("poll", "a", 12, at(4), None)])
    assert shown() == {("a", 10): [2, 1], ("a", 12): [2, 1, 2]}
    feeder.add([("ack", "a", 20, at(5), [2]), ("poll", "a", 21, at(6), None)])
    assert shown()[("a", 21)] == [1, 1]
    feeder.add([("ack", "a", 30, at(7), None), ("poll", "a", 31, at(8), None), ("update", "a", 32, at(9), None), ("poll", "a", 33, at(10), None)])
    out = shown()
    assert ("a", 31) not in out and out[("a", 33)] == [32]


def test_changes_are_against_what_the_stream_saw_last(spark, tmp_path):
    schema = "key string, row_id long, ts timestamp, name string, reviewer string, action string, reason string, new map<string,string>"
    feeder = Feeder(spark, tmp_path, schema)

    def log():
        rows = audit_log(feeder.run(state.with_old), key="key").collect()
        return {(r.key, r.action, r.field, r.old, r.new) for r in rows}

    feeder.add([("k", 1, at(1), "n", "r", "create", "", {"a": "1", "updated_at": "x"}), ("k", 2, at(2), "n", "r", "edit", None, {"a": "2", "b": None})])
    first = {("k", "create", None, None, ""), ("k", "create", "a", "", "1"), ("k", "edit", "a", "1", "2")}
    assert log() == first
    feeder.add([("k", 3, at(3), "n", "r", "edit", None, {"b": "é\"3"}), ("k", 4, at(4), None, None, "edit", None, None), (None, 5, at(4), None, None, "edit", None, {"a": "9"}), ("k", 6, at(5), "n", "r", "edit", None, {"a": "2", "b": "4"})])
    assert log() == first | {("k", "edit", "b", "", "é\"3"), ("k", "edit", "b", "é\"3", "4")}


EVENT = "event_id long, ts timestamp, Name_EN string, Name_AR string, Category string, Phone_Number string"


@pytest.fixture
def places(spark, tmp_path):
    path = str(tmp_path / "places")
    known = [("{1}", "Cafe A", "مقهى", "Cafe", "1"), ("{0}", "Cafe A", None, "Cafe", "2"), ("{5}", "", "فندق", "Hotel", None)]
    ingest.create_table(spark.createDataFrame(known, "GlobalID string, Name_EN string, Name_AR string, Category string, Phone_Number string"), f"{path}/table", buckets=4)
    return path


def table(spark, path):
    return sorted((r.GlobalID[:3], r.Name_EN, r.Name_AR, r.Category, r.Phone_Number) for r in ingest.read_table(spark, f"{path}/table").collect())


def test_events_update_by_name_create_others_and_repeat_safely(spark, places):
    events = [
        (1, at(1), "Cafe A", None, None, "77"), (2, at(2), "Cafe A", "", "Shop", None), (3, at(3), None, "فندق", None, "5"), (4, at(4), "New", "جديد", None, "1"),
        (5, at(5), "New", None, "Bank", None), (6, at(6), None, None, None, None), (7, at(7), None, "آخر", "Park", None),
    ]
    write = ingest.upsert_events(places, buckets=4)
    batch = spark.createDataFrame(events, EVENT)
    write(batch, 0)
    after = table(spark, places)
    assert [r for r in after if r[0] in ("{0}", "{1}", "{5}")] == [("{0}", "Cafe A", "", "Shop", "77"), ("{1}", "Cafe A", "مقهى", "Cafe", "1"), ("{5}", "", "فندق", "Hotel", "5")]
    assert {r[1:] for r in after if r[0] not in ("{0}", "{1}", "{5}")} == {("New", "جديد", "Bank", "1"), (None, "آخر", "Park", None)}
    queue = lambda: sorted((r.event_id, r.action) for r in spark.read.parquet(f"{places}/queue").collect())
    assert queue() == [(1, "update"), (2, "update"), (3, "update"), (4, "create"), (5, "update"), (7, "create")]
    # the same batch again, after its end
    write(batch, 0)
    assert table(spark, places) == after and len(queue()) == 6
    write(spark.createDataFrame([(8, at(9), "New", None, "Mall", None)], EVENT), 1)
    assert [r[3] for r in table(spark, places) if r[1] == "New"] == ["Mall"] and (8, "update") in queue()
    write(spark.createDataFrame([], EVENT), 2)
    assert len(table(spark, places)) == 5


def test_a_batch_that_failed_after_its_decisions_decides_the_same_again(spark, places):
    batch = spark.createDataFrame([(1, at(1), "New", "جديد", None, "1"), (2, at(2), None, "جديد", None, "2")], EVENT)
    decided = ingest.decide(batch, ingest.read_table(spark, f"{places}/table"))
    decided.withColumn("name", F.lit("n")).write.parquet(f"{places}/queue/batch=7")
    ingest.upsert_events(places, buckets=4)(batch, 7)
    assert len(table(spark, places)) == 5


def test_only_touched_buckets_are_written(spark, places, tmp_path):
    from pathlib import Path

    files = lambda: {p: p.stat().st_mtime_ns for p in Path(f"{places}/table").rglob("*.parquet")}
    before = files()
    ingest.upsert_events(places, buckets=4)(spark.createDataFrame([(1, at(1), "Cafe A", None, None, "9")], EVENT), 0)
    after = files()
    home = spark.createDataFrame([("{0}",)], "GlobalID string").select(ingest.bucket_of(4).alias("b")).first().b
    assert {p.parent.name for p, t in before.items() if after.get(p) != t} == {f"bucket={home}"}
