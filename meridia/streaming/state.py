"""Streams with keyed state: presence with a time to live, feeds that wait for acknowledgement, changes against the last row.

State is kept by key in the state store of the stream's checkpoint, so it
survives restarts and lost executors.  The processors see the rows of one key and
one trigger together; what a trigger reads is bounded by the source.  Users and
consumers are many and have few rows each, so those of a bucket are one key: a
call, its state and its rows cost once for all of them.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds after its last beat that a user still counts as present, and updates that a feed shows.
PRESENT, SHOWN = 60, 50
#: Buckets of users and of consumers.
BUCKETS = 512
#: Beats that a task packs together.
PACKED = 400_000
SPAN = "user_id string, since long, seen long, beats long, view string, poi string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store while streams with keyed state run: the one that they need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def pack(table: pa.Table) -> bytes:
    """Rows as one value: Spark hands rows to a processor, and the elements of arrays to a state, one by one."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()


def pack_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beats with their bucket -> bucket, at (the last), packed: one row for those of a bucket among PACKED rows of a task."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held += [batch] if batch is not None else []
        if held and (batch is None or sum(b.num_rows for b in held) >= PACKED):
            beats = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
            bucket, at = beats["bucket"].to_numpy(), beats["at"].to_numpy()
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(starts[1:], len(bucket))
            if len(starts):
                packed = [pack(beats.slice(a, b - a).drop_columns("bucket")) for a, b in zip(starts, ends)]
                yield pa.record_batch([pa.array(bucket[starts]), pa.array(np.maximum.reduceat(at, starts)), pa.array(packed, pa.binary())], names=["bucket", "at", "packed"])
            held = []


def merge_spans(spans: pd.DataFrame, ttl: int) -> pd.DataFrame:
    """Spans of a user that lie no more than ``ttl`` microseconds apart are one; its view and poi are those last seen, the largest of equal times."""
    user, since, seen = pd.factorize(spans["user_id"])[0], spans["since"].to_numpy(), spans["seen"].to_numpy()
    order = np.lexsort((since, user))
    user, since, seen = user[order], since[order], seen[order]
    until = pd.Series(seen).groupby(user).cummax().to_numpy()
    first = np.ones(len(order), bool)
    first[1:] = (user[1:] != user[:-1]) | (since[1:] - until[:-1] > ttl)
    starts = np.flatnonzero(first)
    span, last = np.cumsum(first) - 1, np.maximum.reduceat(seen, starts) if len(starts) else seen
    at = np.flatnonzero(seen == last[span])
    found = spans.iloc[order[at]][["user_id", "view", "poi"]].assign(span=span[at])
    if len(found) > len(starts):
        found = found.sort_values(["span", "view", "poi"]).drop_duplicates("span", keep="last")
    beats = np.add.reduceat(spans["beats"].to_numpy()[order], starts) if len(starts) else seen
    return pd.DataFrame({"user_id": found["user_id"].to_numpy(), "since": since[starts], "seen": last, "beats": beats, "view": found["view"].to_numpy(), "poi": found["poi"].to_numpy()})


class Presence(StatefulProcessor):
    """Merges the beats of a bucket of users to spans and lets a span go once the watermark is past its time to live.

    A span is kept until then because a late beat may still join it to the next.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "packed binary")

    def _keep(self, spans: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(spans):
            self.spans.update((pack(pa.Table.from_pandas(spans, preserve_index=False)),))
            # one millisecond after the last at which a user is present
            self.handle.registerTimer((int(spans["seen"].min()) + self.ttl) // 1000 + 1)
        else:
            self.spans.clear()

    def _kept(self) -> pd.DataFrame | None:
        kept = self.spans.get()
        return kept and unpack(kept[0]).to_pandas()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = pa.concat_tables(unpack(packed) for chunk in rows for packed in chunk["packed"]).to_pandas()
        # Spark drops only rows whose last beat is late
        beats = beats[beats["at"] > timerValues.getCurrentWatermarkInMs() * 1000]
        spans = pd.DataFrame({"user_id": beats["user_id"], "since": beats["at"], "seen": beats["at"], "beats": np.ones(len(beats), np.int64), "view": beats["view"], "poi": beats["poi"]})
        kept = self._kept()
        self._keep(merge_spans(spans if kept is None else pd.concat([kept, spans], ignore_index=True), self.ttl))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._kept()
        if spans is not None:
            gone = spans["seen"] + self.ttl < now
            self._keep(spans[~gone])
            if gone.any():
                yield spans[gone].reset_index(drop=True)


def presence(beats: DataFrame, ttl: int = PRESENT, late: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """beats: user_id (string), ts, view, poi -> a row for each span of presence that has ended: user_id, since, seen, beats, view, poi.

    A user is present up to ``ttl`` seconds after a beat, the last second included;
    a longer silence ends the span.  Blank users take no part; null view and poi
    count as ''.  View and poi are those of the last beat, times are microseconds.
    Beats later than the watermark are dropped.
    """
    empty = F.lit("")
    rows = beats.where(F.trim(F.coalesce("user_id", empty)) != "").select(
        F.trim("user_id").alias("user_id"), F.unix_micros("ts").alias("at"), F.coalesce("view", empty).alias("view"), F.coalesce("poi", empty).alias("poi")
    )
    packed = rows.where("at is not null").select(bucket_of("user_id", buckets), "*").mapInArrow(pack_buckets, "bucket long, at long, packed binary")
    return packed.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(
        Presence(ttl), SPAN, "Append", "EventTime"
    )


def still_present(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The spans that a presence stream still holds: those who are present, with their last sight."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "spans").load()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                yield from unpack(packed).to_batches()

    return held.select("value.packed").mapInArrow(spans, SPAN)


class Feed(StatefulProcessor):
    """Updates wait for acknowledgement; every poll puts the newest of them before what is pending already."""

    def __init__(self, shown: int):
        self.shown = shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what waits and what is pending, of all consumers of a bucket
        self.held = handle.getValueState("held", "waiting binary, pending binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting: dict[str, dict[int, int]] = defaultdict(dict)
        pending: dict[str, list[int]] = defaultdict(list)
        held = self.held.get()
        if held:
            were, shown = (unpack(packed).to_pydict().values() for packed in held)
            for consumer, update, at in zip(*were):
                waiting[consumer][update] = at
            for consumer, update in zip(*shown):
                pending[consumer].append(update)
        out: list[tuple] = []
        found = pd.concat(rows).sort_values(["at", "row_id"], kind="stable")
        for consumer, row_id, at, kind, ids in zip(*(found[c].tolist() for c in ("consumer", "row_id", "at", "kind", "ids"))):
            own = waiting[consumer]
            if kind == "update":
                own[row_id] = at
            elif kind == "ack":
                named = set(ids) if ids is not None else set()
                for update in named or list(own):
                    own.pop(update, None)
                pending[consumer] = [u for u in pending[consumer] if u not in named] if named else []
            elif kind == "poll":
                newest = heapq.nlargest(self.shown, own, key=lambda u: (own[u], u))
                pending[consumer] = (newest + pending[consumer])[: self.shown]
                out += [(consumer, row_id, place, update) for place, update in enumerate(pending[consumer], 1)]
        were = pd.DataFrame([(c, u, at) for c, own in waiting.items() for u, at in own.items()], columns=["consumer", "update_id", "at"])
        shown = pd.DataFrame([(c, u) for c, own in pending.items() for u in own], columns=["consumer", "update_id"])
        self.held.update(tuple(pack(pa.Table.from_pandas(x, preserve_index=False)) for x in (were, shown)))
        yield pd.DataFrame(out, columns=["consumer", "poll_id", "place", "update_id"])


def feed(updates: DataFrame, acks: DataFrame, polls: DataFrame, shown: int = SHOWN, buckets: int = BUCKETS) -> DataFrame:
    """What each poll of each consumer shows: consumer, poll_id, place (from 1, newest first), update_id.

    updates: consumer, row_id, ts; acks: the same and ids (array of update ids; null
    or empty means all); polls: consumer, row_id, ts.  A poll fetches the newest
    ``shown`` updates nobody acknowledged and puts them before those fetched
    earlier, so an update shows again at every poll until it is acknowledged;
    ``shown`` are kept.  Rows of one trigger count in order of time, those of a
    later trigger after them.  Rows without a consumer take no part.
    """
    none = F.lit(None).cast("array<long>")
    pick = lambda df, kind, ids: df.where("consumer is not null").select("consumer", "row_id", F.unix_micros("ts").alias("at"), F.lit(kind).alias("kind"), ids.alias("ids"))
    rows = pick(updates, "update", none).unionByName(pick(acks, "ack", F.col("ids"))).unionByName(pick(polls, "poll", none))
    return rows.select(bucket_of("consumer", buckets), "*").groupBy("bucket").transformWithStateInPandas(Feed(shown), "consumer string, poll_id long, place int, update_id long", "Append", "None")


class Changes(StatefulProcessor):
    """Puts the row that a key had before beside the one it gets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = (self.last.get() or ("{}",))[0]
        fields = json.loads(last)
        found = pd.concat(rows).sort_values(["at", "row_id"], kind="stable")
        old = []
        for new in found["new"]:
            old.append(last)
            # what a change does not name stays
            fields |= json.loads(new)
            last = json.dumps(fields)
        self.last.update((last,))
        yield found.assign(old=old)[["key", "row_id", "name", "reviewer", "action", "reason", "old", "new"]]


def with_old(rows: DataFrame) -> DataFrame:
    """rows: key, row_id, ts, name, reviewer, action, reason and new (map of text) -> the same with old, what the key had before.

    With :func:`meridia.operators.exchange.audit_log` this is the change log of a
    stream of rows.  Null maps name no field; rows without a key take no part.
    Rows of one trigger count in order of time, then of row_id.
    """
    text = "key string, row_id long, name string, reviewer string, action string, reason string, old string, new string"
    new = F.to_json(F.coalesce("new", F.create_map().cast("map<string,string>")), {"ignoreNullFields": "false"})
    slim = rows.where("key is not null").select("key", "row_id", F.unix_micros("ts").alias("at"), "name", "reviewer", "action", "reason", new.alias("new"))
    made = slim.groupBy("key").transformWithStateInPandas(Changes(), text, "Append", "None")
    return made.withColumns({c: F.from_json(c, "map<string,string>") for c in ("old", "new")})
