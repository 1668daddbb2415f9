"""Streams with keyed state and event ingestion as queries: each runs over events, written slice by slice, to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import audit_log
from ..sources.shared import shared_folder
from ..streaming import ingest, state

SLICES = 4
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def replay(rows: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame | None], ts: str = "ts", slices: int = SLICES) -> DataFrame | None:
    """``run`` over a stream of ``rows``, in ``slices`` of equal spans of time: after each is written it goes on from its checkpoint. The last result.

    A run reads all files of its slice in one trigger, so many tasks write and read a slice.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    share = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lit(ends.a))) / F.greatest(F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)), F.lit(1))
    before, found = spark.conf.get(NO_DATA), None
    try:
        for i in range(slices):
            inside = (share >= i / slices) & ((share < (i + 1) / slices) if i < slices - 1 else F.lit(True))
            rows.where(inside).write.mode("append").parquet(folder)
            # only the last run has no rows to come that make its timers run
            spark.conf.set(NO_DATA, before if i == slices - 1 else "false")
            found = run(spark.readStream.schema(rows.schema).parquet(folder))
    finally:
        spark.conf.set(NO_DATA, before)
    return found


def run_to_end(made: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there, trigger by trigger; the rows written so far, from this and earlier runs."""
    with state.keyed_state(made.sparkSession):
        made.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return made.sparkSession.read.schema(made.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of presence; every event stands for five beats, 15, 35, 55 or 75 seconds apart."""
    path = shared_folder(spark, "stream")
    beats = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", F.col("event_type").alias("view"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    )
    after = F.make_dt_interval(secs=F.col("i") * (15 + F.col("event_id") % 4 * 20))
    beats = beats.select("user_id", (F.col("ts") + after).alias("ts"), "view", F.col("event_id").cast("string").alias("poi"))
    gone = replay(beats, f"{path}/in", lambda rows: run_to_end(state.presence(rows), f"{path}/out", f"{path}/state"))
    here = state.still_present(spark, f"{path}/state")
    named = lambda df, status: df.select("user_id", F.timestamp_micros("since").cast("timestamp_ntz").alias("since"), F.timestamp_micros("seen").cast("timestamp_ntz").alias("seen"), "beats", F.lit(status).alias("status"))
    return named(gone, "gone").unionByName(named(here, "present"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What polls show: clicks and signups are updates to their user, views are polls, errors acknowledge all."""
    path = shared_folder(spark, "stream")
    events = _events(spark, sf_dir).where(F.col("user_id").isNotNull()).select(F.col("user_id").cast("string").alias("consumer"), F.col("event_id").alias("row_id"), "ts", "event_type", F.lit(None).cast("array<long>").alias("ids"))

    def run(rows: DataFrame) -> DataFrame:
        kind = lambda *names: rows.where(F.col("event_type").isin(*names))
        return run_to_end(state.feed(kind("click", "signup"), kind("error"), kind("view")), f"{path}/out", f"{path}/state")

    return replay(events, f"{path}/in", run)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of 300 places that events write to; errors are flags, the others edits."""
    path = shared_folder(spark, "stream")
    fields = F.create_map(F.lit("status"), F.col("event_type"), F.lit("level"), F.floor("value").cast("string"), F.lit("updated_at"), F.col("ts").cast("string"))
    flag = F.col("event_type") == "error"
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("P"), (F.col("event_id") % 300).cast("string")).alias("key"), F.col("event_id").alias("row_id"), "ts", F.lit(None).cast("string").alias("name"), F.col("user_id").cast("string").alias("reviewer"),
        F.when(flag, "flag").otherwise("edit").alias("action"), F.when(flag, "seen").alias("reason"), fields.alias("new"),
    )
    named = lambda df: df.withColumn("GlobalID", F.concat_ws("/", "key", F.col("row_id").cast("string")))
    return audit_log(replay(rows, f"{path}/in", lambda stream: run_to_end(named(state.with_old(stream)), f"{path}/out", f"{path}/state")))


def ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of places after events by their users' shops; the even shops are known before."""
    path = shared_folder(spark, "stream")
    user = F.col("user_id").cast("string")
    events = _events(spark, sf_dir).where("user_id is not null").select(
        "event_id", "ts",
        F.when((F.col("user_id") % 2 == 1) | (F.col("event_id") % 7 != 0), F.concat(F.lit("Shop "), user)).alias("Name_EN"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("محل "), user)).alias("Name_AR"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("Category"),
        F.when(F.col("event_id") % 3 == 0, F.floor(F.col("value") * 100).cast("string")).alias("Phone_Number"),
    )
    known = _events(spark, sf_dir).where("user_id % 2 = 0").select("user_id").distinct().select(
        F.concat(F.lit("{S-"), user, F.lit("}")).alias("GlobalID"), F.concat(F.lit("Shop "), user).alias("Name_EN"), F.concat(F.lit("محل "), user).alias("Name_AR"), F.lit("known").alias("Category"), F.lit("0").alias("Phone_Number")
    )
    ingest.create_table(known, f"{path}/table")
    upsert = ingest.upsert_events(path)
    replay(events, f"{path}/in", lambda rows: rows.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination())
    queue = spark.read.parquet(f"{path}/queue").groupBy("GlobalID").agg(F.count_if(F.col("action") == "create").alias("creates"), F.count_if(F.col("action") == "update").alias("updates"))
    return ingest.read_table(spark, f"{path}/table").join(queue, "GlobalID", "left").select("Name_EN", "Name_AR", "Category", "Phone_Number", F.coalesce("creates", F.lit(0)).alias("creates"), F.coalesce("updates", F.lit(0)).alias("updates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stm_01": ingestion, "stm_02": presence, "stm_03": feed, "stm_05": changes}

ORACLES = {
    "stm_01": """
        WITH e AS (
            SELECT user_id, event_id, ts, CASE WHEN event_type <> 'view' THEN event_type END AS cat, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS phone
            FROM events WHERE user_id IS NOT NULL)
        SELECT 'Shop ' || user_id AS Name_EN, CASE WHEN user_id % 2 = 0 THEN 'محل ' || user_id END AS Name_AR,
            coalesce(arg_max(cat, (ts, event_id)) FILTER (cat IS NOT NULL), CASE WHEN user_id % 2 = 0 THEN 'known' END) AS Category,
            coalesce(arg_max(phone, (ts, event_id)) FILTER (phone IS NOT NULL), CASE WHEN user_id % 2 = 0 THEN '0' END) AS Phone_Number,
            CAST(user_id % 2 AS BIGINT) AS creates, count(*) - user_id % 2 AS updates
        FROM e GROUP BY user_id""",
    "stm_02": """
        WITH b AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts + to_seconds(i * (15 + event_id % 4 * 20)) AS ts FROM events, range(5) t(i) WHERE user_id IS NOT NULL),
        g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g),
        s AS (SELECT user_id, span, min(ts) AS since, max(ts) AS seen, count(*) AS beats FROM n GROUP BY user_id, span)
        SELECT user_id, since, seen, beats, CASE WHEN seen + INTERVAL 60 SECOND < (SELECT max(ts) - INTERVAL 10 SECOND FROM b) THEN 'gone' ELSE 'present' END AS status FROM s""",
    "stm_03": """
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS consumer, event_id AS id, event_type AS kind, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE user_id IS NOT NULL),
        k AS (SELECT *, coalesce(max(CASE WHEN kind = 'error' THEN pos END) OVER (PARTITION BY consumer ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS acked FROM e),
        u AS (SELECT * FROM k WHERE kind IN ('click', 'signup')),
        p AS (SELECT * FROM k WHERE kind = 'view'),
        f AS (SELECT p.consumer, p.id AS poll_id, p.pos, p.acked, u.id AS update_id, u.pos AS u_pos, row_number() OVER (PARTITION BY p.id ORDER BY u.pos DESC) AS place FROM p JOIN u ON u.consumer = p.consumer AND u.acked = p.acked AND u.pos < p.pos),
        a AS (
            SELECT p.consumer, p.id AS poll_id, f.update_id, row_number() OVER (PARTITION BY p.id ORDER BY f.pos DESC, f.u_pos DESC) AS place
            FROM p JOIN f ON f.consumer = p.consumer AND f.acked = p.acked AND f.pos <= p.pos WHERE f.place <= 50)
        SELECT consumer, poll_id, CAST(place AS INTEGER) AS place, update_id FROM a WHERE place <= 50""",
    "stm_05": """
        WITH r AS (SELECT 'P' || event_id % 300 AS key, event_id AS id, ts, CAST(user_id AS VARCHAR) AS reviewer, event_type = 'error' AS flag, event_type AS status, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS level FROM events),
        o AS (SELECT *, key || '/' || id AS gid, CASE WHEN flag THEN 'flag' ELSE 'edit' END AS action, coalesce(reviewer, 'unknown') AS who, coalesce(lag(status) OVER w, '') AS s, coalesce(lag(level) OVER w, '') AS l FROM r WINDOW w AS (PARTITION BY key ORDER BY ts, id))
        SELECT gid AS GlobalID, '' AS name, who AS reviewer, action, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old, 'seen' AS new FROM o WHERE flag
        UNION ALL SELECT gid, '', who, action, 'status', s, coalesce(status, '') FROM o WHERE s <> coalesce(status, '')
        UNION ALL SELECT gid, '', who, action, 'level', l, coalesce(level, '') FROM o WHERE l <> coalesce(level, '')""",
}
