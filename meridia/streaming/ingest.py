"""Survey events to a table of places, one batch of a stream at a time.

The table lies in folders by bucket of the key, and a batch writes only the
buckets it touches.  Which place an event belongs to is decided once for each
batch and written down first, so a batch that is repeated after a failure comes
to the same table and the same queue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import guid_of
from ..operators.review import known_names

FIELDS = ("Name_EN", "Name_AR", "Category", "Phone_Number")


def _complete(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def bucket_of(buckets: int, key: str = "GlobalID"):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_table(places: DataFrame, path: str, buckets: int = 16, fields: tuple[str, ...] = FIELDS) -> None:
    """Lays a table out by bucket; this batch has number -1."""
    places.select("GlobalID", *fields).withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return spark.read.schema(f"GlobalID string, {', '.join(f'{f} string' for f in fields)}, bucket int").parquet(path)


def decide(events: DataFrame, places: DataFrame) -> DataFrame:
    """+ GlobalID, action (create or update) of each event.

    An event belongs to the place, known before the batch, that has its Name_EN,
    or else its Name_AR; of several to that with the smallest id.  Others make new
    places, one for each Name_EN, or Name_AR where that is blank; the first event
    creates, the next ones update.  Events without a name and without any field
    are left out.
    """
    given = F.coalesce(*(F.col(f) for f in FIELDS)).isNotNull()
    name = lambda f: F.nullif(f, F.lit(""))
    found = known_names(events.where(given), places).withColumnRenamed("known", "_old")
    own = F.coalesce(name(F.col("Name_EN")), name(F.col("Name_AR")), F.concat(F.lit("\x00"), F.col("event_id").cast("string")))
    found = found.withColumn("GlobalID", F.coalesce("_old", guid_of(own)))
    first = found.where("_old is null").groupBy("GlobalID").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    creates = F.struct("ts", "event_id") == F.col("_first")
    return found.join(first, "GlobalID", "left").withColumn("action", F.when(creates, "create").otherwise("update")).select(*events.columns, "GlobalID", "action")


def folded(decided: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per place: of each field the last value that any event gives."""
    order = F.struct("ts", "event_id")
    return decided.groupBy("GlobalID").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))


def upsert_events(path: str, buckets: int = 16, fields: tuple[str, ...] = FIELDS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over events (event_id, ts and ``fields``, null for what an event does not name).

    ``path`` holds ``table`` (see :func:`create_table`), ``queue`` (a row per event:
    event_id, GlobalID, name, action, by batch) and ``staged``.  At most ``buckets``
    numbers reach the driver.
    """

    def write(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        queue, staged, table = f"{path}/queue/batch={batch}", f"{path}/staged/batch={batch}", f"{path}/table"
        if not _complete(spark, queue):
            decided = decide(events.select("event_id", "ts", *fields), read_table(spark, table, fields))
            decided.withColumn("name", F.coalesce(F.nullif("Name_EN", F.lit("")), "Name_AR", F.lit(""))).write.mode("overwrite").parquet(queue)
        changes = folded(spark.read.parquet(queue), fields).withColumn("bucket", bucket_of(buckets))
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]
        if not touched:
            return
        if not _complete(spark, staged):
            old = read_table(spark, table, fields).where(F.col("bucket").isin(touched)).alias("o")
            both = old.join(changes.alias("c"), ["GlobalID", "bucket"], "full")
            both.select("GlobalID", *(F.coalesce(f"c.{f}", f"o.{f}").alias(f) for f in fields), "bucket").write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return write
