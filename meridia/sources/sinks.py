"""Exports: CSV, JSON lines, report folders, and change tables for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import verdict_counts

HIDDEN = ("created_at", "updated_at", "delivery_date")


BOM = "\ufeff"


def export_csv(pois: DataFrame, path: str, single_file: bool = False, bom: bool = True) -> None:
    """Ordered by name, without system times, nulls as ''; one file only where it is asked for.

    Each file starts with a byte order mark, which stands before its first
    column's name; an empty table gives the line "No data".
    """
    if pois.isEmpty():
        pois.sparkSession.range(1).select(F.lit("No data").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    shown = [c for c in pois.columns if c not in HIDDEN]
    rows = pois.orderBy(F.asc_nulls_last("Name_EN")).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(BOM + c if bom and i == 0 else c) for i, c in enumerate(shown)))
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("emptyValue", "").option("escape", '"').csv(path, header=True)


def json_rows(pois: DataFrame) -> DataFrame:
    """One JSON object per row, nulls as '', times in ISO form."""
    cols = [
        F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in pois.dtypes
    ]
    return pois.select(F.to_json(F.struct(*cols)).alias("json"))


def export_training(reviews: DataFrame, path: str, kind: str = "json") -> DataFrame:
    """Writes reviewed pairs, oldest first, as json or csv; returns total_samples, match_count, not_match_count."""
    rows = reviews.orderBy("created_at").write.mode("overwrite")
    rows.csv(path, header=True) if kind == "csv" else rows.json(path)
    return verdict_counts(reviews)


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own, so a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
