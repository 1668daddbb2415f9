"""Places, drafts and payloads from CSV and JSON; everything is read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, escape: str = '"') -> DataFrame:
    """All columns as text, so that long digit strings keep their digits; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape=escape, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def payload_attributes(payload: Column) -> Column:
    """Attributes of a survey payload in any of its three shapes: feature.attributes, attributes, or flat; map<string,string>."""
    kind = "map<string,string>"
    nested, inner = F.get_json_object(payload, "$.feature.attributes"), F.get_json_object(payload, "$.attributes")
    return F.from_json(F.coalesce(nested, inner, payload), kind)


def geometry(payload: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the payload's geometry."""
    at = lambda axis: F.get_json_object(payload, f"$.feature.geometry.{axis}").try_cast("double")
    return at("x"), at("y")


def mapped_fields(attributes: Column, mapping: dict[str, str]) -> Column:
    """Attributes under the engine's names: keys in lower case with _ for spaces; later keys win, nulls go."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    named = F.filter(F.transform(entries, lambda e: F.struct(F.try_element_at(table, F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_"))).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def naive_fields(line: Column) -> Column:
    r"""Fields of a line in the dialect of the seed files: a quote opens or closes wherever it stands, ``\"`` is a quote, commas outside quotes part.

    The control characters 1 and 2 may not stand in a line.
    """
    quote, comma = F.lit("\x01"), F.lit("\x02")
    parts = F.split(F.replace(line, F.lit('\\"'), quote), '"', -1)
    # every second part is inside quotes
    parted = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), comma)).otherwise(p))
    return F.transform(F.split(F.array_join(parted, ""), "\x02", -1), lambda f: F.replace(f, quote, F.lit('"')))


def read_naive_csv(spark: SparkSession, path: str) -> DataFrame:
    """A seed file, line by line: blank lines go, missing fields are '', all columns are text.

    The first line that is not blank names the columns; quoted fields hold no line breaks.
    """
    lines = spark.read.text(path).where("value <> ''")
    head = lines.select(naive_fields(F.col("value")).alias("f"), "value").first()
    if head is None:
        return spark.createDataFrame([], "value string")
    fields = lines.where(F.col("value") != head.value).select(naive_fields(F.col("value")).alias("f"))
    return fields.select(*(F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(head.f)))
