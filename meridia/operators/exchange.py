"""What passes between this table and others: layer changes, survey and draft imports, and the audit log.

All of these are projections (the layer changes with one join on a key), so they
run on streams as on tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import number, text
from .lifecycle import quick_check

#: Fields that never make an audit row of their own.
UNLOGGED = ("GlobalID", "created_at", "updated_at", "delivery_date")


def audit_log(changes: DataFrame, key: str = "GlobalID") -> DataFrame:
    """changes: key, name, reviewer, action, reason, old and new (maps of text) -> audit rows.

    Every action but edit and update has a row without a field, with the reason as
    its new value; each field of ``new`` that differs has one more.  Null equals ''.
    A null action is no edit and so has its own row; null maps name no field.
    """
    was = lambda field: F.coalesce(F.try_element_at("old", field), F.lit(""))
    none = F.lit(None).cast("string")
    row = lambda field, old, new: F.struct(field.alias("field"), old.alias("old"), new.alias("new"))
    fields = F.filter(F.map_keys("new"), lambda f: ~f.isin(*UNLOGGED))
    each = F.transform(fields, lambda f: row(f, was(f), F.coalesce(F.try_element_at("new", f), F.lit(""))))
    differing = F.coalesce(F.filter(each, lambda r: r["old"] != r["new"]), F.array().cast("array<struct<field:string,old:string,new:string>>"))
    event = F.when(F.col("action").isin("edit", "update"), F.array().cast("array<struct<field:string,old:string,new:string>>")).otherwise(F.array(row(none, none, F.coalesce("reason", F.lit("")))))
    who = F.when(F.coalesce("reviewer", F.lit("")) == "", "unknown").otherwise(F.col("reviewer"))
    return changes.select(key, F.coalesce("name", F.lit("")).alias("name"), who.alias("reviewer"), "action", F.inline(F.concat(event, differing)))


def layer_changes(changes: DataFrame, known: DataFrame, fields: tuple[str, ...], key: str = "GlobalID") -> DataFrame:
    """changes: key, action, data (map of text); known: key and oid of the layer's rows -> key, action, oid, attributes, x, y.

    Only ``fields`` pass, as text, null as ''.  A created row always has a place (0
    where none is given); an updated one only if a coordinate is named and both are
    other than 0.  Updates and deletions of rows that the layer lacks are left
    out, and so are changes whose coordinates cannot be read.
    """
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    axis = lambda c: F.try_element_at(data, F.lit(c))
    value = lambda c: F.when(F.coalesce(axis(c), F.lit("")) == "", 0.0).otherwise(number(axis(c)))
    create, update = F.col("action") == "create", F.col("action") == "update"
    named = F.map_contains_key(data, "Latitude") | F.map_contains_key(data, "Longitude")
    passing = F.transform_values(F.map_filter(data, lambda k, v: k.isin(*fields) & (~create | (k != "GlobalID_DB"))), lambda k, v: F.coalesce(v, F.lit("")))
    attributes = F.when(create, F.map_concat(F.create_map(F.lit("GlobalID_DB"), F.col(key)), passing)).when(update, passing)
    placed = create | (update & named & (F.col("lat") != 0) & (F.col("lon") != 0))
    rows = changes.where(F.col("action").isin("create", "update", "delete")).join(known.select(key, "oid"), key, "left")
    rows = rows.withColumns({"lat": value("Latitude"), "lon": value("Longitude")}).where(create | F.col("oid").isNotNull())
    rows = rows.where((~create & ~(update & named)) | (F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    return rows.select(key, "action", F.when(~create, F.col("oid")).alias("oid"), attributes.alias("attributes"), F.when(placed, F.col("lon")).alias("x"), F.when(placed, F.col("lat")).alias("y"))


def survey_import(rows: DataFrame, mapping: dict[str, str], id_col: str = "objectid") -> DataFrame:
    """rows: id, attributes (map of text), x, y -> id and a text column for each mapped field.

    Blank answers count as none; of several answers for one field the last holds.
    The geometry fills coordinates that are missing, except where it is 0.  A row
    without a name is called after its id.
    """
    answer = lambda k: F.nullif(text(F.try_element_at("attributes", F.lit(k))), F.lit(""))
    targets = dict.fromkeys([*mapping.values(), "Name_EN", "Name_AR", "Longitude", "Latitude"])
    got = {t: F.coalesce(*[answer(k) for k, v in reversed(mapping.items()) if v == t], F.lit(None).cast("string")) for t in targets}
    for t, axis in (("Longitude", "x"), ("Latitude", "y")):
        got[t] = F.coalesce(got[t], F.when(F.col(axis) != 0, F.col(axis).cast("string")))
    unnamed = got["Name_EN"].isNull() & got["Name_AR"].isNull()
    got["Name_EN"] = F.when(unnamed, F.concat(F.lit("Survey123 Import #"), F.col(id_col).cast("string"))).otherwise(got["Name_EN"])
    got["Source"] = F.lit("survey123_import")
    return rows.select(id_col, *(c.alias(t) for t, c in got.items()))


#: Columns that a draft takes over as they are, by their names in the import.
TAKEN = {"Source": "Source_CSV"} | {c: c for c in ("Dup_Verdict", "Dup_Score", "Match_Type", "Similarity", "Distance_m", "Matched_Name", "Matched_GID")}


def draft_import(rows: DataFrame, batch: str, category: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Pending drafts of a file read as text, with their quick check; rows without any name are skipped.

    Absent columns count as ''.  The id follows from the batch and the row, so
    that a repeated task gives the same ids; equal rows of a batch share theirs.
    """
    own = lambda c: text(F.col(c)) if c in rows.columns else F.lit("")
    axis = lambda c: F.when(F.lower(own(c)) == "none", "").otherwise(own(c))
    lat, lon, link, extra = axis("Latitude"), axis("Longitude"), own("Google_Map"), own("Extra_Info")
    whole = F.concat_ws("\x1f", F.lit(batch), *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in rows.columns))
    made = {
        "GlobalID": F.concat(F.lit("{DRAFT-"), F.upper(F.substring(F.sha2(whole, 256), 1, 32)), F.lit("}")),
        "Name_EN": own("Name_EN"), "Name_AR": own("Name_AR"), "Category": category(own("Category")), "Subcategory": own("Subcategory"),
        "Original_Category": own("Category"), "Original_Subcategory": own("Subcategory"), "Latitude": lat, "Longitude": lon,
        "Phone_Number": own("Phone"), "Website": own("Website"),
        "Google_Map_URL": F.when((link == "") & (lat != "") & (lon != ""), F.concat(F.lit("https://www.google.com/maps?q="), lat, F.lit(","), lon)).otherwise(link),
        "Cuisine": text(F.replace(F.regexp_extract(extra, r"cuisine=\{([^}]*)\}", 1), F.lit('"'), F.lit(""))),
        **{to: own(c) for c, to in TAKEN.items()}, "Review_Notes": extra, "Import_Batch": F.lit(batch), "Draft_Status": F.lit("pending"),
    }
    return quick_check(rows.select(*(c.alias(n) for n, c in made.items())).where("Name_EN <> '' or Name_AR <> ''"))
