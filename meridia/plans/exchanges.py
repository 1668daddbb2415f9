"""The audit log, layer changes and draft imports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exchange as X
from .registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles
K = "CAST(substr(GlobalID, 4, 8) AS BIGINT)"
FIELDS = ("Name_EN", "Latitude")
BLANK_AXIS = "CASE WHEN coalesce({0}, '') = '' THEN 0.0 ELSE TRY_CAST({0} AS DOUBLE) END"


@query("lif_05", "poi", sql=f"""
, c AS (SELECT *, {K} % 3 AS k, coalesce(Name_EN, '') AS n FROM poi)
SELECT GlobalID, n AS name, 'unknown' AS reviewer, 'approve' AS action, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old, 'seen' AS new FROM c WHERE k = 0
UNION ALL
SELECT GlobalID, n, CASE WHEN k = 0 THEN 'unknown' ELSE 'r' || CAST(k AS VARCHAR) END, CASE WHEN k = 0 THEN 'approve' ELSE 'edit' END, 'Name_EN', n, upper(n) FROM c WHERE n <> upper(n)
UNION ALL
SELECT GlobalID, n, CASE WHEN k = 0 THEN 'unknown' ELSE 'r' || CAST(k AS VARCHAR) END, CASE WHEN k = 0 THEN 'approve' ELSE 'edit' END, 'Phone_Number', coalesce(Phone_Number, ''), '' FROM c WHERE coalesce(Phone_Number, '') <> ''
""")  # fmt: skip
def audit_rows(poi):
    """Names in capitals and phones removed: edits, and approvals with a reason by nobody."""
    k = F.expr(f"{K} % 3")
    own = lambda **c: F.create_map(*(x for n, v in c.items() for x in (F.lit(n), v)))
    changes = poi.select(
        "GlobalID", F.col("Name_EN").alias("name"), F.when(k != 0, F.concat(F.lit("r"), k.cast("string"))).alias("reviewer"), F.when(k == 0, "approve").otherwise("edit").alias("action"), F.lit("seen").alias("reason"),
        own(Name_EN=F.col("Name_EN").cast("string"), Phone_Number=F.col("Phone_Number").cast("string")).alias("old"),
        own(Name_EN=F.upper(F.col("Name_EN")), Phone_Number=F.lit(None).cast("string"), GlobalID=F.lit("x")).alias("new"),
    )
    return X.audit_log(changes)


@query("snk_06", "poi", sql=f"""
, c AS (SELECT GlobalID, {K} AS k, coalesce(Name_EN, '') AS name, CAST(Latitude AS VARCHAR) AS la, CAST(Longitude AS VARCHAR) AS lo FROM poi),
d AS (SELECT *, CASE k % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action, {BLANK_AXIS.format("la")} AS lat, {BLANK_AXIS.format("lo")} AS lon FROM c)
SELECT GlobalID, action, CASE WHEN action <> 'create' THEN k END AS oid, CASE WHEN action <> 'delete' THEN name END AS name,
    CASE WHEN action = 'create' OR (action = 'update' AND lat <> 0 AND lon <> 0) THEN lon END AS x, CASE WHEN action = 'create' OR (action = 'update' AND lat <> 0 AND lon <> 0) THEN lat END AS y
FROM d WHERE (action = 'create' OR k % 5 <> 0) AND (action = 'delete' OR (lat IS NOT NULL AND lon IS NOT NULL))
""")  # fmt: skip
def layer(poi):
    """A third of the places each created, updated and deleted, on a layer that lacks a fifth."""
    k = F.expr(K)
    data = F.create_map(*(x for c in ("Name_EN", "Latitude", "Longitude", "Website") for x in (F.lit(c), F.col(c).cast("string"))))
    changes = poi.select("GlobalID", F.element_at(F.array(*map(F.lit, ("create", "update", "delete"))), (k % 3 + 1).cast("int")).alias("action"), data.alias("data"))
    known = poi.select("GlobalID", k.alias("oid")).where("oid % 5 <> 0")
    return X.layer_changes(changes, known, FIELDS).select("GlobalID", "action", "oid", F.try_element_at("attributes", F.lit("Name_EN")).alias("name"), "x", "y")


@query("lif_12", "poi", sql=r"""
, s AS (SELECT regexp_replace(coalesce(Name_EN, ''), '^\s+|\s+$', '', 'g') AS e, regexp_replace(coalesce(Name_AR, ''), '^\s+|\s+$', '', 'g') AS a, regexp_replace(coalesce(Category, ''), '^\s+|\s+$', '', 'g') AS c,
    regexp_replace(coalesce(CAST(Latitude AS VARCHAR), ''), '^\s+|\s+$', '', 'g') AS la, regexp_replace(coalesce(CAST(Longitude AS VARCHAR), ''), '^\s+|\s+$', '', 'g') AS lo FROM poi),
g AS (SELECT e, a, c, CASE WHEN lower(la) = 'none' THEN '' ELSE la END AS la, CASE WHEN lower(lo) = 'none' THEN '' ELSE lo END AS lo FROM s)
SELECT e AS Name_EN, a AS Name_AR, c AS Category, la AS Latitude, lo AS Longitude, CASE WHEN la <> '' AND lo <> '' THEN 'https://www.google.com/maps?q=' || la || ',' || lo ELSE '' END AS Google_Map_URL
FROM g WHERE e <> '' OR a <> ''
""")
def drafts_of_a_file(poi):
    """The places, read as text, as drafts of one batch."""
    rows = poi.select(*(F.col(c).cast("string") for c in ("Name_EN", "Name_AR", "Category", "Latitude", "Longitude")))
    return X.draft_import(rows, "batch-1").select("Name_EN", "Name_AR", "Category", "Latitude", "Longitude", "Google_Map_URL")
