"""Layer changes, imports and the audit log on small and odd rows."""

from meridia.operators import exchange as X
from meridia.streaming import events
from pyspark.sql import functions as F

CHANGE = "GlobalID string, name string, reviewer string, action string, reason string, old map<string,string>, new map<string,string>"
CHANGES = [
    ("a", "Noor", "r", "edit", None, {"Phone": "1", "Note": None}, {"Phone": "2", "Note": "", "updated_at": "x"}),
    ("b", None, "", "archive", "closed", None, {"Review_Status": "Archived"}),
    ("c", "C", None, "flag", None, {}, None),
]
LOG = [
    ("a", "Noor", "r", "edit", "Phone", "1", "2"),
    ("b", "", "unknown", "archive", None, None, "closed"),
    ("b", "", "unknown", "archive", "Review_Status", "", "Archived"),
    ("c", "C", "unknown", "flag", None, None, ""),
]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_audit_log(spark):
    rows = spark.createDataFrame(CHANGES, CHANGE)
    assert order(X.audit_log(rows).collect()) == sorted(LOG, key=str)
    assert X.audit_log(rows.where("false")).count() == 0


def test_audit_log_as_a_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(CHANGES[:2], CHANGE).write.parquet(source)
    stream = lambda: X.audit_log(spark.readStream.schema(CHANGE).parquet(source))
    events.run_to_end(stream(), out, state)
    spark.createDataFrame(CHANGES[2:], CHANGE).write.mode("append").parquet(source)
    events.run_to_end(stream(), out, state)  # goes on where it was
    assert order(spark.read.parquet(out).drop("batch").collect()) == sorted(LOG, key=str)


def test_layer_changes(spark):
    rows = [
        ("a", "create", {"Name_EN": None, "Latitude": "24.5", "Longitude": "", "secret": "x", "GlobalID_DB": "z"}), ("b", "create", {"Latitude": "north"}),
        ("c", "update", {"Name_EN": "N", "Latitude": "24", "Longitude": "46"}), ("d", "update", {"Latitude": "24"}), ("e", "update", {"Name_EN": "N"}),
        ("f", "update", {"Latitude": "north"}), ("g", "delete", None), ("x", "update", {"Name_EN": "N"}), ("y", "delete", None), ("c", "else", {}),
    ]
    known = spark.createDataFrame([(k, i) for i, k in enumerate("abcdefg")], "GlobalID string, oid long")
    out = X.layer_changes(spark.createDataFrame(rows, "GlobalID string, action string, data map<string,string>"), known, ("GlobalID_DB", "Name_EN", "Latitude"))
    assert {r.GlobalID: (r.action, r.oid, r.attributes, r.x, r.y) for r in out.collect()} == {
        "a": ("create", None, {"GlobalID_DB": "a", "Name_EN": "", "Latitude": "24.5"}, 0.0, 24.5),
        "c": ("update", 2, {"Name_EN": "N", "Latitude": "24"}, 46.0, 24.0),
        "d": ("update", 3, {"Latitude": "24"}, None, None),
        "e": ("update", 4, {"Name_EN": "N"}, None, None),
        "g": ("delete", 6, None, None, None),
    }


def test_survey_import(spark):
    rows = [(1, {"n": " Noor ", "m": " ", "lat": "24"}, 46.5, 1.0), (2, {"m": "Last", "n": "First"}, 0.0, None), (3, None, None, None)]
    out = X.survey_import(spark.createDataFrame(rows, "objectid long, attributes map<string,string>, x double, y double"), {"n": "Name_EN", "m": "Name_EN", "lat": "Latitude"})
    got = {r.objectid: (r.Name_EN, r.Longitude, r.Latitude, r.Source) for r in out.collect()}
    assert got == {1: ("Noor", "46.5", "24", "survey123_import"), 2: ("Last", None, None, "survey123_import"), 3: ("Survey123 Import #3", None, None, "survey123_import")}


def test_draft_import(spark):
    rows = [(" Noor ", None, "cafe", "24.5", "46.5", 'a=1;cuisine={"Thai"}'), (None, " ", "x", "1", "1", None), ("B", "ب", None, "None", "46", None)]
    file = spark.createDataFrame(rows, "Name_EN string, Name_AR string, Category string, Latitude string, Longitude string, Extra_Info string")
    out = {r.Name_EN: r for r in X.draft_import(file, "b1", F.upper).collect()}
    a, b = out["Noor"], out["B"]
    assert len(out) == 2 and a.GlobalID != b.GlobalID and (a.Category, a.Original_Category, a.Cuisine, a.Draft_Status) == ("CAFE", "cafe", "Thai", "pending")
    assert (a.Google_Map_URL, b.Google_Map_URL, b.Latitude) == ("https://www.google.com/maps?q=24.5,46.5", "", "") and (a.QA_Blockers, a.QA_Warnings) == (1, 2)
    again = X.draft_import(file, "b1", F.upper).collect()
    assert {r.GlobalID for r in again} == {a.GlobalID, b.GlobalID}
