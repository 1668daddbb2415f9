"""Reviewers' operators on small and odd rows."""

import pytest
from meridia.operators import review as V
from meridia.operators import rules as R
from meridia.sources import sinks
from pyspark.sql import functions as F

FIELDS = ("GlobalID", "Name_EN", "Name_AR", "Website", "Google_Map_URL", "Phone_Number", "Email", "Floor_Number", "Menu", "WiFi", "Exterior_Photo_URL", "Interior_Photo_URL", "Menu_Photo_URL", "Category", "Review_Status")


def places(spark, *rows):
    made = [tuple(r.get(f) for f in FIELDS) + (r.get("review_version"),) for r in rows]
    return spark.createDataFrame(made, ", ".join(f"{f} string" for f in FIELDS) + ", review_version int")


def test_safe_fixes_name_each_change_and_leave_the_rest(spark):
    odd = {
        "GlobalID": "a", "Name_EN": " Noor\n", "Website": " https://goo.gl/maps/1", "Phone_Number": "9.66E+11", "Email": "a@b", "Floor_Number": " roof ", "Menu": "Y", "WiFi": " fast ",
        "Exterior_Photo_URL": "http://x/1", "Interior_Photo_URL": "http://x/1", "Menu_Photo_URL": "http://x/1", "review_version": None,
    }
    clean = {"GlobalID": "b", "Name_EN": "Noor", "Email": "a@b.c", "Floor_Number": "B1", "Menu": " Yes ", "WiFi": "unapplicable", "review_version": 4}
    out = {r.GlobalID: r for r in V.safe_fixes(places(spark, odd, clean, {"GlobalID": "c"})).collect()}
    a = out["a"]
    assert (a.Name_EN, a.Website, a.Google_Map_URL, a.Phone_Number, a.Email, a.Floor_Number, a.Menu, a.WiFi) == ("Noor", "UNAVAILABLE", " https://goo.gl/maps/1", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE", "Yes", "UNAVAILABLE")
    assert (a.Exterior_Photo_URL, a.Interior_Photo_URL, a.Menu_Photo_URL, a.review_version) == ("http://x/1", "UNAVAILABLE", "UNAVAILABLE", 1)
    assert [f.reason for f in a.fixes if f.field.endswith("Photo_URL")] == ["duplicate of Exterior_Photo_URL"] * 2 and len(a.fixes) == 11
    assert (out["b"].fixes, out["b"].Menu, out["b"].review_version) == ([], " Yes ", 4) and out["c"].fixes == []


@pytest.mark.parametrize(
    "values, codes",
    [
        ({}, "N1 N2 M5 M6 D1 L1 M3 M4 M7 H1"),
        ({"Name_AR": "نور", "Name_EN": "Noor", "Category": "Cafe", "Menu": "Yes", "Phone_Number": "(050) 123-4567", "Email": "UNAPPLICABLE", "Website": "HTTP://a"}, "M6 D1 L1 M3 M4 M7 H1"),
        ({"Name_AR": "نور", "Name_EN": "Noor", "Category": "Hotel", "Menu": "Yes", "Phone_Number": "12", "Email": "a b@c.d", "Website": "a.b", "Exterior_Photo_URL": "x", "Interior_Photo_URL": " x"}, "M6 D1 L1 M3 M4 M7 H1 V1 P1 E1 U1 FNB"),
    ],
)
def test_page_rules(spark, values, codes):
    assert " ".join(f.code for f in V.page_findings(places(spark, values)).first().findings) == codes


def test_page_rules_read_other_text_as_no_number(spark):
    row = places(spark, {}).withColumn("Latitude", F.lit("north")).withColumn("Longitude", F.lit("46.5"))
    assert [f.code for f in V.page_findings(row).first().findings if f.code[0] in "LM"] == ["M5", "M6", "M3", "M7"]


def test_verdicts_need_all_fields_and_a_known_word(spark):
    rows = spark.createDataFrame([("a", "b", "r", "match"), ("a", "c", None, "MATCH"), ("a", "d", "r", "perhaps"), ("a", None, "r", "MATCH"), ("a", "e", "r", None)], "source_gid string, candidate_gid string, reviewer string, verdict string")
    good, refused = V.checked_verdicts(rows)
    assert [tuple(r) for r in good.collect()] == [("a", "b", "r", "MATCH")]
    assert sorted(r.error for r in refused.collect()) == ["missing:candidate_gid", "missing:reviewer", "missing:verdict", "verdict"]
    pairs = rows.select("source_gid", "candidate_gid").where("candidate_gid is not null")
    counts = {k: V.pairs_by_verdict(pairs, good, k).count() for k in ("unreviewed", "match", "not_match", "all")}
    assert counts == {"unreviewed": 3, "match": 1, "not_match": 0, "all": 4}


def test_media_lists_and_attachments(spark):
    pois = places(spark, {"GlobalID": "a", "Exterior_Photo_URL": " http://x/1 , ,http://x/2", "Menu_Photo_URL": "UNAVAILABLE"}, {"GlobalID": "b", "Name_EN": "Noor"})
    assert sorted((r.name, r.type, r.url) for r in V.media_items(pois).collect()) == [("Unnamed", "exterior", "http://x/1"), ("Unnamed", "exterior", "http://x/2")]
    kinds = spark.createDataFrame([("a.MOV", None, None), ("menu.mp4", "", ""), ("x", "Interior, exterior", ""), ("licence.png", "", ""), (None, "LICENCE", ""), ("x", "walkthrough menu", "video/mp4")], "n string, k string, t string")
    assert [r.y for r in kinds.select(V.attachment_type(F.col("n"), F.col("k"), F.col("t")).alias("y")).collect()] == ["video", "menu", "exterior", "other", "license", "interior"]


def test_batch_checks(spark):
    rows = spark.createDataFrame([(x,) for x in ("1010101010", "1.01E+9", "12 34", "123", "N/A", None, "101-010-1010")], "x string")
    assert [r.y for r in rows.select(V.licence_error(F.col("x")).alias("y")).collect()] == [None, "INVALID_LICENSE", "INVALID_LICENSE", "LICENSE_NOT_10_DIGITS", None, None, None]
    names = spark.createDataFrame([("فرع 1", "Noor branch"), (None, "050 123 4567"), ("نور", None)], "a string, e string")
    assert [r.y for r in names.select(V.name_errors(F.col("a"), F.col("e")).alias("y")).collect()] == [["NAME_CONTAINS_BRANCH"] * 3, ["NAME_CONTAINS_PHONE"], []]


def test_search_is_literal_and_lower_cases_the_query(spark):
    pois = places(spark, {"GlobalID": "A%", "Name_EN": "Noor"}, {"GlobalID": "B", "Name_AR": "ABC", "Review_Status": "Draft"})
    found = lambda **k: [r.GlobalID for r in V.filtered(pois.withColumn("flagged", F.lit(None).cast("boolean")), **k).collect()]
    assert (found(search="%"), found(search="NOOR"), found(search="ABC"), found(tab="pending", status="pending"), found(tab="flagged")) == (["A%"], ["A%"], [], ["A%", "B"], [])


def test_decisions_on_drafts_and_new_places(spark):
    rows = spark.createDataFrame([("a", "pending", None), ("b", "confirmed", "x"), ("c", None, "x"), ("d", "pending", "x")], "GlobalID string, Draft_Status string, Review_Notes string")
    out = V.reject_drafts(rows, rows.where("GlobalID <> 'd'"), "r", "; no", F.current_timestamp()).orderBy("GlobalID")
    assert [(r.Draft_Status, r.Review_Notes) for r in out.collect()] == [("rejected", "; no"), ("confirmed", "x"), ("rejected", "x; no"), ("pending", "x")]
    fresh = places(spark, {}, {"GlobalID": "x", "Review_Status": "Reviewed", "review_version": 3}).withColumn("draft_reason", F.lit(None).cast("string"))
    made = V.create_defaults(fresh).collect()
    assert [(r.Review_Status, r.draft_reason, r.review_version) for r in made] == [("Draft", "new", 0), ("Reviewed", None, 3)] and len(made[0].GlobalID) == 38 and made[1].GlobalID == "x"


def test_right_map_wins_and_null_counts_as_empty(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"}), ({"a": "1"}, None)], "o map<string,string>, n map<string,string>")
    assert [r.m for r in rows.select(V.merged(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}, {"a": "1"}]


def test_exports_start_with_a_mark_and_tell_when_there_is_nothing(spark, tmp_path):
    pois = places(spark, {"GlobalID": "a", "Name_EN": "Noor"}, {"GlobalID": "b", "Name_EN": "Baik"})
    read = lambda name: "".join(p.read_text("utf-8") for p in (tmp_path / name).glob("part-*")).splitlines()
    sinks.export_csv(pois, str(tmp_path / "some"), single_file=True)
    sinks.export_csv(pois.where("false"), str(tmp_path / "none"))
    lines = read("some")
    assert lines[0].startswith("\ufeffGlobalID,Name_EN") and [x.split(",")[0] for x in lines[1:]] == ["b", "a"] and read("none") == ["No data"]
    reviews = spark.createDataFrame([("a", "MATCH", 2), ("b", "NOT_MATCH", 1), ("c", "MATCH", 3)], "source_gid string, verdict string, created_at int")
    for kind in ("json", "csv"):
        assert tuple(sinks.export_training(reviews, str(tmp_path / kind), kind).first()) == (3, 2, 1)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 3


def test_blockers_of_the_rules_stand_in_the_way_of_approval(spark):
    pois = places(spark, {"GlobalID": "a", "Name_EN": "N", "Category": "Cafe"}, {"GlobalID": "b", "Name_EN": "N", "Category": "Cafe"})
    pois = pois.withColumns({"Latitude": F.lit("24.5"), "Longitude": F.lit("46.5"), "flagged": F.lit(False), "QA_Score": F.lit("99")})
    counts = spark.createDataFrame([("a", 2)], "GlobalID string, blockers long")
    assert {r.GlobalID: r.reasons for r in R.approval_blockers(pois, counts).collect()} == {"a": ["validation:2"], "b": []}
    assert [r.reasons for r in R.approval_blockers(pois).collect()] == [[], []]


def test_shared_media_tell_the_first_three_other_uses(spark):
    rows = [("a", "A", "http://x/1", "http://x/1", None), ("b", None, "http://x/1", "", "http://x/2"), ("c", "C", "", "http://x/1 ", "http://x/2"), ("d", "D", "UNAVAILABLE", "http://x/3", "http://x/1"), ("e", "E", None, "http://x/4", "http://x/4")]
    pois = spark.createDataFrame(rows, "GlobalID string, Name_EN string, Exterior_Photo_URL string, Interior_Photo_URL string, Video_URL string")
    found = {(r.GlobalID, r.field[:2], r.others, r.names) for r in R.shared_media(pois).collect()}
    assert found == {("a", "Ex", 3, ", C, D"), ("a", "In", 3, ", C, D"), ("b", "Ex", 4, "A, A, C"), ("b", "Vi", 1, "C"), ("c", "In", 4, "A, A, "), ("c", "Vi", 1, ""), ("d", "Vi", 4, "A, A, ")}


def test_search_within_one_field(spark):
    """an id that holds the digits of the phone searched for was found too."""
    rows = [("{C-00005012}", "A", "", "", True), ("{C-00000001}", "B", "0501", "", True), ("{C-00000002}", "0501", "", "", True)]
    pois = spark.createDataFrame(rows, "GlobalID string, Name_EN string, Phone_Number string, Category string, flagged boolean").withColumns({"Name_AR": F.lit(""), "Review_Status": F.lit("")})
    found = lambda **k: sorted(r.GlobalID[-3:-1] for r in V.filtered(pois, "flagged", search="0501", **k).collect())
    assert found(within=("Phone_Number",)) == ["01"]
    assert found() == ["01", "02", "12"]
