import json

import pytest
from meridia.functions import payload as P
from meridia.operators import analytics as A
from meridia.operators import exchange as X
from meridia.operators import lifecycle as L
from meridia.operators import review as W
from meridia.operators import rules as V
from meridia.sources import readers
from pyspark.sql import functions as F

PAYLOADS = [
    ('{"feature": {"attributes": {"Name EN": "A", "n": null, "deep": {"x": [1, 2]}}, "geometry": {"x": 46.5, "y": 24.5}}}', {"Name EN": "A", "n": None, "deep": {"x": [1, 2]}, "longitude": 46.5, "latitude": 24.5}),
    ('{"feature": {"attributes": {"longitude": 1}, "geometry": {"x": 46.5, "y": 0}}}', {"longitude": 1}),
    ('{"feature": {"a": 1}}', {"a": 1}), ('{"attributes": {"a": [{"b": 2}]}}', {"a": [{"b": 2}]}), ('{"a": true, "é": "x"}', {"a": True, "é": "x"}), ("{}", {}),
    ("[1, 2]", None), ('"text"', None), ("{broken", None), ("", None), (None, None),
]


def test_payloads_of_every_shape_keep_what_is_nested(spark):
    frame = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string")
    got = {r.i: r.m for r in frame.select("i", F.to_json(P.attributes(F.col("p"))).alias("m")).collect()}
    assert {i: m and json.loads(m) for i, m in got.items()} == {i: e for i, (_, e) in enumerate(PAYLOADS)}


@pytest.mark.parametrize("old,new,both", [
    ('{"a": 1, "d": {"x": 1, "y": 2}}', '{"d": {"x": 3}, "n": null}', {"a": 1, "d": {"x": 3}, "n": None}), ('{"a": 1}', None, {"a": 1}), (None, '{"a": 1}', {"a": 1}),
    ('{"a": 1}', "[1]", {"a": 1}), ("{broken", '{"a": [1, {"b": 2}]}', {"a": [1, {"b": 2}]}), (None, None, None), ("{}", "{}", {}),
])
def test_merged_objects(spark, old, new, both):
    got = spark.createDataFrame([(old, new)], "old string, new string").select(P.merged_json(F.col("old"), F.col("new")).alias("m")).first().m
    assert (got and json.loads(got)) == both


def test_draft_statistics_count_every_grouping(spark):
    rows = [("pending", "NEW", f"C{i % 40:02}", i % 2) for i in range(80)] + [("pending", None, c, None) for c in ("", None)] + [("done", "DUP", "C00", 0), (None, "", "C01", 5)]
    drafts = spark.createDataFrame(rows, "Draft_Status string, Dup_Verdict string, Category string, QA_Blockers int")
    got = {(r.grouping, r.name): r.n for r in A.draft_statistics(drafts).collect()}
    expected = {("total", None): 84, ("by_status", "pending"): 82, ("by_status", "done"): 1, ("by_status", None): 1, ("by_verdict", "NEW"): 80, ("by_verdict", None): 2, ("by_verdict", "DUP"): 1, ("by_verdict", ""): 1, ("by_check", "qa_pass"): 40, ("by_check", "qa_fail"): 40}
    expected |= {("by_category", "(empty)"): 2} | {("by_category", f"C{i:02}"): 2 for i in range(29)}
    assert got == expected
    assert [(r.grouping, r.n) for r in A.draft_statistics(drafts.where("false")).collect()] in ([("total", 0)], [])


def test_a_page_knows_its_total(spark):
    rows = spark.range(120).select("id", (F.col("id") % 7).alias("k"))
    page = A.page_with_total(rows.where("k = 3"), [F.asc("id")], number_=1, size=5).collect()
    assert [(r.id, r.total) for r in page] == [(38, 17), (45, 17), (52, 17), (59, 17), (66, 17)]
    assert A.page_with_total(rows.where("false"), [F.asc("id")]).count() == 0


PLACE = "GlobalID string, Name_EN string, Name_AR string, Review_Status string, rejected_reason string, archived_reason string, flagged boolean, flag_reason string, Review_Flag string"


def test_actions_on_places(spark):
    rows = [("a", "A", None, "Draft", None, None, None, None, None), ("b", "", "ب", "Rejected", "old", None, False, "x", "x"), ("c", None, None, None, None, None, True, "y", "y"), (None, "N", None, "Draft", None, None, None, None, None)]
    pois = spark.createDataFrame(rows, PLACE)
    ids = spark.createDataFrame([("a", "r1", "bad"), ("a", "r1", "bad"), ("b", "r2", "bad"), ("c", None, ""), ("z", "r", "bad"), (None, "r", "bad")], "GlobalID string, reviewer string, reason string")
    table, changes, refused = L.reject_places(pois, ids)
    assert {(r.GlobalID, r.refused) for r in refused.collect()} == {("b", "already rejected"), ("c", "a reason is required"), ("z", "not found"), (None, "not found")}
    assert table.count() == 4 and {(r.GlobalID, r.Review_Status, r.rejected_reason) for r in table.collect()} == {("a", "Rejected", "bad"), ("b", "Rejected", "old"), ("c", None, None), (None, "Draft", None)}
    assert {(r.field, r.old, r.new) for r in X.audit_log(changes).collect()} == {(None, None, "bad"), ("Review_Status", "Draft", "Rejected"), ("rejected_reason", "", "bad")}
    table, changes, refused = L.archive_places(pois, ids)
    assert {r.GlobalID for r in refused.collect()} == {"z", None} and table.where("Review_Status = 'Archived'").count() == 3
    table, changes, _ = L.flag_places(pois, ids, flagged=False)
    assert {(r.GlobalID, r.flagged, r.flag_reason, r.Review_Flag, r.Review_Status) for r in table.where("GlobalID is not null").collect()} == {("a", False, "", "", "Draft"), ("b", False, "", "", "Rejected"), ("c", False, "", "", None)}
    assert {(r.GlobalID, r.field, r.old, r.new) for r in X.audit_log(changes).collect() if r.field == "flagged"} == {("a", "flagged", "", "False"), ("c", "flagged", "True", "False")}


def test_taxonomy_findings(spark):
    tree = spark.createDataFrame([("Food", "Cafe", "Coffee"), ("Food", "Cafe", "Tea"), ("Food", "Diner", None), ("Mosques", None, None)], "category string, subcategory string, level3 string")
    rows = [("1", "Food", "Cafe", "Tea"), ("2", "Food", "Cafe", "Beer"), ("3", "Food", "Bar", "x"), ("4", "Zoo", "Cafe", "Tea"), ("5", "Mosques", "any", "x"), ("6", "Food", "Diner", "x"), ("7", None, "x", "y"), ("8", "Food", "", "y"), ("9", " Food ", "Cafe", None)]
    pois = spark.createDataFrame(rows, "GlobalID string, Category string, Subcategory string, Category_Level_3 string")
    got = {(r.GlobalID, r.rule_id, r.field) for r in V.taxonomy_findings(pois, tree).collect()}
    assert got == {("2", "GATE-E6", "Category_Level_3"), ("3", "GATE-E5", "Subcategory"), ("4", "GATE-E4", "Category")}
    assert V.taxonomy_findings(pois.select("GlobalID", "Category"), tree).count() == 1
    assert V.taxonomy_findings(pois, tree.where("false")).count() == 8


def test_versions_are_reset(spark):
    pois = spark.createDataFrame([("a", 7), ("b", None)], "GlobalID string, review_version int")
    assert [r.review_version for r in L.reset_versions(pois).collect()] == [1, 1]


def plain_fields(line):
    """The seed dialect, a character at a time."""
    out, now, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            inside = not inside
        elif c == "," and not inside:
            out.append(now)
            now = ""
        elif c == "\\" and line[i + 1 : i + 2] == '"':
            now += '"'
            i += 1
        else:
            now += c
        i += 1
    return [*out, now]


def test_seed_lines_are_read_as_a_walk_reads_them(spark, tmp_path):
    lines = ['a,"b,c",d', 'x\\"y,"p\\"q,r",', '"open, to the end', "", ",,", "\\\\,\\n", '"a""b",c', 'é,"日,本"', '"', "\\\\\"x,y\\\\\"", "a" * 20_000 + ',"' + "b," * 9_000 + '"']
    got = {r.value: r.f for r in spark.createDataFrame([(x,) for x in lines], "value string").select("value", readers.naive_fields(F.col("value")).alias("f")).collect()}
    assert got == {x: plain_fields(x) for x in lines}
    (tmp_path / "seed.csv").write_text('id,"Name (EN)",note\r\n1,"A, B",x\r\n\r\n2,\\"q\\"\n', encoding="utf-8")
    rows = readers.read_naive_csv(spark, str(tmp_path / "seed.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "A, B", "x"), ("2", '"q"', "")] and rows[0].asDict().keys() == {"id", "Name (EN)", "note"}
    (tmp_path / "none.csv").write_text("")
    assert readers.read_naive_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_form_constraints(spark):
    rows = [("1", "24.7", "x", "Food", "Yes", "ab12"), ("2", "23.9", "y", "Food", "", "12"), ("3", "east", "q", "Bank", "No", None), ("4", None, "", None, None, ""), ("5", "25.5", "x", "Food", "maybe", "a1")]
    pois = spark.createDataFrame(rows, "GlobalID string, Latitude string, kind string, Category string, Dine_In string, code string")
    constraints = [
        V.Constraint("Latitude", least=24, most=25.5), V.Constraint("kind", choices=("x", "y")), V.Constraint("code", pattern=r"[a-z]+\d+"),
        V.Constraint("Dine_In", required=True, choices=("Yes", "No"), when=("Category", ("Food",))), V.Constraint("absent", least=1, required=True),
    ]
    got = {(r.GlobalID, r.field, r.problem) for r in V.form_findings(pois, constraints).collect() if r.field != "absent"}
    assert got == {("2", "Latitude", "bounds"), ("3", "Latitude", "number"), ("3", "kind", "choice"), ("2", "code", "pattern"), ("2", "Dine_In", "missing"), ("3", "Dine_In", "relevance"), ("5", "Dine_In", "choice")}
    assert V.form_findings(pois, constraints).where("field = 'absent' and problem = 'missing'").count() == 5
    assert V.form_findings(pois, []).count() == 0


def test_the_gate_counts_distinct_bad_ids(spark):
    good = ("http://a/e.jpg", "http://a/i.jpg", None, None)
    rows = [("1", "1010101010", "501234567", "Banks", *good), ("2", "LIC 7", "501234567", "Banks", *good), ("2", "LIC 7", "501234567", "Banks", "http://a/x.jpg", "http://a/x.jpg", None, None), ("3", None, "12", "Banks", *good), ("4", None, None, "Restaurants", None, None, None, None)]
    pois = spark.createDataFrame(rows, "GlobalID string, Commercial_License string, Phone_Number string, Category string, Exterior_Photo_URL string, Interior_Photo_URL string, Menu_Photo_URL string, Video_URL string")
    assert tuple(W.delivery_gate(pois).first()) == (5, 3, 2, 1, 40.0, False)
    assert tuple(W.delivery_gate(pois.where("GlobalID = '1'")).first()) == (1, 0, 0, 0, 100.0, True)
    assert tuple(W.delivery_gate(pois.where("false")).first()) == (0, 0, 0, 0, 0.0, False)


def test_known_names_fall_back_to_arabic(spark):
    places = spark.createDataFrame([("b", "Cafe", "م"), ("a", "Cafe", None), ("c", "", "ف"), ("d", None, "م")], "GlobalID string, Name_EN string, Name_AR string")
    rows = spark.createDataFrame([(1, "Cafe", "ف"), (2, "None", "م"), (3, "", ""), (4, None, "ف"), (5, "None", None)], "n int, Name_EN string, Name_AR string")
    assert {r.n: r.known for r in W.known_names(rows, places).collect()} == {1: "a", 2: "b", 3: None, 4: "c", 5: None}


def test_new_places_get_the_same_ids_again(spark):
    rows = spark.createDataFrame([(None, "A", None, None), ("", "B", "Reviewed", 3), ("x", "C", "", None)], "GlobalID string, Name_EN string, Review_Status string, review_version int").withColumn("draft_reason", F.lit(None).cast("string"))
    once, again = (sorted((r.Name_EN, r.GlobalID, r.Review_Status, r.draft_reason, r.review_version) for r in W.create_defaults(rows.repartition(n)).collect()) for n in (1, 3))
    assert once == again and once[2][1:] == ("x", "Draft", "new", 0) and once[0][2:] == ("Draft", "new", 0) and once[1][2:] == ("Reviewed", None, 3) and len({r[1] for r in once}) == 3
