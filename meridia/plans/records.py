"""Payloads, merges, draft statistics, pages, taxonomy, locale order and actions on places as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators import analytics as A
from ..operators import exchange as X
from ..operators import lifecycle as L
from ..operators import resolve as R
from ..operators import review as W
from ..operators import rules as V
from ..sources import readers
from .matching import FULL, GROUPS
from .registry import Register
from .reviews import FILLED, PAIRS, verdicts_of
from .views import with_views

query = Register()
QUERIES, ORACLES = query.queries, query.oracles
K = "CAST(substr(GlobalID, 4, 8) AS BIGINT)"

# a survey payload of every shape, and one that is no JSON, from an event
PAYLOAD = """CASE event_id % 5
    WHEN 0 THEN concat('{"feature": {"attributes": {"n": ', CAST(event_id AS STRING), ', "tags": {"all": [1, ', CAST(user_id AS STRING), ']}}, "geometry": {"x": 46.5, "y": 0}}}')
    WHEN 1 THEN concat('{"attributes": {"n": ', CAST(event_id AS STRING), ', "longitude": "here", "tags": {"all": [', CAST(user_id AS STRING), ', 2]}}}')
    WHEN 2 THEN concat('{"n": ', CAST(event_id AS STRING), ', "tags": {"all": [3, 4]}}')
    WHEN 3 THEN concat('{"feature": {"n": ', CAST(event_id AS STRING), ', "longitude": 1.5, "geometry": {"x": 46.5, "y": 24.5}}}')
    ELSE '{"n": ' END"""


@query("src_09_shapes", "events", sql=f"""
WITH p AS (SELECT event_id, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS p FROM (SELECT event_id, {PAYLOAD.replace("STRING", "VARCHAR")} AS p FROM events)),
a AS (SELECT event_id, p->'$.feature.geometry' AS g, coalesce(p->'$.feature.attributes', p->'$.feature', p->'$.attributes', p) AS a FROM p)
SELECT event_id, CAST(a->>'$.n' AS BIGINT) AS n, CAST(a->>'$.tags.all[1]' AS BIGINT) AS second, coalesce(a->>'$.longitude', CASE WHEN CAST(g->>'$.x' AS DOUBLE) <> 0 THEN g->>'$.x' END) AS longitude,
    CASE WHEN CAST(g->>'$.y' AS DOUBLE) <> 0 THEN g->>'$.y' END AS latitude FROM a""")
def payload_shapes(events):
    found = events.select("event_id", P.attributes(F.expr(PAYLOAD)).alias("m"))
    m = F.col("m")
    return found.select("event_id", P.member(m, "n", "long").alias("n"), P.inside(m, "tags", "$.all[1]", "long").alias("second"), P.member(m, "longitude").alias("longitude"), P.member(m, "latitude").alias("latitude"))


OLD = """concat('{"a": ', CAST(event_id AS STRING), ', "deep": {"x": [1, 2], "y": 1}, "gone": 1}')"""
NEW = """CASE event_id % 4 WHEN 0 THEN concat('{"deep": {"x": [', CAST(user_id AS STRING), ']}, "gone": null}') WHEN 1 THEN '{"b": {"c": true}}' WHEN 2 THEN '[1]' END"""


@query("lif_15", "events", sql="""
SELECT event_id, CAST(event_id AS BIGINT) AS a, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE '1' END AS x, CASE WHEN event_id % 4 <> 0 THEN 1::BIGINT END AS y,
    CASE WHEN event_id % 4 = 1 THEN TRUE END AS c, CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '1' END AS gone FROM events""")
def json_merge(events):
    """Stored data with what an import brings: its members win whole, as nested as they are."""
    m = F.parse_json(P.merged_json(F.expr(OLD), F.expr(NEW)))
    at = lambda path, kind: F.try_variant_get(m, path, kind)
    gone = F.when(F.is_variant_null(F.try_variant_get(m, "$.gone", "variant")), "null").otherwise(at("$.gone", "string"))
    return events.select("event_id", at("$.a", "long").alias("a"), at("$.deep.x[0]", "string").alias("x"), at("$.deep.y", "long").alias("y"), at("$.b.c", "boolean").alias("c"), gone.alias("gone"))


@query("srt_01_locale", "poi", sql="SELECT GlobalID, CAST(row_number() OVER (PARTITION BY Category, Subcategory ORDER BY Name_EN COLLATE en NULLS LAST, GlobalID) AS INTEGER) AS place FROM poi")
def locale_order(poi):
    """The place of each name among those of its kind, in the order of a locale: case and accents count last."""
    from pyspark.sql import Window

    order = Window.partitionBy("Category", "Subcategory").orderBy(F.collate(F.col("Name_EN"), "UNICODE").asc_nulls_last(), "GlobalID")
    return poi.select("GlobalID", F.row_number().over(order).alias("place"))


_DRAFTS = f"SELECT CASE {K} % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS Draft_Status, CASE {K} % 4 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'NEW' WHEN 2 THEN NULL ELSE '' END AS Dup_Verdict, CASE WHEN {K} % 5 = 0 THEN concat(Category, ' ', District_EN) ELSE Category END AS Category, {K} % 2 AS QA_Blockers FROM"


@query("agg_09", "poi", sql=f"""
, d AS ({_DRAFTS} poi)
SELECT 'total' AS grouping, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM d
UNION ALL SELECT 'by_status', Draft_Status, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'by_verdict', Dup_Verdict, count(*) FROM d GROUP BY 2
UNION ALL (SELECT 'by_category', CASE WHEN coalesce(Category, '') = '' THEN '(empty)' ELSE Category END AS name, count(*) AS n FROM d WHERE Draft_Status = 'pending' GROUP BY 2 ORDER BY n DESC, name LIMIT 30)
UNION ALL SELECT 'by_check', CASE WHEN QA_Blockers = 0 THEN 'qa_pass' ELSE 'qa_fail' END, count(*) FROM d WHERE Draft_Status = 'pending' GROUP BY 2""")
def draft_statistics(poi):
    return A.draft_statistics(_drafts(poi))


def _drafts(poi):
    k = F.expr(K)
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    return poi.select(
        pick(3, "pending", "confirmed", "rejected").alias("Draft_Status"), pick(4, "DUPLICATE", "NEW", None, "").alias("Dup_Verdict"),
        F.when(k % 5 == 0, F.concat("Category", F.lit(" "), "District_EN")).otherwise(F.col("Category")).alias("Category"), (k % 2).alias("QA_Blockers"),
    )


@query("agg_10", "poi", sql="SELECT GlobalID, Name_EN, (SELECT count(*) FROM poi WHERE Review_Status = 'Draft') AS total FROM poi WHERE Review_Status = 'Draft' ORDER BY Name_EN NULLS LAST, GlobalID LIMIT 50 OFFSET 50")
def second_page(poi):
    rows = A.select_places(poi, status="Draft").select("GlobalID", "Name_EN")
    return A.page_with_total(rows, [F.asc_nulls_last("Name_EN"), F.asc("GlobalID")], number_=1)


BINS = [(90, 100), (85, 90), (80, 85), (75, 80), (70, 75)]


@query("agg_19_scores", "poi", sql=FULL + ", g AS (SELECT round(final, 1) AS s FROM s9 WHERE round(final, 1) >= 70) SELECT min(s) AS least, max(s) AS greatest, round(avg(s), 1) AS mean, " + ", ".join(f"count(*) FILTER (s >= {a} AND s < {b}) AS from_{a}_to_{b}" for a, b in BINS) + " FROM g")
def distribution_of_scores(poi):
    return R.qualifying(R.score_counts(poi)).agg(*A.score_distribution(F.col("final_score"), BINS, F.col("n")))


_TAXONOMY = "SELECT DISTINCT Category AS category, CASE WHEN Category LIKE 'H%' THEN CASE {k} % 2 WHEN 0 THEN 'Fast Food' ELSE 'Clinic' END WHEN Category = 'Mosques' THEN 'Jami' END AS subcategory, CASE WHEN Category LIKE 'H%' THEN concat('L', CAST({k} % 3 AS STRING)) END AS level3 FROM {poi} WHERE coalesce(Category, '') NOT IN ('', 'Corporate')"


@query("val_e456", "poi", sql=f"""
, t AS ({_TAXONOMY.format(k=K, poi="poi").replace("STRING", "VARCHAR")}),
p AS (SELECT GlobalID, coalesce(Category, '') AS c, coalesce(Subcategory, '') AS s, 'L' || ({K} % 4) AS l FROM poi)
SELECT GlobalID, 'GATE-E4' AS rule_id, 'warning' AS severity, 'Category' AS field FROM p WHERE c <> '' AND c NOT IN (SELECT category FROM t)
UNION ALL SELECT GlobalID, 'GATE-E5', 'warning', 'Subcategory' FROM p WHERE s <> '' AND c IN (SELECT category FROM t WHERE subcategory IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM t WHERE t.category = c AND t.subcategory = s)
UNION ALL SELECT GlobalID, 'GATE-E6', 'warning', 'Category_Level_3' FROM p WHERE s <> '' AND EXISTS (SELECT 1 FROM t WHERE t.category = c AND t.subcategory = s AND level3 IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM t WHERE t.category = c AND t.subcategory = s AND t.level3 = l)""")
def taxonomy(poi):
    """Against a taxonomy made of most categories of the table."""
    k = F.expr(K)
    has = F.col("Category").startswith("H")
    table = poi.where("coalesce(Category, '') not in ('', 'Corporate')").select(
        F.col("Category").alias("category"), F.when(has, F.when(k % 2 == 0, "Fast Food").otherwise("Clinic")).when(F.col("Category") == "Mosques", "Jami").alias("subcategory"), F.when(has, F.concat(F.lit("L"), (k % 3).cast("string"))).alias("level3")
    ).distinct()
    return V.taxonomy_findings(poi.withColumn("Category_Level_3", F.concat(F.lit("L"), (k % 4).cast("string"))), table)


def _asked(poi):
    k = F.expr(K)
    known = poi.where(k % 3 == 0).select("GlobalID", F.concat(F.lit("r"), (k % 2).cast("string")).alias("reviewer"), F.when(k % 4 != 0, F.lit("bad record")).otherwise("").alias("reason"))
    return known.unionByName(poi.where(k % 50 == 0).select(F.concat(F.lit("x"), "GlobalID").alias("GlobalID"), F.lit("r").alias("reviewer"), F.lit("r").alias("reason")))


ASKED = f", q AS (SELECT GlobalID, 'r' || ({K} % 2) AS reviewer, CASE WHEN {K} % 4 <> 0 THEN 'bad record' ELSE '' END AS reason FROM poi WHERE {K} % 3 = 0)"


@query("lif_06", "poi", sql=ASKED + f"""
, j AS (SELECT poi.*, reviewer, reason, CASE WHEN Review_Status = 'Rejected' THEN 'already rejected' WHEN reason = '' THEN 'a reason is required' END AS refused FROM poi JOIN q USING (GlobalID))
SELECT GlobalID, refused, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS why FROM j WHERE refused IS NOT NULL UNION ALL SELECT 'x' || GlobalID, 'not found', NULL, NULL FROM poi WHERE {K} % 50 = 0
UNION ALL SELECT poi.GlobalID, NULL, CASE WHEN j.GlobalID IS NULL OR refused IS NOT NULL THEN poi.Review_Status ELSE 'Rejected' END, CASE WHEN j.GlobalID IS NULL OR refused IS NOT NULL THEN NULL ELSE reason END FROM poi LEFT JOIN j USING (GlobalID)""")
def rejections(poi):
    """The table after rejections, and who was refused."""
    table, _, refused = L.reject_places(poi.withColumn("rejected_reason", F.lit(None).cast("string")), _asked(poi))
    none = F.lit(None).cast("string")
    return refused.select("GlobalID", "refused", none.alias("status"), none.alias("why")).unionByName(table.select("GlobalID", none.alias("refused"), F.col("Review_Status").alias("status"), F.col("rejected_reason").alias("why")))


@query("lif_06_audit", "poi", sql=ASKED + """
, j AS (SELECT GlobalID, CASE WHEN coalesce(Name_EN, '') <> '' THEN Name_EN ELSE coalesce(Name_AR, '') END AS name, reviewer, reason, flagged FROM poi JOIN q USING (GlobalID))
SELECT GlobalID, name, reviewer, 'flag' AS action, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old, reason AS new FROM j
UNION ALL SELECT GlobalID, name, reviewer, 'flag', 'flagged', CASE WHEN flagged THEN 'True' WHEN flagged IS NULL THEN '' ELSE 'False' END, 'True' FROM j WHERE flagged IS DISTINCT FROM TRUE
UNION ALL SELECT GlobalID, name, reviewer, 'flag', 'flag_reason', '', reason FROM j WHERE reason <> '' UNION ALL SELECT GlobalID, name, reviewer, 'flag', 'Review_Flag', '', reason FROM j WHERE reason <> ''""")
def flag_audit(poi):
    """The audit log of flags, which leave the status as it is."""
    none = F.lit(None).cast("string")
    _, changes, _ = L.flag_places(poi.withColumns({"flag_reason": none, "Review_Flag": none}), _asked(poi))
    return X.audit_log(changes)


@query("lif_17", "poi", sql="SELECT GlobalID, CAST(1 AS INTEGER) AS review_version FROM poi")
def versions_reset(poi):
    return L.reset_versions(poi).select("GlobalID", "review_version")


_T = lambda c: f"trim(coalesce({c}, ''))"


@query("mth_10", "poi", sql=f"""
SELECT GlobalID, 'Latitude' AS field, CASE WHEN TRY_CAST({_T('Latitude')} AS DOUBLE) IS NULL THEN 'number' ELSE 'bounds' END AS problem FROM poi WHERE {_T('Latitude')} <> '' AND (TRY_CAST({_T('Latitude')} AS DOUBLE) IS NULL OR TRY_CAST({_T('Latitude')} AS DOUBLE) NOT BETWEEN 24 AND 25.5)
UNION ALL SELECT GlobalID, 'Longitude', CASE WHEN TRY_CAST({_T('Longitude')} AS DOUBLE) IS NULL THEN 'number' ELSE 'bounds' END FROM poi WHERE {_T('Longitude')} <> '' AND (TRY_CAST({_T('Longitude')} AS DOUBLE) IS NULL OR TRY_CAST({_T('Longitude')} AS DOUBLE) NOT BETWEEN 46 AND 47.5)
UNION ALL SELECT GlobalID, 'Dine_In', CASE WHEN {_T('Category')} IN ('Restaurants', 'Coffee Shops') THEN CASE WHEN {_T('Dine_In')} = '' THEN 'missing' WHEN {_T('Dine_In')} NOT IN ('Yes', 'No') THEN 'choice' END WHEN {_T('Dine_In')} <> '' THEN 'relevance' END AS problem FROM poi WHERE problem IS NOT NULL
UNION ALL SELECT GlobalID, 'Building_Number', 'pattern' FROM poi WHERE {_T('Building_Number')} <> '' AND NOT regexp_matches({_T('Building_Number')}, '^\\d{{4}}$')""")
def form_bounds(poi):
    """The survey form's bounds of coordinates, a pattern, and a question asked of some categories only."""
    constraints = [
        V.Constraint("Latitude", least=24, most=25.5), V.Constraint("Longitude", least=46, most=47.5), V.Constraint("Building_Number", pattern=r"\d{4}"),
        V.Constraint("Dine_In", choices=("Yes", "No"), required=True, when=("Category", ("Restaurants", "Coffee Shops"))),
    ]
    return V.form_findings(poi, constraints)


@query("agg_08", "poi", sql=PAIRS + "SELECT count(*) AS total, count(*) FILTER (verdict = 'MATCH') AS matches, count(*) FILTER (verdict = 'NOT_MATCH') AS others, count(DISTINCT reviewer) AS reviewers, count(DISTINCT (source_gid, candidate_gid)) AS pairs FROM verdicts")
def review_statistics(poi):
    return W.review_statistics(verdicts_of(poi)[0])


@query("join_04_names", "poi", sql=f"""
, r AS (SELECT GlobalID, CASE WHEN {K} % 3 = 0 THEN NULL WHEN {K} % 3 = 1 THEN Name_EN ELSE concat(Name_EN, '?') END AS en, Name_AR AS ar FROM poi WHERE {K} % 2 = 0),
e AS (SELECT Name_EN, min(GlobalID) AS id FROM poi WHERE coalesce(Name_EN, '') <> '' AND {K} % 2 = 1 GROUP BY 1), a AS (SELECT Name_AR, min(GlobalID) AS id FROM poi WHERE coalesce(Name_AR, '') <> '' AND {K} % 2 = 1 GROUP BY 1)
SELECT GlobalID, coalesce(e.id, a.id) AS known FROM r LEFT JOIN e ON e.Name_EN = r.en LEFT JOIN a ON a.Name_AR = r.ar""")
def existing_names(poi):
    """Which place a new row names, by English name, then by Arabic."""
    k = F.expr(K)
    rows = poi.where(k % 2 == 0).select("GlobalID", F.when(k % 3 == 1, F.col("Name_EN")).when(k % 3 == 2, F.concat("Name_EN", F.lit("?"))).alias("Name_EN"), "Name_AR")
    return W.known_names(rows, poi.where(k % 2 == 1)).select("GlobalID", "known")


_GROUPS = {
    "key": "GlobalID Name_AR Name_EN Category District_EN Phone_Number QA_Score Review_Status", "basic": "GlobalID Name_AR Name_EN Legal_Name Category Subcategory Company_Status Latitude Longitude Google_Map_URL District_EN Building_Number Floor_Number",
    "contact": "GlobalID Name_EN Phone_Number Email Website Social_Media Commercial_License", "hours": "GlobalID Name_EN Working_Days Working_Hours",
    "photos": "GlobalID Name_EN Exterior_Photo_URL Interior_Photo_URL Menu_Photo_URL Video_URL License_Photo_URL", "qa": "GlobalID Name_EN QA_Score Review_Status flagged review_version",
}


@query("prj_01_groups", "poi", sql="\nUNION ALL\n".join(f"SELECT GlobalID, '{g}' AS grp, concat_ws('|', {', '.join(chr(39) + c + '=' + chr(39) + f' || coalesce(CAST({c} AS VARCHAR), {chr(39) * 2})' for c in cols.split())}) AS shown FROM poi" for g, cols in _GROUPS.items()))
def shown_groups(poi):
    """Every group of columns that the table has, a line of text for each place; amenities by their number."""
    lines = []
    for g in _GROUPS:
        part = W.column_group(poi, g)
        lines.append(part.select("GlobalID", F.lit(g).alias("grp"), F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in part.columns)).alias("shown")))
    return reduce(lambda a, b: a.unionByName(b), lines)


@query("src_07", "poi", sql="SELECT GlobalID, CASE WHEN Name_EN IS NULL THEN '' ELSE Name_EN || ', \"' || GlobalID || '\"' END AS name, coalesce(Category, '') AS category, coalesce(Website, '') AS website FROM poi")
def seed_lines(poi):
    """Places written as lines of the seed dialect and read back."""
    name = F.coalesce(F.concat(F.lit('"'), "Name_EN", F.lit(', \\"'), "GlobalID", F.lit('\\""')), F.lit(""))
    line = F.concat_ws(",", "GlobalID", name, F.concat(F.lit('"'), F.coalesce("Category", F.lit("")), F.lit('"')), F.coalesce("Website", F.lit("")))
    f = readers.naive_fields(line)
    return poi.select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("GlobalID", "name", "category", "website"))))


@query("win_01", "audit", sql="""
, t AS (SELECT id * 3 + i AS id, global_id, reviewer, CASE WHEN id % 4 = 0 AND i = 2 THEN 'edit' ELSE action END AS action, created_at + i * INTERVAL 1200 MILLISECOND AS ts FROM audit, range(3) r(i)),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY ts DESC, id DESC) AS place FROM t QUALIFY place <= 200),
f AS (
    SELECT global_id, place, action, reviewer, ts, ts AS anchor, CAST(0 AS BIGINT) AS event FROM n WHERE place = 1
    UNION ALL
    SELECT global_id, place, action, reviewer, ts, CASE WHEN same THEN anchor ELSE ts END, CASE WHEN same THEN event ELSE event + 1 END FROM (
        SELECT n.global_id, n.place, n.action, n.reviewer, n.ts, f.anchor, f.event, n.action = f.action AND n.reviewer = f.reviewer AND f.anchor - n.ts < INTERVAL 2 SECOND AS same FROM f JOIN n ON n.global_id = f.global_id AND n.place = f.place + 1))
SELECT global_id, event, action, reviewer, max(ts) AS "at", count(*) AS rows FROM f GROUP BY global_id, event, action, reviewer""")
def timelines(audit):
    """Every row of the log stands for three within 2.4 seconds; a row joins an event if it is within two seconds of the event's first."""
    each = audit.select("id", "global_id", "reviewer", "action", "created_at", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    rows = each.select((F.col("id") * 3 + F.col("i")).alias("id"), "global_id", "reviewer", F.when((F.col("id") % 4 == 0) & (F.col("i") == 2), "edit").otherwise(F.col("action")).alias("action"), (F.col("created_at") + F.make_dt_interval(secs=F.col("i") * F.lit(1.2))).alias("created_at"))
    return A.timeline(rows).select("global_id", F.col("event").cast("long").alias("event"), "action", "reviewer", "at", "rows")


ORACLES["win_01"] = ORACLES["win_01"].replace("WITH ", "WITH RECURSIVE ", 1)

_URLS = lambda c: f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[,\\s]+'), lambda u: u <> '' AND NOT contains(upper(u), 'UNAVAILABLE'))"
# The view's columns, as completeness counts them.
POI_COLUMNS = (
    "GlobalID Name_EN Name_AR Legal_Name Category Subcategory Company_Status Latitude Longitude Google_Map_URL Building_Number Floor_Number Phone_Number Email Website Social_Media Working_Hours Working_Days Commercial_License "
    "Exterior_Photo_URL Interior_Photo_URL Menu_Photo_URL Video_URL License_Photo_URL District_EN Menu Dine_In Women_Prayer_Room Free_Entry WiFi QA_Score Review_Status flagged review_version created_at"
).split()
ORACLES["er_golden"] = with_views((GROUPS + f""",
m AS (SELECT DISTINCT anchor, anchor AS gid, 0 AS place FROM grouped UNION ALL SELECT anchor, member, place FROM grouped),
w AS (SELECT poi.*, coalesce(m.anchor, GlobalID) AS anchor, coalesce(m.place, 0) AS at_place, {" + ".join(f"CAST({FILLED(f'CAST({c} AS VARCHAR)')} AS INT)" for c in POI_COLUMNS)} AS filled FROM poi LEFT JOIN m ON m.gid = GlobalID),
z AS (
    SELECT anchor, count(*) AS members, arg_min(GlobalID, (-filled, at_place)) AS best, list(GlobalID ORDER BY GlobalID) AS ids,
        {", ".join(f"arg_min({c}, at_place) FILTER ({FILLED(c)}) AS f_{c}" for c in ("Phone_Number", "Website"))},
        array_to_string(list_sort(list_distinct(flatten(list({_URLS("Exterior_Photo_URL")})))), ',') AS urls
    FROM w GROUP BY anchor)
SELECT GlobalID, CASE WHEN {FILLED("Phone_Number")} THEN Phone_Number ELSE coalesce(f_Phone_Number, Phone_Number) END AS Phone_Number, CASE WHEN {FILLED("Website")} THEN Website ELSE coalesce(f_Website, Website) END AS Website,
    CASE WHEN members > 1 AND urls <> '' THEN urls ELSE Exterior_Photo_URL END AS Exterior_Photo_URL, array_to_string(list_filter(ids, lambda i: i <> best), ',') AS removed
FROM z JOIN w ON w.GlobalID = z.best AND w.anchor = z.anchor""").strip(), "poi").replace("WITH ", "WITH RECURSIVE ", 1)

_RAW = f"CASE WHEN contains(upper({_T('Phone_Number')}), 'E+') THEN coalesce(CAST(TRY_CAST(TRY_CAST({_T('Phone_Number')} AS DOUBLE) AS DECIMAL(20, 0)) AS VARCHAR), {_T('Phone_Number')}) ELSE {_T('Phone_Number')} END"
ORACLES["val_06"] = with_views(f"""
, r AS (SELECT GlobalID, Phone_Number, {_RAW} AS raw, {FILLED('Phone_Number')} AS filled FROM poi),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r),
f AS (SELECT *, CASE WHEN regexp_matches(raw, '^\\+?966') THEN '966' || ltrim(digits, '96') WHEN length(digits) IN (9, 10) THEN '966' || digits ELSE digits END AS whole FROM d)
SELECT GlobalID, CASE WHEN filled AND length(whole) BETWEEN 9 AND 12 THEN whole ELSE Phone_Number END AS phone, CASE WHEN filled AND NOT length(whole) BETWEEN 9 AND 12 THEN 'INVALID_PHONE' END AS error FROM f""".strip(), "poi")


@query("agg_14", "poi", sql=f"""
, b AS (
    SELECT GlobalID, {FILLED('Commercial_License')} AND (regexp_matches({_T('Commercial_License')}, '[a-zA-Z ]') OR length(regexp_replace(Commercial_License, '[^0-9]', '', 'g')) <> 10) AS licence,
        len(e) <> len(list_distinct(e)) OR list_has_any({_URLS('Exterior_Photo_URL')}, {_URLS('Interior_Photo_URL')}) AS media,
        {_T('Category')} = 'Restaurants' AND NOT {FILLED('Menu_Photo_URL')} AND NOT {FILLED('Video_URL')} AND NOT {FILLED('Dine_In')} AS seats
    FROM (SELECT *, {" || ".join(map(_URLS, ("Exterior_Photo_URL", "Interior_Photo_URL", "Menu_Photo_URL", "Video_URL")))} AS e FROM poi)),
p AS ({ORACLES["val_06"][ORACLES["val_06"].index("SELECT GlobalID, CASE WHEN filled"):].replace("FROM f", "FROM f2")}),
c AS (SELECT count(*) AS rows, count(DISTINCT GlobalID) FILTER (licence OR media OR seats OR error IS NOT NULL) AS bad, count(*) FILTER (licence) AS licence_errors, count(*) FILTER (media) AS media_errors FROM b JOIN p USING (GlobalID))
SELECT *, round((rows - bad) * 100.0::DOUBLE / rows, 2) AS accuracy, round((rows - bad) * 100.0::DOUBLE / rows, 2) >= 98 AND licence_errors = 0 AND media_errors = 0 AS passed FROM c""")
def gate(poi):
    """The delivery gate over the errors that its rows have."""
    return W.delivery_gate(poi)


# the checked phones, named apart from the gate's own tables
ORACLES["agg_14"] = ORACLES["agg_14"].replace(", b AS (", ", " + ORACLES["val_06"][ORACLES["val_06"].index("r AS (SELECT GlobalID, Phone_Number"):ORACLES["val_06"].index("SELECT GlobalID, CASE WHEN filled")].strip().replace("f AS (SELECT *", "f2 AS (SELECT *") + ",\nb AS (", 1)
