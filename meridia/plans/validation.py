"""Rules, scores, corrections and streams as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.values import text
from ..operators import analytics as A
from ..operators import lifecycle as L
from ..operators import rules as V
from .matching import _list, _translit, _trim
from .registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def _v(c: str) -> str:
    return _trim(c)


HAVE = {
    "GlobalID", "Name_EN", "Name_AR", "Legal_Name", "Category", "Subcategory", "Company_Status", "Latitude", "Longitude", "Google_Map_URL", "Building_Number", "Floor_Number", "Phone_Number", "Email", "Website", "Social_Media",
    "Working_Hours", "Working_Days", "Commercial_License", "Exterior_Photo_URL", "Interior_Photo_URL", "Menu_Photo_URL", "Video_URL", "License_Photo_URL", "District_EN", "Menu", "Dine_In", "Women_Prayer_Room", "Free_Entry", "WiFi", "QA_Score",
}
FOOD = f"({_v('Category')} IN ({_list(S.FOOD_CATEGORIES)}) OR regexp_matches(lower({_v('Category')}), 'food|restaurant|cafe|coffee'))"
_GIVEN = lambda c: f"({_v(c)} NOT IN ('', 'UNAVAILABLE'))"
_LETTERS = f"regexp_replace({_v('Name_EN')}, '[^\\p{{L}}]', '', 'g')"
_PAIRSET = lambda c: f"(CASE WHEN length({c}) >= 2 THEN list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) ELSE [{c}] END)"


def _set_dice(a: str, b: str) -> str:
    x, y = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return f"(CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE len(list_intersect({_PAIRSET(x)}, {_PAIRSET(y)})) * 2.0::DOUBLE / (len({_PAIRSET(x)}) + len({_PAIRSET(y)})) * 100 END)"


_BRAND = f"coalesce(list_filter(regexp_split_to_array({_v('Name_EN')}, '\\s+'), lambda w: length(w) >= 3 AND regexp_matches(substr(w, 1, 1), '\\p{{Lu}}') AND lower(w) NOT IN ({_list(S.NAME_ONLY_EN)}))[1], '')"
_NUM = lambda c: f"(CASE WHEN coalesce({c}, '') = '' THEN 0.0::DOUBLE ELSE TRY_CAST({c} AS DOUBLE) END)"
_RANGES = f"regexp_extract_all({_v('Working_Hours')}, '\\d{{1,2}}:\\d{{2}}\\s*-\\s*\\d{{1,2}}:\\d{{2}}')"
_MIN = lambda g: f"CAST(regexp_extract(r, '(\\d{{1,2}}):(\\d{{2}})\\s*-\\s*(\\d{{1,2}}):(\\d{{2}})', {g}) AS INT)"
_MAPS = f"regexp_matches({_v('Website')}, 'google\\.com/maps|goo\\.gl/maps|maps\\.google\\.com')"
_SOCIAL = "(" + " OR ".join(f"contains(lower({_v('Website')}), '{d}')" for d in S.SOCIAL_HOSTS) + ")"
_BOTH = f"lower({_v('Name_AR')} || ' ' || {_v('Name_EN')})"
AR, EN = _v("Name_AR"), _v("Name_EN")
SQL_RULES = [
    ("GATE-A1", "blocker", "Name_AR", f"length({AR}) < 2"),
    ("GATE-A2", "warning", "Name_AR", f"length({AR}) >= 2 AND regexp_matches({AR}, '[A-Za-z]')"),
    ("GATE-A3", "blocker", "Name_AR", f"length({AR}) >= 2 AND {AR} IN ({_list(S.NAME_ONLY_AR)})"),
    ("GATE-A4", "warning", "Name_AR", f"length({AR}) >= 3 AND length({EN}) >= 3 AND length(regexp_replace({AR}, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) >= length(replace({AR}, ' ', '')) * 0.7 AND {_set_dice(AR, _translit(EN))} > 70"),
    ("GATE-A5", "warning", "Name_AR", f"{AR} <> '' AND length({EN}) >= 4 AND {_BRAND} <> '' AND NOT contains({AR}, {_translit(_BRAND)}) AND NOT contains(lower({AR}), lower({_BRAND})) AND {_set_dice(AR, _translit(_BRAND))} < 30"),
    ("GATE-A6", "blocker", "Name_AR", f"{AR} <> '' AND {EN} <> '' AND regexp_matches({EN}, '(?i){S.EN_BUSINESS}') AND (" + " OR ".join(f"(contains({AR}, '{a}') AND NOT regexp_matches({EN}, '(?i){e}'))" for a, e in S.AR_BUSINESS.items()) + ")"),
    ("GATE-B1", "blocker", "Name_EN", f"length({EN}) < 2"),
    ("GATE-B2", "warning", "Name_EN", f"length({EN}) >= 2 AND regexp_matches({EN}, '[\\x{{0600}}-\\x{{06FF}}]')"),
    ("GATE-B3", "blocker", "Name_EN", f"length({EN}) >= 2 AND lower({EN}) IN ({_list(S.NAME_ONLY_EN)})"),
    ("GATE-B4", "warning", "Name_EN", f"length({_LETTERS}) >= 4 AND {_LETTERS} = upper({_LETTERS}) AND {_LETTERS} <> lower({_LETTERS})"),
    ("GATE-B5", "warning", "Name_EN", f"length({_LETTERS}) >= 4 AND {_LETTERS} = lower({_LETTERS}) AND {_LETTERS} <> upper({_LETTERS})"),
    ("GATE-C1", "warning", "Legal_Name", f"length({_v('Legal_Name')}) < 3"),
    ("GATE-D1", "blocker", "Exterior_Photo_URL", f"NOT {_GIVEN('Exterior_Photo_URL')}"),
    ("GATE-D2", "blocker", "Interior_Photo_URL", f"NOT {_GIVEN('Interior_Photo_URL')}"),
    ("GATE-D3", "blocker", "Interior_Photo_URL", f"{_v('Exterior_Photo_URL')} <> '' AND {_v('Exterior_Photo_URL')} = {_v('Interior_Photo_URL')}"),
    ("GATE-D4", "warning", "Video_URL", f"{_GIVEN('Video_URL')} AND {_v('Video_URL')} <> 'UNAPPLICABLE' AND NOT regexp_matches({_v('Video_URL')}, '(?i)\\.(mp4|mov)$') AND NOT regexp_matches({_v('Video_URL')}, 'youtube|youtu\\.be')"),
    ("GATE-E1", "blocker", "Category", f"{_v('Category')} = ''"),
    ("GATE-E2", "warning", "Category", f"regexp_matches({_BOTH}, 'صيدلية|pharmacy') AND {_v('Category')} <> '' AND NOT regexp_matches(lower({_v('Category')}), 'health|clinic|pharma')"),
    ("GATE-E3", "warning", "Category", f"regexp_matches({_BOTH}, 'مطعم|restaurant') AND {_v('Category')} <> '' AND NOT {FOOD}"),
    ("GATE-F1", "warning", "Company_Status", f"{_v('Company_Status')} NOT IN ('', 'Open', 'Temporarily Closed', 'Permanently Closed', 'Closed')"),
    ("GATE-G1", "blocker", "Latitude", f"{_NUM('Latitude')} IS NOT NULL AND {_NUM('Longitude')} IS NOT NULL AND NOT {_NUM('Latitude')} BETWEEN 15 AND 35"),
    ("GATE-G2", "blocker", "Longitude", f"{_NUM('Latitude')} IS NOT NULL AND {_NUM('Longitude')} IS NOT NULL AND NOT {_NUM('Longitude')} BETWEEN 35 AND 60"),
    ("GATE-G3", "blocker", "Latitude", f"{_NUM('Latitude')} IS NULL OR {_NUM('Longitude')} IS NULL"),
    ("GATE-G4", "warning", "District_EN", f"{_v('District_EN')} = ''"),
    ("GATE-H1", "warning", "Building_Number", f"{_GIVEN('Building_Number')} AND NOT regexp_matches({_v('Building_Number')}, '^\\d{{4}}$')"),
    ("GATE-H2", "warning", "Floor_Number", f"{_v('Floor_Number')} NOT IN ('G', 'B1', '1', '2', '3', '4', '5', 'UNAVAILABLE', '')"),
    ("GATE-I1", "warning", "Phone_Number", f"{_GIVEN('Phone_Number')} AND regexp_matches({_v('Phone_Number')}, '[eE]\\+')"),
    ("GATE-I2", "warning", "Phone_Number", f"{_GIVEN('Phone_Number')} AND NOT regexp_matches({_v('Phone_Number')}, '[eE]\\+') AND NOT regexp_matches(replace(replace({_v('Phone_Number')}, ' ', ''), '-', ''), '{S.SAUDI_PHONE}')"),
    ("GATE-I3", "warning", "Email", f"{_GIVEN('Email')} AND NOT regexp_matches({_v('Email')}, '^[^@]+@[^@]+\\.[^@]+$')"),
    ("GATE-I4", "warning", "Website", _MAPS),
    ("GATE-I4b", "warning", "Website", f"{_GIVEN('Website')} AND NOT {_MAPS} AND {_SOCIAL}"),
    ("GATE-I5", "warning", "Social_Media", f"{_GIVEN('Social_Media')} AND (contains({_v('Social_Media')}, 'wa.me') OR contains(lower({_v('Social_Media')}), 'whatsapp'))"),
    ("GATE-I6", "warning", "Social_Media", f"{_GIVEN('Social_Media')} AND regexp_matches(replace({_v('Social_Media')}, ' ', ''), '^\\+?\\d{{10,}}$')"),
    ("GATE-J1", "blocker", "Working_Hours", f"{_v('Working_Hours')} = ''"),
    ("GATE-J2", "warning", "Working_Hours", f"{_GIVEN('Working_Hours')} AND {_v('Working_Hours')} <> 'Open 24 Hours' AND len({_RANGES}) = 0"),
    ("GATE-J3", "warning", "Working_Hours", f"{_GIVEN('Working_Hours')} AND len(list_filter({_RANGES}, lambda r: {_MIN(1)} * 60 + {_MIN(2)} - {_MIN(3)} * 60 - {_MIN(4)} > 180)) > 0"),
    *(("GATE-K1", "warning", f, f"{_v(f)} NOT IN ('', 'Yes', 'No', 'UNAVAILABLE', 'UNAPPLICABLE')") for f in S.AMENITIES if f in HAVE),
    ("GATE-L1", "warning", "Commercial_License", f"{_GIVEN('Commercial_License')} AND NOT regexp_matches({_v('Commercial_License')}, '^\\d{{10}}$')"),
]


def _sql_of(*letters: str) -> str:
    chosen = [r for r in SQL_RULES if r[0].removeprefix("GATE-")[0] in letters]
    return "\nUNION ALL\n".join(f"SELECT GlobalID, '{i}' AS rule_id, '{s}' AS severity, '{f}' AS field FROM poi WHERE {c}" for i, s, f, c in chosen)


def _group(letter: str):
    @query(f"val_{letter.lower()}", "poi", sql=_sql_of(letter))
    def one(poi, letter=letter):
        return V.local_findings(poi, f"GATE-{letter}")


for _letter in "ABCEFGHIJKL":
    _group(_letter)


@query("val_media", "poi", sql=_sql_of("D"))
def media_rules(poi):
    return V.local_findings(poi, "GATE-D")


@query("val_sentinel", "poi", sql="\nUNION ALL\n".join(f"SELECT GlobalID, '{f}' AS field FROM poi WHERE lower({_trim(f)}) IN ({_list(S.SENTINELS_VALIDATION)})" for f in S.SENTINEL_FIELDS if f in HAVE))
def placeholders(poi):
    return V.placeholder_findings(poi).select("GlobalID", "field")


_MEDIA = ["Exterior_Photo_URL", "Interior_Photo_URL", "Menu_Photo_URL", "Video_URL", "License_Photo_URL"]
_FIXED = {
    "Interior_Photo_URL": f"CASE WHEN {_v('Exterior_Photo_URL')} <> '' AND {_v('Exterior_Photo_URL')} = {_v('Interior_Photo_URL')} THEN 'UNAVAILABLE' ELSE Interior_Photo_URL END",
    "Menu_Photo_URL": f"CASE WHEN NOT {FOOD} AND {_v('Menu_Photo_URL')} <> 'UNAVAILABLE' THEN 'UNAPPLICABLE' ELSE Menu_Photo_URL END",
    "Video_URL": f"CASE WHEN {_GIVEN('Video_URL')} AND {_v('Video_URL')} <> 'UNAPPLICABLE' AND NOT regexp_matches({_v('Video_URL')}, '(?i)\\.(mp4|mov)$') AND NOT regexp_matches({_v('Video_URL')}, 'youtube|youtu\\.be') THEN 'UNAVAILABLE' ELSE Video_URL END",
}
_AGAIN = lambda i: f"(trim(coalesce(m{i}, '')) NOT IN ('', 'UNAVAILABLE', 'UNAPPLICABLE') AND (" + " OR ".join(f"trim(coalesce(m{j}, '')) = trim(coalesce(m{i}, ''))" for j in range(i)) + "))"
_DUP_HIT = lambda i: f"trim(coalesce({_MEDIA[i]}, '')) NOT IN ('', 'UNAVAILABLE', 'UNAPPLICABLE') AND trim(coalesce(n{i}, '')) = 'UNAVAILABLE' AND (" + " OR ".join(f"trim(coalesce(n{j}, '')) = trim(coalesce({_MEDIA[i]}, ''))" for j in range(i)) + ")"
SQL_DUP = f"""
, m0 AS (SELECT *, {', '.join(f"{_FIXED.get(f, f)} AS m{i}" for i, f in enumerate(_MEDIA))} FROM poi),
m1 AS (SELECT *, m0 AS n0, {', '.join(f"CASE WHEN {_AGAIN(i)} THEN 'UNAVAILABLE' ELSE m{i} END AS n{i}" for i in range(1, 5))} FROM m0),
dup AS ({" UNION ALL ".join(f"SELECT GlobalID, '{_MEDIA[i]}' AS field FROM m1 WHERE {_DUP_HIT(i)}" for i in range(1, 5))})"""
SQL_SENTINEL = " UNION ALL ".join(f"SELECT GlobalID FROM poi WHERE lower({_trim(f)}) IN ({_list(S.SENTINELS_VALIDATION)})" for f in S.SENTINEL_FIELDS if f in HAVE)
# media that other places use, each use of a place one warning
SQL_FOUND = SQL_DUP + f""",
u AS ({" UNION ALL ".join(f"SELECT GlobalID, trim({f}) AS url FROM poi WHERE trim({f}) LIKE 'http%'" for f in ("Exterior_Photo_URL", "Interior_Photo_URL", "Video_URL"))}),
w AS (SELECT url FROM u GROUP BY url HAVING count(DISTINCT GlobalID) > 1),
f AS (SELECT GlobalID, severity, FALSE AS cross_place FROM ({_sql_of(*"ABCDEFGHIJKL")}) UNION ALL SELECT GlobalID, 'warning', FALSE FROM ({SQL_SENTINEL}) UNION ALL SELECT GlobalID, 'warning', FALSE FROM dup UNION ALL SELECT GlobalID, 'warning', TRUE FROM u SEMI JOIN w USING (url)),
c AS (SELECT GlobalID, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'warning' AND NOT cross_place) AS own FROM f GROUP BY GlobalID),
s AS (SELECT GlobalID, coalesce(blockers, 0) AS blockers, coalesce(warnings, 0) AS warnings, coalesce(own, 0) AS own FROM poi LEFT JOIN c USING (GlobalID))"""


@query("val_dup", "poi", sql=SQL_DUP + " SELECT GlobalID, field FROM dup")
def repeated_media(poi):
    return V.media_findings(poi).select("GlobalID", "field")


@query("val_status", "poi", sql=SQL_FOUND + " SELECT GlobalID, blockers, own AS warnings, CASE WHEN blockers > 0 THEN 'FAIL_BLOCKER' WHEN own > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM s")
def statuses(poi):
    return V.status(poi)


@query("val_16", "poi", sql=SQL_FOUND + " SELECT count(*) AS total, count(*) FILTER (blockers + warnings > 0) AS with_issues, CAST(sum(blockers) AS BIGINT) AS blockers, CAST(sum(warnings) AS BIGINT) AS warnings, count(*) FILTER (blockers > 0) AS flagged FROM s")
def validate_all(poi):
    done = V.validate_table(poi)
    return poi.sparkSession.createDataFrame([{k: done.totals[k] for k in ("total", "with_issues", "blockers", "warnings", "flagged")}], "total long, with_issues long, blockers long, warnings long, flagged long")


@query("val_16_issues", "poi", sql=SQL_FOUND + " SELECT GlobalID, blockers, warnings, CASE WHEN blockers > 0 THEN 'FAIL_BLOCKER' WHEN own > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM s WHERE blockers + warnings > 0 ORDER BY GlobalID LIMIT 500")
def issue_list(poi):
    return V.validate_table(poi).issues().select("GlobalID", "blockers", "warnings", "status")


_TITLE = "array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query("val_fix", "poi", sql=f"""
SELECT GlobalID, CASE WHEN lower({EN}) IN ({_list(S.SENTINELS_VALIDATION)}) THEN 'UNAVAILABLE' WHEN length({_LETTERS}) >= 4 AND {_LETTERS} IN (upper({_LETTERS}), lower({_LETTERS})) THEN {_TITLE.format(c=EN)} ELSE Name_EN END AS Name_EN,
    CASE WHEN length({_v('Legal_Name')}) < 3 THEN 'UNAVAILABLE' ELSE Legal_Name END AS Legal_Name, CASE WHEN Company_Status = 'Closed' THEN 'Permanently Closed' ELSE Company_Status END AS Company_Status,
    CASE WHEN Floor_Number NOT IN ('G', 'B1', '1', '2', '3', '4', '5', 'UNAVAILABLE', '') THEN 'UNAVAILABLE' ELSE Floor_Number END AS Floor_Number,
    CASE WHEN {_MAPS} AND coalesce(Google_Map_URL, '') = '' THEN {_v('Website')} ELSE Google_Map_URL END AS Google_Map_URL, CASE WHEN {_MAPS} OR ({_GIVEN('Website')} AND {_SOCIAL}) THEN 'UNAVAILABLE' ELSE Website END AS Website,
    CASE WHEN NOT {FOOD} AND {_v('Dine_In')} NOT IN ('', 'UNAPPLICABLE') THEN 'UNAPPLICABLE' WHEN {_v('Dine_In')} NOT IN ('', 'Yes', 'No', 'UNAVAILABLE', 'UNAPPLICABLE') THEN 'UNAVAILABLE' ELSE Dine_In END AS Dine_In,
    CASE WHEN {_v('WiFi')} NOT IN ('', 'Yes', 'No', 'UNAVAILABLE', 'UNAPPLICABLE') THEN 'UNAVAILABLE' ELSE WiFi END AS WiFi FROM poi""")
def corrected(poi):
    return V.corrections(V.with_fields(poi)).select("GlobalID", "Name_EN", "Legal_Name", "Company_Status", "Floor_Number", "Google_Map_URL", "Website", "Dine_In", "WiFi")


_BLOCKED = SQL_FOUND + f""",
o AS (SELECT GlobalID, rule_id, row_number() OVER (PARTITION BY GlobalID ORDER BY array_position([{", ".join(f"'{r}'" for r in ("GATE-A1", "GATE-A3", "GATE-B1", "GATE-B3", "GATE-A6", "GATE-D1", "GATE-D2", "GATE-D3", "GATE-E1", "GATE-G1", "GATE-G2", "GATE-G3", "GATE-J1"))}], rule_id)) AS pos FROM ({_sql_of(*"ABCDEFGHIJKL")}) WHERE severity = 'blocker'),
t AS (SELECT GlobalID, string_agg(rule_id, '; ' ORDER BY pos) FILTER (pos <= 3) AS ids FROM o GROUP BY GlobalID),
flags AS (SELECT GlobalID, CASE WHEN blockers > 0 THEN TRUE ELSE flagged END AS flagged, CASE WHEN blockers > 0 THEN 'Auto-validation: ' || blockers || ' blocker(s) - ' || ids END AS flag_reason FROM poi JOIN s USING (GlobalID) LEFT JOIN t USING (GlobalID)),
fixed AS ({ORACLES["val_fix"][ORACLES["val_fix"].index("SELECT GlobalID, CASE WHEN lower("):]})"""


@query("val_16_table", "poi", sql=_BLOCKED + " SELECT fixed.*, n1 AS Interior_Photo_URL, n2 AS Menu_Photo_URL, n3 AS Video_URL, flags.flagged, flag_reason FROM fixed JOIN flags USING (GlobalID) JOIN m1 USING (GlobalID)")
def applied(poi):
    """The table after fixes and flags."""
    names = ("GlobalID", "Name_EN", "Legal_Name", "Company_Status", "Floor_Number", "Google_Map_URL", "Website", "Dine_In", "WiFi", "Interior_Photo_URL", "Menu_Photo_URL", "Video_URL", "flagged", "flag_reason")
    return V.validate_table(poi).table(apply_fixes=True, flag_violations=True).select(*names)


@query("str_20", "poi", sql=f"SELECT GlobalID, CASE lower({_trim('WiFi')}) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE WiFi END AS wifi, CASE lower({_trim('Dine_In')}) WHEN 'y' THEN 'Yes' WHEN 'yes' THEN 'Yes' ELSE Dine_In END AS dine_in FROM poi")
def word_booleans(poi):
    return poi.select("GlobalID", X.yes_no(F.col("WiFi")).alias("wifi"), X.yes_no(F.col("Dine_In")).alias("dine_in"))


@query("val_05", "poi", sql=f"""
SELECT GlobalID, CAST((length(trim(coalesce(Name_AR, ''))) < 2)::INT + (length(trim(coalesce(Name_EN, ''))) < 2)::INT + (coalesce(Category, '') = '')::INT + CASE WHEN TRY_CAST(Latitude AS DOUBLE) IS NULL OR TRY_CAST(Longitude AS DOUBLE) IS NULL THEN 1
    ELSE (NOT TRY_CAST(Latitude AS DOUBLE) BETWEEN 15 AND 35)::INT + (NOT TRY_CAST(Longitude AS DOUBLE) BETWEEN 35 AND 60)::INT END AS INT) AS QA_Blockers, CAST((coalesce(Phone_Number, '') = '')::INT + (coalesce(Website, '') = '')::INT AS INT) AS QA_Warnings FROM poi""")
def draft_checks(poi):
    return L.quick_check(poi).select("GlobalID", "QA_Blockers", "QA_Warnings")


@query("val_06", "poi")
def batch_phones(poi):
    value, error = X.fix_phone(F.col("Phone_Number"))
    return poi.select("GlobalID", value.alias("phone"), error.alias("error"))


_PARTS = f"list_filter(list_transform(regexp_split_to_array({_v('Working_Hours')}, '[;,]'), lambda x: regexp_extract(x, '\\d{{1,2}}:\\d{{2}}\\s*-\\s*\\d{{1,2}}:\\d{{2}}')), lambda x: x <> '')"


@query("val_13", "poi", sql=f"SELECT GlobalID, len(list_filter({_PARTS}, lambda r: {_MIN(3)} * 60 + {_MIN(4)} > 0 AND {_MIN(1)} * 60 + {_MIN(2)} > {_MIN(3)} * 60 + {_MIN(4)})) > 0 AS late FROM poi")
def batch_hours(poi):
    """Some part of the hours, told apart by ; or , has a first range that opens after it closes; midnight is no end."""
    at = lambda x, g: F.regexp_extract(x, r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})", g).try_cast("int")
    minutes = lambda x, g: at(x, g) * 60 + at(x, g + 1)
    late = F.exists(F.split(text(F.col("Working_Hours")), "[;,]"), lambda x: F.coalesce((minutes(x, 3) > 0) & (minutes(x, 1) > minutes(x, 3)), F.lit(False)))
    return poi.select("GlobalID", late.alias("late"))


@query("val_15", "poi", sql="""
SELECT GlobalID, array_to_string(list_filter([CASE WHEN Review_Status IN ('Rejected', 'Archived') THEN 'status:' || Review_Status END, CASE WHEN coalesce(Name_EN, '') IN ('', 'UNAVAILABLE') THEN 'missing:Name_EN' END, CASE WHEN coalesce(Category, '') IN ('', 'UNAVAILABLE') THEN 'missing:Category' END,
    CASE WHEN coalesce(Latitude, '') IN ('', 'UNAVAILABLE') THEN 'missing:Latitude' END, CASE WHEN coalesce(Longitude, '') IN ('', 'UNAVAILABLE') THEN 'missing:Longitude' END,
    CASE WHEN TRY_CAST(Latitude AS DOUBLE) IS NULL OR TRY_CAST(Longitude AS DOUBLE) IS NULL THEN 'coordinates:invalid' WHEN TRY_CAST(Latitude AS DOUBLE) = 0 AND TRY_CAST(Longitude AS DOUBLE) = 0 THEN 'coordinates:zero' END,
    CASE WHEN flagged THEN 'flagged' END, CASE WHEN TRY_CAST(QA_Score AS INT) < 95 THEN 'qa_score' END], lambda x: x IS NOT NULL), ',') AS reasons FROM poi""")
def approvals(poi):
    return V.approval_blockers(poi).select("GlobalID", F.array_join("reasons", ",").alias("reasons"))


UPDATED = "k % 10 = 3"


@query("lif_03", "poi", sql="""
, u AS (SELECT GlobalID, CAST(substr(GlobalID, 4, 8) AS BIGINT) AS k, Review_Status AS s, review_version AS v FROM poi),
j AS (SELECT *, CAST(k % 2 AS INT) AS sent, CASE WHEN k % 4 = 0 THEN 'Reviewed' END AS target FROM u WHERE k % 3 = 0)
SELECT GlobalID, CASE WHEN sent <> v THEN 'version' WHEN target IS NOT NULL AND NOT coalesce(s, '') IN ('Draft', '') THEN 'transition' ELSE 'applied' END AS outcome FROM j""")
def versioned_updates(poi):
    k = F.substring("GlobalID", 4, 8).cast("long")
    updates = poi.where(k % 3 == 0).select("GlobalID", (k % 2).cast("int").alias("review_version"), F.lit("r1").alias("reviewer"), F.when(k % 4 == 0, F.lit("Reviewed")).alias("Review_Status"), F.lit("Office").alias("Subcategory"))
    base = poi.withColumn("draft_reason", F.lit(None).cast("string"))
    _, audit, conflicts = L.apply_updates(base, updates)
    return conflicts.select("GlobalID", F.col("conflict").alias("outcome")).unionByName(audit.select("GlobalID", F.lit("applied").alias("outcome")).distinct())


@query("er_18", "labels", sql="SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM labels")
def label_upsert(labels):
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    new = rows.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return L.upsert(rows, new, ["doc_id"])


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Runs a stream over the events to its end in the shared folder and reads what it wrote."""
    from ..streaming import events as E
    from ..sources.shared import shared_folder

    path = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    made = make(E.read_events(spark, sf_dir, schema, glob="events.parquet"))
    E.run_to_end(made, f"{path}/out", f"{path}/state", "update")
    return spark.read.schema(made.schema.add("batch", "long")).parquet(f"{path}/out")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and type; of updated windows the last state."""
    from ..streaming import events as E

    rows = _streamed(spark, sf_dir, E.windowed_counts)
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").cast("long").alias("n"))


QUERIES |= {"stm_04": stream_windows}
ORACLES |= {
    "stm_04": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
