"""Filters, projections, joins, aggregates, windows, sorts and set operations as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import is_blank
from ..operators import analytics as A
from ..operators import lifecycle as L
from ..sources import readers, sinks
from .registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles
AS_OF_SQL = "TIMESTAMP '2024-01-20 00:00:00'"


def as_of():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


STATUS = "CASE WHEN coalesce(Review_Status, '') = '' THEN 'Draft' ELSE Review_Status END"


@query("src_01", "poi", sql="SELECT * FROM poi")
def table_scan(poi):
    return poi


@query("src_02", "poi", sql="SELECT GlobalID, coalesce(Name_EN, '') AS Name_EN, coalesce(Legal_Name, '') AS Legal_Name, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM poi WHERE GlobalID = '{C-00000053}'")
def point_lookup(poi):
    return poi.where(F.col("GlobalID") == "{C-00000053}").select("GlobalID", F.coalesce("Name_EN", F.lit("")).alias("Name_EN"), F.coalesce("Legal_Name", F.lit("")).alias("Legal_Name"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))


@query("src_09", "events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(events):
    return events.select("event_id", F.element_at(readers.payload_attributes(F.col("props")), "k").cast("long").alias("k"))


@query("snk_04", "poi", sql="SELECT GlobalID, coalesce(Name_EN, '') AS Name_EN FROM poi")
def json_round_trip(poi):
    made = sinks.json_rows(poi.select("GlobalID", "Name_EN", "created_at"))
    return made.select(F.get_json_object("json", "$.GlobalID").alias("GlobalID"), F.get_json_object("json", "$.Name_EN").alias("Name_EN"))


@query("flt_01", "poi", sql="SELECT GlobalID FROM poi WHERE Review_Status = 'Reviewed' AND Category = 'Hospitals'")
def equality(poi):
    return A.select_places(poi, status="Reviewed", category="Hospitals").select("GlobalID")


@query("flt_02", "poi", sql="SELECT GlobalID, TRUE AS flagged FROM poi WHERE flagged UNION ALL SELECT GlobalID, FALSE FROM poi WHERE NOT coalesce(flagged, FALSE)")
def tri_state(poi):
    part = lambda f: A.select_places(poi, flagged=f).select("GlobalID", F.lit(f).alias("flagged"))
    return part(True).unionByName(part(False))


@query("flt_03", "poi", sql="SELECT GlobalID, Name_EN FROM poi WHERE GlobalID IN ('{C-00000001}', '{C-00000002}', '{C-00000097}')")
def in_list(poi):
    return A.select_places(poi, ids=["{C-00000001}", " {C-00000002} ", "", "{C-00000097}"]).select("GlobalID", "Name_EN")


@query("flt_04", "poi", sql="SELECT GlobalID FROM poi WHERE Name_EN ILIKE '%noor%h%' OR Name_AR ILIKE '%noor%h%' OR GlobalID ILIKE '%noor%h%'")
def search(poi):
    return A.select_places(poi, search="noor%h").select("GlobalID")


@query("flt_05", "poi", sql="SELECT GlobalID FROM poi WHERE Review_Status = 'Draft' AND NOT coalesce(flagged, FALSE) AND (Name_EN ILIKE '%reem%' OR Name_AR ILIKE '%reem%' OR GlobalID ILIKE '%reem%')")
def conjunction(poi):
    return A.select_places(poi, status="Draft", flagged=False, search="reem").select("GlobalID")


@query("flt_06", "poi", sql="SELECT GlobalID FROM poi WHERE coalesce(Category, '') = ''")
def empty_category(poi):
    return A.select_places(poi, category="__empty__").select("GlobalID")


@query("flt_08", "audit", sql=f"SELECT id FROM audit WHERE created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR")
def recent(audit):
    return audit.where(F.col("created_at") >= as_of() - F.expr("INTERVAL 24 HOURS")).select("id")


@query("flt_13", "poi", sql="SELECT GlobalID FROM poi WHERE coalesce(TRY_CAST(Latitude AS DOUBLE), 0) <> 0 AND coalesce(TRY_CAST(Longitude AS DOUBLE), 0) <> 0")
def mappable(poi):
    n = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return poi.where((n("Latitude") != 0) & (n("Longitude") != 0)).select("GlobalID")


DECISION = "CASE WHEN Review_Status = 'Rejected' THEN 'Rejected' WHEN Review_Status = 'Archived' THEN 'Archived' WHEN flagged THEN 'Flagged' WHEN Review_Status IN ('Reviewed', 'Approved') THEN 'Reviewed' ELSE 'Draft' END"


@query("prj_02", "poi", sql=f"SELECT GlobalID, {DECISION} AS decision FROM poi")
def decisions(poi):
    return poi.select("GlobalID", A.decision(poi).alias("decision"))


@query("prj_07", "poi", sql="SELECT lower(translate(GlobalID, '{}', '')) AS gid FROM poi")
def bare_ids(poi):
    return poi.select(F.lower(F.translate("GlobalID", "{}", "")).alias("gid"))


@query("prj_10", "poi", sql="SELECT GlobalID, CASE WHEN coalesce(Google_Map_URL, '') = '' AND coalesce(Latitude, '') <> '' AND coalesce(Longitude, '') <> '' THEN 'https://www.google.com/maps?q=' || Latitude || ',' || Longitude ELSE Google_Map_URL END AS url FROM poi")
def map_url(poi):
    here = ~is_blank(F.col("Latitude")) & ~is_blank(F.col("Longitude"))
    made = F.concat(F.lit("https://www.google.com/maps?q="), "Latitude", F.lit(","), "Longitude")
    return poi.select("GlobalID", F.when(is_blank(F.col("Google_Map_URL")) & here, made).otherwise(F.col("Google_Map_URL")).alias("url"))


@query("join_03", "poi", sql="""
, urls AS (
    SELECT GlobalID, coalesce(Name_EN, '') AS name, 0 AS pos, 'Exterior_Photo_URL' AS field, coalesce(Exterior_Photo_URL, '') AS url FROM poi UNION ALL
    SELECT GlobalID, coalesce(Name_EN, ''), 1, 'Interior_Photo_URL', coalesce(Interior_Photo_URL, '') FROM poi UNION ALL
    SELECT GlobalID, coalesce(Name_EN, ''), 2, 'Video_URL', coalesce(Video_URL, '') FROM poi),
j AS (SELECT u.GlobalID, u.field, u.url, o.name, row_number() OVER (PARTITION BY u.GlobalID, u.field ORDER BY o.GlobalID, o.pos) AS r FROM urls u JOIN urls o ON u.url = o.url AND u.GlobalID <> o.GlobalID WHERE u.url LIKE 'http%')
SELECT GlobalID, field, url, count(*) AS others, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS names FROM j GROUP BY 1, 2, 3""")
def media_owners(poi):
    from ..operators.rules import shared_media

    return shared_media(poi)


@query("join_04", "supplier", "customer", sql="SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE replace(c_name, 'Customer', 'Supplier') = s_name)")
def name_exists(supplier, customer):
    names = customer.select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    return supplier.join(names, supplier.s_name == names.name, "left_semi").select("s_suppkey")


@query("join_11", "orders", sql="""
WITH u AS (SELECT o_orderkey AS k, CAST(o_orderkey % 4 AS INT) AS v FROM orders WHERE o_orderkey % 10 = 3), b AS (SELECT o_orderkey AS k, CAST(o_orderkey % 3 AS INT) AS v FROM orders)
SELECT CAST(u.k AS VARCHAR) AS GlobalID, CASE WHEN u.v = b.v THEN 'applied' ELSE 'version' END AS outcome FROM u JOIN b USING (k)""")
def version_guard(orders):
    base = orders.select(F.col("o_orderkey").cast("string").alias("GlobalID"), F.lit("Draft").alias("Review_Status"), F.lit("x").alias("Name_EN"), (F.col("o_orderkey") % 3).cast("int").alias("review_version"))
    updates = orders.where("o_orderkey % 10 = 3").select(F.col("o_orderkey").cast("string").alias("GlobalID"), (F.col("o_orderkey") % 4).cast("int").alias("review_version"), F.lit("r").alias("reviewer"), F.lit("y").alias("Name_EN"))
    _, audit, conflicts = L.apply_updates(base, updates)
    return conflicts.select("GlobalID", F.col("conflict").alias("outcome")).unionByName(audit.select("GlobalID", F.lit("applied").alias("outcome")))


@query("agg_01", "poi", sql=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {STATUS} = 'Draft') AS draft, count(*) FILTER (WHERE Review_Status = 'Reviewed') AS reviewed, count(*) FILTER (WHERE Review_Status = 'Archived') AS archived,
    count(*) FILTER (WHERE Review_Status = 'Rejected') AS rejected, count(*) FILTER (WHERE flagged) AS flagged, coalesce(round(avg(TRY_CAST(QA_Score AS DOUBLE)), 1), 0.0) AS avg_qa FROM poi""")
def statistics(poi):
    return A.status_statistics(poi)


@query("agg_02", "poi", sql=f"""
SELECT count(*) FILTER (WHERE {STATUS} = 'Draft') AS drafts, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE Review_Status = 'Reviewed') AS reviewed, count(*) FILTER (WHERE Review_Status = 'Rejected') AS rejected,
    count(*) FILTER (WHERE Review_Status = 'Archived') AS archived, count(*) FILTER (WHERE created_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS recent,
    count(*) FILTER (WHERE coalesce(Exterior_Photo_URL, '') IN ('', 'UNAVAILABLE') OR coalesce(Interior_Photo_URL, '') IN ('', 'UNAVAILABLE')) AS needs_media FROM poi""")
def queues(poi):
    return A.queue_summary(poi, as_of())


@query("agg_03", "poi", sql=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE Review_Status = 'Reviewed') AS reviewed, count(*) FILTER (WHERE {STATUS} = 'Draft') AS draft, count(*) FILTER (WHERE flagged) AS flagged,
    count(*) FILTER (WHERE coalesce(Exterior_Photo_URL, '') IN ('', 'UNAVAILABLE') AND coalesce(Interior_Photo_URL, '') IN ('', 'UNAVAILABLE')) AS missing_media FROM poi""")
def delivery_readiness(poi):
    return A.readiness(poi)


@query("agg_04", "poi", sql=f"""
SELECT 'category' AS kind, CASE WHEN coalesce(Category, '') = '' THEN 'Uncategorized' ELSE Category END AS name, count(*) AS total, count(*) FILTER (WHERE Review_Status = 'Reviewed') AS reviewed, count(*) FILTER (WHERE {STATUS} = 'Draft') AS draft FROM poi GROUP BY 1, 2
UNION ALL
SELECT 'district', CASE WHEN coalesce(District_EN, '') = '' THEN 'Unknown' ELSE District_EN END, count(*), count(*) FILTER (WHERE Review_Status = 'Reviewed'), count(*) FILTER (WHERE {STATUS} = 'Draft') FROM poi GROUP BY 1, 2""")
def breakdowns(poi):
    return A.breakdown(poi, "Category", "Uncategorized").withColumn("kind", F.lit("category")).unionByName(A.breakdown(poi, "District_EN", "Unknown").withColumn("kind", F.lit("district")))


@query("agg_05", "audit", sql="""
SELECT reviewer, count(*) AS actions, count(*) FILTER (WHERE action = 'approve' OR (action = 'status_change' AND new_value = 'Reviewed')) AS approvals, count(*) FILTER (WHERE action = 'reject') AS rejections,
    count(*) FILTER (WHERE action = 'edit') AS edits, count(DISTINCT global_id) AS places, min(created_at) AS first_at, max(created_at) AS last_at, count(DISTINCT CAST(created_at AS DATE)) AS days FROM audit GROUP BY reviewer""")
def productivity(audit):
    return A.reviewer_productivity(audit)


@query("agg_06", "audit", sql=f"SELECT CAST(created_at AS DATE) AS day, reviewer, count(*) AS actions FROM audit WHERE created_at >= {AS_OF_SQL} - INTERVAL 14 DAY GROUP BY 1, 2")
def daily(audit):
    return A.daily_actions(audit, as_of())


@query("agg_07", "audit", sql="SELECT reviewer, count(DISTINCT global_id) AS places, count(*) AS actions, max(created_at) AS last_at FROM audit GROUP BY reviewer")
def audit_statistics(audit):
    return audit.groupBy("reviewer").agg(A.long(F.countDistinct("global_id"), "places"), A.long(F.count("*"), "actions"), F.max("created_at").alias("last_at"))


@query("agg_12", "poi", sql="SELECT regexp_replace(Commercial_License, '[^0-9]', '', 'g') AS value, count(*) AS n FROM poi WHERE length(regexp_replace(Commercial_License, '[^0-9]', '', 'g')) >= 8 GROUP BY 1 HAVING count(*) > 1")
def licence_duplicates(poi):
    digits = poi.select(F.regexp_replace("Commercial_License", r"\D", "").alias("digits")).where(F.length("digits") >= 8)
    return A.repeated(digits, "digits")


DISTRICT_AR = "CASE WHEN District_EN = '' THEN NULL ELSE concat('حي ', District_EN) END"
_WITH_DISTRICT = f", p AS (SELECT *, {DISTRICT_AR} AS District_AR FROM poi)"
# Fields that must be given.
CRITICAL = ["GlobalID", "Name_AR", "Name_EN", "Category", "Subcategory", "Latitude", "Longitude", "Phone_Number", "District_AR", "District_EN", "Review_Status", "Company_Status"]


@query("agg_15", "poi", sql=_WITH_DISTRICT + "\n" + "\nUNION ALL\n".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE coalesce({f}, '') = '') AS blanks, round(count(*) FILTER (WHERE coalesce({f}, '') = '') * 100.0::DOUBLE / count(*), 1) AS percent, CASE WHEN round(count(*) FILTER (WHERE coalesce({f}, '') = '') * 100.0::DOUBLE / count(*), 1) > 50 THEN 'warn' ELSE 'pass' END AS state FROM p" for f in CRITICAL))
def blanks(poi):
    return A.null_rates(poi.withColumn("District_AR", F.expr(DISTRICT_AR)), CRITICAL)


@query("agg_16", "poi", sql="SELECT Name_EN AS value, count(*) AS n FROM poi WHERE coalesce(Name_EN, '') <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 10")
def duplicate_names(poi):
    return A.repeated(poi, "Name_EN").orderBy(F.desc("n"), "value").limit(10)


@query("agg_17", "poi", sql="SELECT Review_Status, count(*) AS n FROM poi GROUP BY 1")
def status_distribution(poi):
    return poi.groupBy("Review_Status").agg(A.long(F.count("*"), "n"))


@query("agg_19", "lineitem", sql="SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1")
def bins(lineitem):
    return A.histogram(lineitem, "l_quantity", [0, 10, 20, 30, 40, 50])


@query("agg_20", "poi", sql=f"SELECT {DECISION} AS decision, count(*) AS n FROM poi GROUP BY 1")
def dashboard(poi):
    return poi.groupBy(A.decision(poi).alias("decision")).agg(A.long(F.count("*"), "n"))


@query("agg_21", "poi", sql="SELECT Category AS name, count(*) AS n FROM poi GROUP BY 1 ORDER BY n DESC, name NULLS LAST LIMIT 10")
def top_categories(poi):
    return A.top(poi, "Category", 10)


_WORTH = lambda fields, p: " + ".join(f"CASE WHEN trim(coalesce({f}, '')) = '' OR {f} IN ('UNAVAILABLE', 'UNAPPLICABLE') THEN 0.0::DOUBLE ELSE {p}::DOUBLE END" for f in fields.split())
# written out apart from the operator's own table
VALUE = " + ".join([_WORTH("Name_EN Name_AR Phone_Number License_Photo_URL", 5), _WORTH("Category Email Website Working_Days Latitude Longitude District_EN", 3), _WORTH("Subcategory District_AR", 2), _WORTH("Working_Hours", 4), _WORTH("Exterior_Photo_URL Interior_Photo_URL", 8), _WORTH("Menu_Photo_URL", 6), _WORTH("Video_URL", 10)])


@query("agg_23", "poi", sql=f"{_WITH_DISTRICT} SELECT Category, count(*) AS places, round(sum({VALUE}), 2) AS value, max({VALUE}) AS most FROM p GROUP BY 1")
def invoice(poi):
    return A.invoice(poi.withColumn("District_AR", F.expr(DISTRICT_AR)))


@query("agg_24", "poi", sql="SELECT DISTINCT Category FROM poi WHERE coalesce(Category, '') <> ''")
def categories(poi):
    return poi.where(~is_blank(F.col("Category"))).select("Category").distinct()


@query("agg_28", "poi", sql="SELECT min(TRY_CAST(Latitude AS DOUBLE)) AS south, max(TRY_CAST(Latitude AS DOUBLE)) AS north, min(TRY_CAST(Longitude AS DOUBLE)) AS west, max(TRY_CAST(Longitude AS DOUBLE)) AS east FROM poi WHERE coalesce(TRY_CAST(Latitude AS DOUBLE), 0) <> 0")
def bounds(poi):
    lat, lon = F.col("Latitude").try_cast("double"), F.col("Longitude").try_cast("double")
    return poi.where(F.coalesce(lat, F.lit(0.0)) != 0).agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


@query("win_02", "events", sql="SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(events):
    return L.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("win_06", "region", sql="SELECT r_name, row_number() OVER (ORDER BY r_name) AS place FROM region")
def numbered(region):
    return region.select("r_name", F.row_number().over(Window.orderBy("r_name")).cast("long").alias("place"))


@query("srt_03", "poi", sql="SELECT GlobalID FROM poi ORDER BY created_at DESC NULLS LAST, GlobalID LIMIT 5")
def newest(poi):
    return poi.orderBy(F.desc_nulls_last("created_at"), "GlobalID").limit(5).select("GlobalID")


@query("srt_04", "poi", sql="SELECT GlobalID, Name_EN FROM poi ORDER BY Name_EN NULLS LAST, GlobalID LIMIT 50 OFFSET 100")
def third_page(poi):
    return A.page(poi, [F.asc_nulls_last("Name_EN"), F.col("GlobalID")], 2).select("GlobalID", "Name_EN")


@query("set_01", "poi", sql="SELECT GlobalID FROM poi WHERE flagged UNION SELECT GlobalID FROM poi WHERE coalesce(Category, '') = ''")
def error_ids(poi):
    return poi.where("flagged").select("GlobalID").union(poi.where(is_blank(F.col("Category"))).select("GlobalID")).distinct()


@query("set_05", "orders", "lineitem", sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def kept_rows(orders, lineitem):
    return orders.join(lineitem.where("l_returnflag = 'R'"), orders.o_orderkey == lineitem.l_orderkey, "left_anti").select("o_orderkey")


@query("arr_02", "pages", sql="SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1")
def links(pages):
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("page_id").agg(A.long(F.count("*"), "links"))


@query("str_15", "poi", sql="SELECT GlobalID, CAST(len(list_filter(regexp_split_to_array(coalesce(Exterior_Photo_URL, '') || ' , ' || coalesce(Menu_Photo_URL, ''), '[,\\s]+'), lambda x: x <> '' AND NOT contains(upper(x), 'UNAVAILABLE'))) AS INTEGER) AS n FROM poi")
def media_lists(poi):
    both = F.concat(F.coalesce("Exterior_Photo_URL", F.lit("")), F.lit(" , "), F.coalesce("Menu_Photo_URL", F.lit("")))
    return poi.select("GlobalID", F.size(X.media_urls(both)).alias("n"))


@query("lif_01", "poi", sql="""
, t(target) AS (VALUES ('Draft'), ('Reviewed'), ('Archived'), ('Rejected'), (''))
SELECT GlobalID, target, target = '' OR CASE coalesce(Review_Status, '') WHEN 'Draft' THEN target IN ('Reviewed', 'Archived', 'Rejected') WHEN 'Reviewed' THEN target IN ('Draft', 'Archived', 'Rejected')
    WHEN 'Archived' THEN target = 'Draft' WHEN 'Rejected' THEN FALSE ELSE TRUE END AS allowed FROM poi, t""")
def transitions(poi):
    targets = poi.withColumn("target", F.explode(F.array(*map(F.lit, ("Draft", "Reviewed", "Archived", "Rejected", "")))))
    return targets.select("GlobalID", "target", L.may_move(F.col("Review_Status"), F.col("target")).alias("allowed"))


MOVED = {"Corporate": ("Business", "Office"), "Shopping": ("Retail", "Mall")}
MOVED_BOTH = {("Restaurants", "Fast Food"): ("Food", "Quick Service")}


@query("lif_11", "poi", sql="""
, m AS (SELECT Category, coalesce(Subcategory, '') AS s, CASE WHEN Category = 'Restaurants' AND Subcategory = 'Fast Food' THEN 'Food' WHEN Category = 'Corporate' THEN 'Business' WHEN Category = 'Shopping' THEN 'Retail' ELSE Category END AS c2,
    CASE WHEN Category = 'Restaurants' AND Subcategory = 'Fast Food' THEN 'Quick Service' WHEN Category = 'Corporate' THEN 'Office' WHEN Category = 'Shopping' THEN 'Mall' ELSE coalesce(Subcategory, '') END AS s2 FROM poi WHERE coalesce(Category, '') <> '')
SELECT Category || '>' || s || ' -> ' || c2 || '>' || s2 AS move, count(*) AS n FROM m WHERE Category <> c2 OR s <> s2 GROUP BY 1""")
def migrations(poi):
    moved = L.migrate_categories(poi, MOVED, MOVED_BOTH).where(~is_blank(F.col("Category")))
    sub = F.coalesce("Subcategory", F.lit(""))
    return moved.where((F.col("Category") != F.col("new_category")) | (sub != F.col("new_subcategory"))).groupBy(F.concat("Category", F.lit(">"), sub, F.lit(" -> "), "new_category", F.lit(">"), "new_subcategory").alias("move")).agg(A.long(F.count("*"), "n"))
