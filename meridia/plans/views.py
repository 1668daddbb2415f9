"""Place-shaped views over the driver's tables, in SQL that both engines read.

Each view is deterministic integer arithmetic over keys; ``POI``, ``AUDIT`` and so
on are used as common table expressions by the oracles and as frames by queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(expr: str, values: list[str]) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


BRANDS = ["Baik", "Noor", "Waha", "Salam", "Reem", "Fahad", "Jouri", "Nakheel", "Danah", "Rawabi"]
BRANDS_AR = ["البيك", "نور", "واحة", "سلام", "ريم", "فهد", "جوري", "نخيل", "دانة", "روابي"]
KINDS = ["Restaurant", "Pharmacy", "Cafe", "Laundry", "Hospital", "Hotel", "Mosque"]
KINDS_AR = ["مطعم", "صيدلية", "مقهى", "مغسلة", "مستشفى", "فندق", "مسجد"]
CATEGORIES = ["Restaurants", "Pharmacies", "Coffee Shops", "Corporate", "Hospitals", "Hotels and Accommodations", "Mosques"]
B = "CAST(floor(c_custkey / 4.0) AS BIGINT)"

POI = f"""
WITH keys AS (SELECT c_custkey AS k, {B} AS b, CAST(floor({B} / 10.0) AS BIGINT) AS c, n_name FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey),
words AS (SELECT *, {_case("b % 10", BRANDS)} AS brand, {_case("b % 10", BRANDS_AR)} AS brand_ar, {_case("c % 7", KINDS)} AS kind, {_case("c % 7", KINDS_AR)} AS kind_ar, {_case("c % 7", CATEGORIES)} AS cat FROM keys)
SELECT
    concat('{{{{C-', lpad(CAST(k AS STRING), 8, '0'), '}}}}') AS GlobalID,
    CASE WHEN k % 53 = 0 THEN NULL WHEN k % 37 = 0 THEN 'n/a' WHEN k % 41 = 0 THEN lower(kind)
        WHEN k % 4 = 0 THEN concat(brand, ' ', kind) WHEN k % 4 = 1 THEN concat(kind, ' Al ', brand, ' LLC')
        WHEN k % 4 = 2 THEN upper(concat(brand, ' ', kind)) ELSE lower(concat(brand, 'e house ', kind)) END AS Name_EN,
    CASE WHEN k % 31 = 0 THEN '' WHEN k % 29 = 0 THEN concat(brand, ' ', kind_ar) WHEN k % 43 = 0 THEN kind_ar WHEN k % 4 = 1 THEN brand_ar ELSE concat(kind_ar, ' ', brand_ar) END AS Name_AR,
    CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 1 THEN NULL ELSE concat(brand, ' Trading') END AS Legal_Name,
    CASE WHEN k % 47 = 0 THEN '' WHEN k % 11 = 0 THEN 'Shopping' ELSE cat END AS Category,
    CASE WHEN k % 3 = 0 THEN 'Fast Food' ELSE '' END AS Subcategory,
    CASE k % 9 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Opening soon' WHEN 2 THEN '' ELSE 'Open' END AS Company_Status,
    CASE WHEN k % 97 = 0 THEN '0' WHEN k % 89 = 0 THEN 'north' ELSE CAST(CAST(24.5 + (b % 400) * 0.002 + (k % 4) * 0.00003 AS DECIMAL(12, 6)) AS STRING) END AS Latitude,
    CASE WHEN k % 97 = 0 THEN '0' WHEN k % 83 = 0 THEN '61.5' ELSE CAST(CAST(46.5 + (b % 300) * 0.003 + (k % 4) * 0.00002 AS DECIMAL(12, 6)) AS STRING) END AS Longitude,
    CASE WHEN k % 5 = 0 THEN concat('https://maps.example.com/', CAST(b AS STRING)) ELSE '' END AS Google_Map_URL,
    CASE k % 7 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN '' WHEN 2 THEN '12' ELSE CAST(1000 + b % 9000 AS STRING) END AS Building_Number,
    CASE k % 8 WHEN 0 THEN 'G' WHEN 1 THEN '2' WHEN 2 THEN 'roof' ELSE '' END AS Floor_Number,
    CASE WHEN k % 13 = 0 THEN 'UNAVAILABLE' WHEN b % 17 = 0 THEN '0501111111' WHEN k % 61 = 0 THEN '9.66E+11'
        WHEN k % 3 = 0 THEN concat('+9665', lpad(CAST(b % 100000000 AS STRING), 8, '0')) WHEN k % 3 = 1 THEN concat('05', lpad(CAST(b % 100000000 AS STRING), 8, '0'))
        ELSE concat('5', lpad(CAST(b % 100000000 AS STRING), 8, '0')) END AS Phone_Number,
    CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN 'nobody' WHEN 2 THEN 'UNAVAILABLE' ELSE concat('info@', lower(brand), '.com') END AS Email,
    CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN 'https://goo.gl/maps/x1' WHEN 2 THEN concat('https://instagram.com/', lower(brand)) WHEN 3 THEN 'UNAVAILABLE' ELSE concat('https://www.', lower(brand), CAST(c % 50 AS STRING), '.com/home?x=1') END AS Website,
    CASE k % 14 WHEN 0 THEN 'https://wa.me/966500000000' WHEN 1 THEN '966500000000' WHEN 2 THEN 'n/a' WHEN 3 THEN concat('https://x.com/', lower(brand)) ELSE '' END AS Social_Media,
    CASE k % 15 WHEN 0 THEN '' WHEN 1 THEN 'Open 24 Hours' WHEN 2 THEN 'UNAVAILABLE' WHEN 3 THEN 'mornings' WHEN 4 THEN 'Mon: 22:00 - 02:00, Tue: 08:00-12:00' WHEN 5 THEN '10:00-09:00' ELSE 'Mon: 08:00-22:00' END AS Working_Hours,
    CASE k % 5 WHEN 0 THEN 'Daily' WHEN 1 THEN 'tbd' ELSE '' END AS Working_Days,
    CASE WHEN k % 19 = 0 THEN 'LIC-77' WHEN b % 23 = 0 THEN '1010101010' WHEN k % 4 < 2 THEN CAST(1000000000 + b AS STRING) ELSE '' END AS Commercial_License,
    CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN concat('http://img.example.com/', CAST(b % 50 AS STRING), '.jpg') ELSE concat('http://img.example.com/e', CAST(k AS STRING), '.jpg') END AS Exterior_Photo_URL,
    CASE k % 10 WHEN 1 THEN NULL WHEN 2 THEN concat('http://img.example.com/', CAST(b % 50 AS STRING), '.jpg') WHEN 3 THEN 'UNAVAILABLE' ELSE concat('http://img.example.com/i', CAST(k AS STRING), '.jpg') END AS Interior_Photo_URL,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN concat('http://img.example.com/i', CAST(k AS STRING), '.jpg') ELSE concat('http://img.example.com/m', CAST(b AS STRING), '.jpg') END AS Menu_Photo_URL,
    CASE k % 8 WHEN 0 THEN 'http://v.example.com/a.avi' WHEN 1 THEN 'http://v.example.com/a.MP4' WHEN 2 THEN 'https://youtu.be/abc' ELSE '' END AS Video_URL,
    CASE WHEN k % 9 = 0 THEN concat('http://img.example.com/e', CAST(k AS STRING), '.jpg') ELSE '' END AS License_Photo_URL,
    CASE WHEN k % 21 = 0 THEN '' ELSE n_name END AS District_EN,
    CASE k % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' ELSE '' END AS Menu,
    CASE k % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'UNAPPLICABLE' WHEN 2 THEN 'y' ELSE '' END AS Dine_In,
    CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'true' ELSE '' END AS Women_Prayer_Room,
    CASE k % 6 WHEN 0 THEN 'No' WHEN 1 THEN '0' ELSE '' END AS Free_Entry,
    CASE k % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE '' END AS WiFi,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'high' ELSE CAST(60 + k % 41 AS STRING) END AS QA_Score,
    CASE k % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Reviewed' WHEN 2 THEN '' WHEN 3 THEN 'Archived' ELSE 'Rejected' END AS Review_Status,
    CASE WHEN k % 7 = 0 THEN TRUE WHEN k % 7 = 1 THEN NULL ELSE FALSE END AS flagged,
    CAST(k % 3 AS INT) AS review_version,
    TIMESTAMP '2024-01-01 00:00:00' + (k % 2000) * INTERVAL '1' HOUR AS created_at
FROM words
"""

AUDIT = """
SELECT event_id AS id, concat('{{C-', lpad(CAST(event_id % 500 AS STRING), 8, '0'), '}}') AS global_id, CAST(user_id AS STRING) AS reviewer,
    CASE event_type WHEN 'view' THEN 'edit' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'reject' WHEN 'error' THEN 'flag' ELSE 'create' END AS action,
    CASE WHEN event_id % 9 = 0 THEN 'Reviewed' ELSE CAST(event_id % 7 AS STRING) END AS new_value, ts AS created_at
FROM {events}
"""

TABLES = {"poi": (POI, ("customer", "nation")), "audit": (AUDIT, ("events",))}


def spread(table: DataFrame) -> DataFrame:
    """A table's rows over all cores: a file of few bytes is one task otherwise, whatever is worked out from its rows."""
    return table.repartition(3 * table.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = TABLES[name]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql, **{t: spread(df) if t == "customer" else df for t, df in read.items()})


def oracle(name: str) -> str:
    """The view's SQL for an engine in which the tables are registered."""
    sql, tables = TABLES[name]
    return sql.format(**{t: t for t in tables})


def with_views(sql: str, *names: str) -> str:
    """``sql`` after common table expressions of the named views."""
    return "WITH " + ", ".join(f"{n} AS ({oracle(n)})" for n in names) + "\n" + sql
