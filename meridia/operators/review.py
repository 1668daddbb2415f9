"""What reviewers work with: page filters, media lists, verdicts on pairs, safe fixes, batch checks and draft decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.values import compact, guid_of, is_blank, strip, text
from .analytics import long

# Columns of the named views.
COLUMN_GROUPS = {
    "key": "GlobalID Name_AR Name_EN Category District_EN Phone_Number QA_Score Review_Status Review_Flag".split(),
    "basic": "GlobalID Name_AR Name_EN Legal_Name Category Subcategory Category_Level_3 Company_Status Latitude Longitude Google_Map_URL District_AR District_EN Building_Number Floor_Number Entrance_Location".split(),
    "contact": "GlobalID Name_EN Phone_Number Email Website Social_Media Menu_Barcode_URL Language Cuisine Payment_Methods Commercial_License".split(),
    "hours": "GlobalID Name_EN Working_Days Working_Hours Break_Time Holidays".split(),
    "photos": "GlobalID Name_EN Exterior_Photo_URL Interior_Photo_URL Menu_Photo_URL Video_URL License_Photo_URL Additional_Photo_URLs Num_Menu_Photos Num_Additional_Photos".split(),
    "amenities": ["GlobalID", "Name_EN", "Amenities", *S.AMENITIES],
    "qa": "GlobalID Name_EN Confidence Source All_Sources Importance_Score QA_Score Review_Flag Review_Notes Review_Status flagged flag_reason draft_reason last_reviewed_at last_reviewed_by review_version".split(),
}
# Media types and their fields.
MEDIA_TYPES = {"exterior": "Exterior_Photo_URL", "interior": "Interior_Photo_URL", "menu": "Menu_Photo_URL", "video": "Video_URL", "license": "License_Photo_URL", "additional": "Additional_Photo_URLs"}
# Fixed values of the batch checks.
CATEGORY_MAP = {
    "Restaurant": "Food & Beverage", "Restaurants": "Food & Beverage", "Pharmacy": "Health & Medical", "Laundry": "Life & Convenience", "Barbershop": "Life & Convenience", "Auto Service": "Services & Industry",
    "commercial": "Services & Industry", "retail": "Shopping & Distribution",
}
INVALID_WEBSITES = ("facebook.com", "google.com", "instagram.com", "twitter.com", "maps.google", "maps.app")
BRANCH_WORDS = ("فرع", "فرع ", "branch", "Branch", "النفل", "الوادي", "الياسمين")
PHONE_IN_NAME = (r"\d{9,}", r"\d{3}\s*\d{3}\s*\d{3}")
FLOORS = ("G", "B1", "1", "2", "3", "4", "5", "UNAVAILABLE", "UNAPPLICABLE", "")
# What the edit page locks to food places.
PAGE_FOOD = ("Restaurants", "Food and Beverages", "Coffee Shops", "Food & Beverage", "Restaurant", "Cafe", "Cafes", "Coffee Shop", "Bakery", "Fast Food", "Fine Dining", "Catering", "Food Truck", "Juice Bar", "Ice Cream", "Dessert", "Buffet")
PAGE_FOOD_FIELDS = ("Menu", "Dine_In", "Only_Delivery", "Cuisine", "Menu_Barcode_URL", "Menu_Photo_URL", "Reservation", "Iftar_Tent", "Iftar_Menu", "Open_Suhoor", "Shisha")
TRIMMED = ("Name_EN", "Name_AR", "Legal_Name", "Phone_Number", "Email", "Website", "Social_Media", "District_EN", "District_AR", "Building_Number")


def column_group(pois: DataFrame, name: str) -> DataFrame:
    """The columns of a named view that the table has."""
    return pois.select(*(c for c in COLUMN_GROUPS[name] if c in pois.columns))


def overlay(pois: DataFrame, edits: DataFrame, key: str = "GlobalID") -> DataFrame:
    """Fields of local edits (one row per key) win where they are given."""
    e = edits.alias("e")
    fields = [c for c in edits.columns if c in pois.columns and c != key]
    joined = pois.alias("p").join(e, F.col(f"p.{key}") == F.col(f"e.{key}"), "left")
    return joined.select(*(F.coalesce(F.col(f"e.{c}"), F.col(f"p.{c}")).alias(c) if c in fields else F.col(f"p.{c}") for c in pois.columns))


def filtered(pois: DataFrame, tab: str = "all", status: str = "all", category: str = "all", search: str = "", within: tuple[str, ...] = ("Name_EN", "Name_AR", "GlobalID", "Phone_Number", "Category")) -> DataFrame:
    """The conjunction of a page's tab, status, category and search.

    Search is literal, in any of the fields ``within``; the query is lower-cased, Arabic names and phones are not.
    """
    s = F.coalesce("Review_Status", F.lit(""))
    tabs = {"pending": s.isin("", "Draft", "Pending"), "reviewed": s.isin("Reviewed", "Approved"), "flagged": F.coalesce("flagged", F.lit(False)), "rejected": s == "Rejected"}
    states = {"pending": s.isin("", "Draft"), "reviewed": tabs["reviewed"]}
    tests = [t for t in (tabs.get(tab), states.get(status), None if category == "all" else F.col("Category") == category) if t is not None]
    if search.strip():
        q = F.lit(search.lower())
        have = lambda c, low: F.contains(F.lower(F.coalesce(c, F.lit(""))) if low else F.coalesce(c, F.lit("")), q)
        tests.append(reduce(lambda a, b: a | b, (have(c, c not in ("Name_AR", "Phone_Number")) for c in within)))
    return pois.where(reduce(lambda a, b: a & b, tests)) if tests else pois


def drafts(pois: DataFrame, kind: str = "all") -> DataFrame:
    s = F.coalesce("Review_Status", F.lit(""))
    return pois.where({"draft": s.isin("", "Draft"), "pending": s == "Pending"}.get(kind, s.isin("", "Draft", "Pending")))


def media_items(pois: DataFrame) -> DataFrame:
    """GlobalID, name, type, url, field: a row per URL of each media field."""
    parts = [F.struct(F.lit(t).alias("type"), F.lit(c).alias("field"), F.col(c).alias("value")) for t, c in MEDIA_TYPES.items() if c in pois.columns]
    name = F.when(is_blank(F.col("Name_EN")), "Unnamed").otherwise(F.col("Name_EN")).alias("name")
    rows = pois.select("GlobalID", name, F.explode(F.array(*parts)).alias("m")).where((text(F.col("m.value")) != "") & (F.col("m.value") != "UNAVAILABLE"))
    urls = rows.select("GlobalID", "name", "m.type", "m.field", F.explode(F.split("m.value", ",")).alias("url"))
    return urls.withColumn("url", strip(F.col("url"))).where("url <> ''").select("GlobalID", "name", "type", "url", "field")


def select_media(items: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    rows = items if kind == "all" else items.where(F.col("type") == kind)
    q = F.lit(search.lower())
    return rows.where(F.contains(F.lower("name"), q) | F.contains(F.lower("url"), q)) if search.strip() else rows


def attachment_type(name: Column, keywords: Column, content_type: Column) -> Column:
    """exterior, interior, menu, video, license or other, in this order of precedence."""
    n, k, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, keywords, content_type))
    has = lambda c, *words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    kind = F.when(has(k, "exterior", "entrance") | has(n, "exterior", "entrance"), "exterior").when(has(k, "interior", "walkthrough") | has(n, "interior"), "interior")
    kind = kind.when(has(k, "menu") | has(n, "menu"), "menu").when(has(t, "video") | n.endswith(".mov") | n.endswith(".mp4"), "video")
    return kind.when(has(k, "license", "licence") | has(n, "license"), "license").otherwise("other")


def braced_value(c: Column, key: str) -> Column:
    """The text in braces after ``key=``, without quotes; '' if there is none."""
    return F.replace(F.coalesce(F.regexp_extract(c, key + r"=\{([^}]*)\}", 1), F.lit("")), F.lit('"'), F.lit(""))


def pair_key(source: Column, candidate: Column) -> Column:
    return F.concat(source, F.lit("|"), candidate)


def checked_verdicts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts in upper case, refused rows with ``error``): both ids, a reviewer and MATCH or NOT_MATCH are required."""
    wanted = ("source_gid", "candidate_gid", "reviewer", "verdict")
    missing = F.coalesce(*(F.when(is_blank(F.col(c)), F.lit(f"missing:{c}")) for c in wanted))
    judged = rows.withColumn("verdict", F.upper("verdict")).withColumn("error", F.coalesce(missing, F.when(~F.col("verdict").isin("MATCH", "NOT_MATCH"), "verdict")))
    return judged.where("error is null").drop("error"), judged.where("error is not null")


def pairs_by_verdict(pairs: DataFrame, verdicts: DataFrame, kind: str = "all") -> DataFrame:
    """Pairs that are ``unreviewed``, ``match``, ``not_match``, or all."""
    keys = ["source_gid", "candidate_gid"]
    if kind == "unreviewed":
        return pairs.join(verdicts, keys, "left_anti")
    if kind in ("match", "not_match"):
        return pairs.join(verdicts.where(F.col("verdict") == kind.upper()), keys, "left_semi")
    return pairs


def with_places(pairs: DataFrame, pois: DataFrame, fields: tuple[str, ...] = ("Name_EN",)) -> DataFrame:
    """Both places of each pair, as source_<field> and candidate_<field>; null where a place is not known."""
    for side in ("source", "candidate"):
        end = pois.select(F.col("GlobalID").alias(f"{side}_gid"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
        pairs = pairs.join(end, f"{side}_gid", "left")
    return pairs


def touching(pairs: DataFrame, gid: str) -> DataFrame:
    return pairs.where((F.col("source_gid") == gid) | (F.col("candidate_gid") == gid))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return verdicts.agg(long(F.count("*"), "total_samples"), long(F.count_if(v == "MATCH"), "match_count"), long(F.count_if(v == "NOT_MATCH"), "not_match_count"))


def merged(old: Column, new: Column) -> Column:
    """Two string maps; of equal keys the new one's value.  Null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def safe_fixes(pois: DataFrame) -> DataFrame:
    """The places with safe fixes applied, and ``fixes``: array<struct<field, old, new, reason>>; a fixed place's version rises.

    Where two fixes name a field, the later one's value holds.
    """
    have = set(pois.columns)
    value = lambda f: F.coalesce(F.col(f), F.lit(""))
    new: dict[str, Column] = {}
    fixes: list[Column] = []

    def fix(field: str, when: Column, put: Column, reason: Column | str, old: Column | None = None) -> None:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        fixes.append(F.when(when, F.struct(F.lit(field).alias("field"), (value(field) if old is None else old).alias("old"), put.alias("new"), why.alias("reason"))))
        new[field] = F.when(when, put).otherwise(new.get(field, F.col(field)))

    gone = F.lit("UNAVAILABLE")
    for f in TRIMMED:
        if f in have:
            fix(f, (value(f) != text(F.col(f))) & (text(F.col(f)) != ""), text(F.col(f)), "trimmed whitespace")
    for f in S.AMENITIES:
        if f in have:
            v, low = text(F.col(f)), F.lower(text(F.col(f)))
            yes, no, none = low.isin("yes", "y", "true", "1"), low.isin("no", "n", "false", "0"), low.isin("n/a", "na", "unavailable", "none", "null")
            put = F.when(yes, F.lit("Yes")).when(no, F.lit("No")).otherwise(gone)
            why = F.when(yes, "normalized to Yes").when(no, "normalized to No").when(none, "normalized to UNAVAILABLE").otherwise("invalid value set to UNAVAILABLE")
            fix(f, (v != put) & ~low.isin("", "unapplicable"), put, why, v)
    if {"Website", "Google_Map_URL"} <= have:
        site, here = F.lower(value("Website")), value("Google_Map_URL")
        maps = site.contains("maps.google") | site.contains("maps.app") | site.contains("goo.gl/maps")
        fix("Google_Map_URL", maps & here.isin("", "UNAVAILABLE"), value("Website"), "moved from Website")
        fix("Website", maps, gone, "was Google Maps link")
    if "Phone_Number" in have:
        fix("Phone_Number", F.lower(value("Phone_Number")).contains("e+"), gone, "scientific notation")
    if "Email" in have:
        fix("Email", ~value("Email").isin("", "UNAVAILABLE") & ~value("Email").rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$"), gone, "invalid email format")
    if "Floor_Number" in have:
        fix("Floor_Number", ~text(F.col("Floor_Number")).isin(*FLOORS), gone, "invalid floor value", text(F.col("Floor_Number")))
    media = [f for f in S.MEDIA_FIELDS if f in have]
    for i, f in enumerate(media):
        first = F.coalesce(F.lit(None).cast("string"), *(F.when(value(g) == value(f), F.lit(g)) for g in media[:i]))
        fix(f, value(f).startswith("http") & first.isNotNull(), gone, F.concat(F.lit("duplicate of "), first))
    out = pois.select(*(new[c].alias(c) if c in new else F.col(c) for c in pois.columns), F.array_compact(F.array(*fixes)).alias("fixes"))
    return out.withColumn("review_version", F.when(F.size("fixes") > 0, F.coalesce("review_version", F.lit(0)) + 1).otherwise(F.col("review_version"))) if "review_version" in have else out


def page_findings(pois: DataFrame) -> DataFrame:
    """+ findings: array<struct<code, field, severity>> by the rules of the edit page.

    Coordinates are read as the page reads them: blank counts as 0, other text as no number.
    """
    v = lambda f: text(F.col(f)) if f in pois.columns else F.lit("")
    plain = lambda f: ~v(f).isin("", "UNAVAILABLE")
    given = lambda f: ~v(f).isin("", "UNAVAILABLE", "UNAPPLICABLE")
    n = lambda f: F.when(v(f) == "", 0.0).otherwise(F.when(v(f).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v(f).try_cast("double")))
    lat, lon = n("Latitude"), n("Longitude")
    both = lat.isNotNull() & lon.isNotNull()
    rules = [
        ("N1", "Name_AR", "BLOCKER", F.length(v("Name_AR")) < 2), ("N2", "Name_EN", "BLOCKER", F.length(v("Name_EN")) < 2), ("M5", "Category", "BLOCKER", v("Category") == ""),
        ("M6", "District_EN", "BLOCKER", v("District_EN") == ""), ("D1", "District_AR", "WARNING", v("District_AR") == ""), ("L1", "Latitude", "BLOCKER", both & (lat == 0) & (lon == 0)),
        ("M3", "Latitude", "BLOCKER", ~both | (lat < 15) | (lat > 35)), ("M4", "Longitude", "BLOCKER", both & ((lon < 35) | (lon > 60))),
        ("M7", "Working_Hours", "WARNING", v("Working_Hours") == ""), ("H1", "Working_Days", "WARNING", v("Working_Days") == ""),
        ("V1", "Interior_Photo_URL", "WARNING", (v("Exterior_Photo_URL") != "") & (v("Exterior_Photo_URL") == v("Interior_Photo_URL"))),
        ("P1", "Phone_Number", "WARNING", plain("Phone_Number") & ~ui_phone(v("Phone_Number")).rlike(r"(?i)^(\+?\d{7,15}|UNAVAILABLE|UNAPPLICABLE)$")),
        ("E1", "Email", "WARNING", given("Email") & ~v("Email").rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+$")), ("U1", "Website", "WARNING", given("Website") & ~v("Website").rlike(r"(?i)^https?://.+")),
    ]
    rules += [("FNB", f, "INFO", ~v("Category").isin(*PAGE_FOOD) & given(f) & (v(f) != "No")) for f in PAGE_FOOD_FIELDS if f in pois.columns]
    return pois.withColumn("findings", compact(*(F.when(hit, F.struct(F.lit(c).alias("code"), F.lit(f).alias("field"), F.lit(s).alias("severity"))) for c, f, s, hit in rules)))


# The fields of the score.
SCORED = ("Name_AR", "Name_EN", "Category", "Subcategory", "District_EN", "District_AR", "Latitude", "Longitude", "Phone_Number", "Working_Hours", "Working_Days", "Exterior_Photo_URL", "Interior_Photo_URL")


def page_score(pois: DataFrame) -> DataFrame:
    """+ findings, qa_score: completeness in percent, less 15 for a blocker and 5 for a warning of the edit page, within 0 and 100."""
    have = reduce(lambda a, b: a + b, [(~text(F.col(f)).isin("", "UNAVAILABLE")).cast("int") for f in SCORED if f in pois.columns])
    n = lambda severity: F.size(F.filter("findings", lambda x: x["severity"] == severity))
    score = F.floor(have / len(SCORED) * 100.0 - 15 * n("BLOCKER") - 5 * n("WARNING") + 0.5)
    return page_findings(pois).withColumn("qa_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))


def ui_phone(c: Column) -> Column:
    """Without white space, hyphens and brackets."""
    return F.regexp_replace(c, r"(?U)[\s\-()]", "")


def licence_error(c: Column) -> Column:
    s = text(c)
    return F.when(is_blank(c, "batch"), None).when(F.contains(F.upper(s), F.lit("E+")) | s.rlike("[a-zA-Z]") | s.contains(" "), "INVALID_LICENSE").when(F.length(F.regexp_replace(s, r"\D", "")) != 10, "LICENSE_NOT_10_DIGITS")


def category_check(pois: DataFrame) -> tuple[Column, Column]:
    """(mapped category, error): restaurants need a menu, a video or a word about seating."""
    cat = text(F.col("Category"))
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_MAP.items() for x in pair))
    told = [~is_blank(F.col(f), "batch") for f in ("Menu_Photo_URL", "Video_URL", "Family_Seating", "Waiting_Area", "Dine_In") if f in pois.columns]
    food = cat.contains("Restaurant") | cat.contains("restaurant") | (cat == "commercial")
    return F.coalesce(F.try_element_at(table, cat), cat), F.when(food & ~reduce(lambda a, b: a | b, told), "RESTAURANT_NO_MENU_OR_SEATING")


def website_error(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(~is_blank(c, "batch") & reduce(lambda a, b: a | b, [low.contains(d) for d in INVALID_WEBSITES]), "INVALID_WEBSITE_DOMAIN")


def name_errors(name_ar: Column, name_en: Column) -> Column:
    """An entry for each pattern and each word that either name holds."""
    ar, en = text(name_ar), text(name_en)
    return compact(
        *(F.when(ar.rlike(p) | en.rlike(p), F.lit("NAME_CONTAINS_PHONE")) for p in PHONE_IN_NAME), *(F.when(ar.contains(w) | en.contains(w), F.lit("NAME_CONTAINS_BRANCH")) for w in BRANCH_WORDS)
    )


def media_errors(exterior: Column, interior: Column, menu: Column, video: Column) -> Column:
    lists = [X.media_urls(F.coalesce(c, F.lit(""))) for c in (exterior, interior, menu, video)]
    every = F.concat(*lists)
    return compact(F.when(F.size(every) != F.size(F.array_distinct(every)), F.lit("DUPLICATE_MEDIA_URLS")), F.when(F.arrays_overlap(lists[0], lists[1]), F.lit("EXTERIOR_INTERIOR_SAME_URL")))


def reject_drafts(rows: DataFrame, ids: DataFrame, reviewer: str, note: str, at: Column, key: str = "GlobalID") -> DataFrame:
    """Pending drafts of the ids become rejected, the note is put behind theirs; all others stay."""
    hit = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    now = F.coalesce("_hit", F.lit(False)) & (F.coalesce("Draft_Status", F.lit("pending")) == "pending")
    put = {"Draft_Status": F.lit("rejected"), "Reviewed_By": F.lit(reviewer), "Reviewed_At": at, "Review_Notes": F.concat(F.coalesce("Review_Notes", F.lit("")), F.lit(note))}
    return hit.select(*(F.when(now, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in rows.columns))


def create_defaults(rows: DataFrame) -> DataFrame:
    """New places: an id where none is given, Draft, reason new and version 0 where no status is given.

    The id follows from the row's values, so a repeated task gives the same; equal rows share theirs.
    """
    fresh = is_blank(F.col("Review_Status"))
    whole = F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "GlobalID")), {"ignoreNullFields": "false"})
    return rows.withColumns({
        "GlobalID": F.when(is_blank(F.col("GlobalID")), guid_of(whole)).otherwise(F.col("GlobalID")), "draft_reason": F.when(fresh, "new").otherwise(F.col("draft_reason")),
        "review_version": F.when(fresh, 0).otherwise(F.coalesce("review_version", F.lit(0))), "Review_Status": F.when(fresh, "Draft").otherwise(F.col("Review_Status")),
    })


def review_statistics(verdicts: DataFrame) -> DataFrame:
    """total, matches, others, reviewers, pairs of human verdicts: one row."""
    v = F.col("verdict")
    pair = F.struct("source_gid", "candidate_gid")
    return verdicts.agg(long(F.count("*"), "total"), long(F.count_if(v == "MATCH"), "matches"), long(F.count_if(v == "NOT_MATCH"), "others"), long(F.countDistinct("reviewer"), "reviewers"), long(F.countDistinct(pair), "pairs"))


def delivery_gate(pois: DataFrame, key: str = "GlobalID", least: float = 98.0) -> DataFrame:
    """rows, bad, licence_errors, media_errors, accuracy, passed of a delivery: one pass over its rows.

    Bad are the ids with a licence, phone, category or media error; it passes with
    ``least`` percent of good rows and no licence or media error.  An empty table
    has an accuracy of 0.
    """
    licence = licence_error(F.col("Commercial_License")).isNotNull()
    media = F.size(media_errors(*(F.col(c) for c in ("Exterior_Photo_URL", "Interior_Photo_URL", "Menu_Photo_URL", "Video_URL")))) > 0
    _, phone = X.fix_phone(F.col("Phone_Number"))
    _, category = category_check(pois)
    bad = licence | media | phone.isNotNull() | category.isNotNull()
    found = pois.agg(long(F.count("*"), "rows"), long(F.countDistinct(F.when(bad, F.col(key))), "bad"), long(F.count_if(licence), "licence_errors"), long(F.count_if(media), "media_errors"))
    found = found.withColumn("accuracy", F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("bad")) * 100.0 / F.col("rows"), 2)).otherwise(0.0))
    return found.withColumn("passed", (F.col("accuracy") >= least) & (F.col("licence_errors") == 0) & (F.col("media_errors") == 0))


def known_names(rows: DataFrame, places: DataFrame) -> DataFrame:
    """+ known: the place with the row's Name_EN, or else with its Name_AR; of several the smallest id, null for none.  Blank names meet nothing."""
    name = lambda f: F.nullif(F.col(f), F.lit(""))
    by = lambda f, to: places.where(name(f).isNotNull()).groupBy(F.col(f)).agg(F.min("GlobalID").alias(to))
    found = rows.join(by("Name_EN", "_en"), "Name_EN", "left").join(by("Name_AR", "_ar"), "Name_AR", "left")
    return found.select(*(F.col(c) for c in rows.columns), F.coalesce("_en", "_ar").alias("known"))


def unacknowledged(queue: DataFrame, n: int = 50) -> DataFrame:
    return queue.where(~F.coalesce("acknowledged", F.lit(False))).orderBy(F.desc_nulls_first("created_at"), F.desc("id")).limit(n)


def acknowledge(queue: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Marks the rows of the ids, or all."""
    if ids is None:
        return queue.withColumn("acknowledged", F.lit(True))
    hit = queue.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("acknowledged", F.coalesce("_hit", F.col("acknowledged"), F.lit(False))).select(*queue.columns)


def numbered_pages(rows: DataFrame, groups: list[str], order: list[Column], size: int = 25) -> DataFrame:
    """+ page (from 1) and pages, within each group."""
    w = Window.partitionBy(*groups)
    return rows.withColumn("page", F.ceil(F.row_number().over(w.orderBy(*order)) / size).cast("long")).withColumn("pages", F.ceil(F.count("*").over(w) / size).cast("long"))
