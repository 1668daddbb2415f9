"""Validation: a catalogue of declarative rules, corrections in stages, and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.values import any_of, is_blank, number, once, text
from ..sources.shared import written

HOURS = r"\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2}"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str  # blocker or warning
    field: str
    fires: Column


def with_fields(pois: DataFrame) -> DataFrame:
    """All text columns the rules read, '' where the table lacks them."""
    wanted = {*S.TEXT_FIELDS, *S.AMENITIES, *S.REVIEW_FIELDS}
    return pois.withColumns({c: F.lit("") for c in sorted(wanted - set(pois.columns))})


def v(name: str) -> Column:
    return text(F.col(name))


def is_food() -> Column:
    return v("Category").isin(*S.FOOD_CATEGORIES) | F.lower(v("Category")).rlike("food|restaurant|cafe|coffee")


def closes_early(hours: Column, slack: int) -> Column:
    """Some range of the text opens more than ``slack`` minutes after it closes."""
    at = lambda g: F.regexp_extract_all(hours, F.lit(r"(\d{1,2}):(\d{2})\s*[-–]\s*(\d{1,2}):(\d{2})"), F.lit(g))
    ranges = F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), at(4).alias("d"))
    return F.exists(ranges, lambda r: r["a"].cast("int") * 60 + r["b"].cast("int") - r["c"].cast("int") * 60 - r["d"].cast("int") > slack)


def catalogue() -> list[Rule]:
    """The row-local rules, in the order in which findings are listed."""
    ar, en, cat, web, social = v("Name_AR"), v("Name_EN"), v("Category"), v("Website"), v("Social_Media")
    ext, inner, video = v("Exterior_Photo_URL"), v("Interior_Photo_URL"), v("Video_URL")
    letters = F.regexp_replace(en, r"[^\p{L}]", "")
    arabic = F.length(F.regexp_replace(ar, r"[^\x{0600}-\x{06FF}]", ""))
    alike = X.dice(ar, X.transliterate(en), short="set")
    brand = F.filter(F.split(en, r"(?U)\s+"), lambda w: (F.length(w) >= 3) & F.substring(w, 1, 1).rlike(r"^\p{Lu}") & ~F.lower(w).isin(*S.NAME_ONLY_EN))
    first = F.coalesce(F.get(brand, F.lit(0)), F.lit(""))
    unlike = lambda f, t: (f != "") & ~F.contains(ar, t) & ~F.contains(F.lower(ar), F.lower(f)) & (X.dice(ar, t, short="set") < 30)
    brand_missing = once(first, lambda f: once(X.transliterate(f), lambda t: unlike(f, t)))
    wrong_kind = [F.contains(ar, F.lit(word)) & ~en.rlike("(?i)" + english) & en.rlike("(?i)" + S.EN_BUSINESS) for word, english in S.AR_BUSINESS.items()]
    both = F.lower(F.concat(ar, F.lit(" "), en))
    lat, lon = number(F.col("Latitude")), number(F.col("Longitude"))
    lat0, lon0 = F.when(is_blank(F.col("Latitude")), 0.0).otherwise(lat), F.when(is_blank(F.col("Longitude")), 0.0).otherwise(lon)
    numeric = lat0.isNotNull() & lon0.isNotNull()
    phone, email, hours = v("Phone_Number"), v("Email"), v("Working_Hours")
    is_map = web.rlike(r"google\.com/maps|goo\.gl/maps|maps\.google\.com")
    given = lambda c: (c != "") & (c != "UNAVAILABLE")
    B, W = "blocker", "warning"
    rules = [
        Rule("GATE-A1", B, "Name_AR", F.length(ar) < 2),
        Rule("GATE-A2", W, "Name_AR", (F.length(ar) >= 2) & ar.rlike("[A-Za-z]")),
        Rule("GATE-A3", B, "Name_AR", (F.length(ar) >= 2) & ar.isin(*S.NAME_ONLY_AR)),
        Rule("GATE-B1", B, "Name_EN", F.length(en) < 2),
        Rule("GATE-B2", W, "Name_EN", (F.length(en) >= 2) & en.rlike(r"[\x{0600}-\x{06FF}]")),
        Rule("GATE-B3", B, "Name_EN", (F.length(en) >= 2) & ~en.rlike(r"[\x{0600}-\x{06FF}]") & F.lower(en).isin(*S.NAME_ONLY_EN)),
        Rule("GATE-B4", W, "Name_EN", (F.length(letters) >= 4) & (letters == F.upper(letters)) & (letters != F.lower(letters))),
        Rule("GATE-B5", W, "Name_EN", (F.length(letters) >= 4) & (letters == F.lower(letters)) & (letters != F.upper(letters))),
        Rule("GATE-A4", W, "Name_AR", (F.length(ar) >= 3) & (F.length(en) >= 3) & (arabic >= F.length(F.replace(ar, F.lit(" "))) * 0.7) & (alike > 70)),
        Rule("GATE-A5", W, "Name_AR", (ar != "") & (F.length(en) >= 4) & brand_missing),
        Rule("GATE-A6", B, "Name_AR", (ar != "") & (en != "") & any_of(wrong_kind)),
        Rule("GATE-C1", W, "Legal_Name", F.length(v("Legal_Name")) < 3),
        Rule("GATE-D1", B, "Exterior_Photo_URL", ~given(ext)),
        Rule("GATE-D2", B, "Interior_Photo_URL", ~given(inner)),
        Rule("GATE-D3", B, "Interior_Photo_URL", (ext != "") & (ext == inner)),
        Rule("GATE-D4", W, "Video_URL", given(video) & (video != "UNAPPLICABLE") & ~video.rlike(r"(?i)\.(mp4|mov)$") & ~video.rlike(r"youtube|youtu\.be")),
        Rule("GATE-E1", B, "Category", cat == ""),
        Rule("GATE-E2", W, "Category", both.rlike("صيدلية|pharmacy") & (cat != "") & ~F.lower(cat).rlike("health|clinic|pharma")),
        Rule("GATE-E3", W, "Category", both.rlike("مطعم|restaurant") & (cat != "") & ~is_food()),
        Rule("GATE-F1", W, "Company_Status", (v("Company_Status") != "") & ~v("Company_Status").isin("Open", "Temporarily Closed", "Permanently Closed", "Closed")),
        Rule("GATE-G1", B, "Latitude", numeric & ~lat0.between(15, 35)),
        Rule("GATE-G2", B, "Longitude", numeric & ~lon0.between(35, 60)),
        Rule("GATE-G3", B, "Latitude", ~numeric),
        Rule("GATE-G4", W, "District_EN", v("District_EN") == ""),
        Rule("GATE-H1", W, "Building_Number", given(v("Building_Number")) & ~v("Building_Number").rlike(r"^\d{4}$")),
        Rule("GATE-H2", W, "Floor_Number", ~v("Floor_Number").isin("G", "B1", "1", "2", "3", "4", "5", "UNAVAILABLE", "")),
        Rule("GATE-I1", W, "Phone_Number", given(phone) & phone.rlike(r"[eE]\+")),
        Rule("GATE-I2", W, "Phone_Number", given(phone) & ~phone.rlike(r"[eE]\+") & ~F.translate(phone, " -", "").rlike(S.SAUDI_PHONE)),
        Rule("GATE-I3", W, "Email", given(email) & ~email.rlike(r"^[^@]+@[^@]+\.[^@]+$")),
        Rule("GATE-I4", W, "Website", is_map),
        Rule("GATE-I4b", W, "Website", given(web) & ~is_map & any_of([F.contains(F.lower(web), F.lit(d)) for d in S.SOCIAL_HOSTS])),
        Rule("GATE-I5", W, "Social_Media", given(social) & (F.contains(social, F.lit("wa.me")) | F.contains(F.lower(social), F.lit("whatsapp")))),
        Rule("GATE-I6", W, "Social_Media", given(social) & F.replace(social, F.lit(" ")).rlike(r"^\+?\d{10,}$")),
        Rule("GATE-J1", B, "Working_Hours", hours == ""),
        Rule("GATE-J2", W, "Working_Hours", given(hours) & (hours != "Open 24 Hours") & ~hours.rlike(HOURS)),
        Rule("GATE-J3", W, "Working_Hours", given(hours) & hours.rlike(HOURS) & closes_early(hours, 180)),
        *(Rule("GATE-K1", W, f, ~v(f).isin("", "Yes", "No", "UNAVAILABLE", "UNAPPLICABLE")) for f in S.AMENITIES),
        Rule("GATE-L1", W, "Commercial_License", given(v("Commercial_License")) & ~v("Commercial_License").rlike(r"^\d{10}$")),
    ]
    return rules


def corrections(pois: DataFrame) -> DataFrame:
    """The table after all corrections: rules' fixes first, then placeholders, then repeated media."""
    return _media_corrected(_corrected(pois))


def _corrected(pois: DataFrame) -> DataFrame:
    by = {(r.id, r.field): r.fires for r in catalogue()}
    no, never = F.lit("UNAVAILABLE"), F.lit("UNAPPLICABLE")
    fix: dict[str, Column] = {}
    for field, rule in (("Legal_Name", "GATE-C1"), ("Interior_Photo_URL", "GATE-D3"), ("Video_URL", "GATE-D4"), ("Floor_Number", "GATE-H2"), ("Phone_Number", "GATE-I1"), ("Email", "GATE-I3")):
        fix[field] = F.when(by[rule, field], no).otherwise(F.col(field))
    fix["Name_EN"] = F.when(by["GATE-B4", "Name_EN"] | by["GATE-B5", "Name_EN"], X.title(v("Name_EN"))).otherwise(F.col("Name_EN"))
    fix["Menu_Photo_URL"] = F.when(~is_food() & (v("Menu_Photo_URL") != "UNAVAILABLE"), never).otherwise(F.col("Menu_Photo_URL"))
    fix["Company_Status"] = F.when(v("Company_Status") == "Closed", "Permanently Closed").otherwise(F.col("Company_Status"))
    is_map, is_social = by["GATE-I4", "Website"], by["GATE-I4b", "Website"]
    fix["Google_Map_URL"] = F.when(is_map & is_blank(F.col("Google_Map_URL")), v("Website")).otherwise(F.col("Google_Map_URL"))
    fix["Website"] = F.when(is_map | is_social, no).otherwise(F.col("Website"))
    fix["Social_Media"] = F.when(by["GATE-I6", "Social_Media"], no).when(is_social & v("Social_Media").isin("", "UNAVAILABLE"), v("Website")).otherwise(F.col("Social_Media"))
    for fields, right in ((S.FOOD_AMENITIES, is_food()), (S.MOSQUE_AMENITIES, v("Category").isin(*S.MOSQUE_CATEGORIES)), (S.ATTRACTION_AMENITIES, v("Category").isin(*S.ATTRACTION_CATEGORIES))):
        for f in fields:
            fix[f] = F.when(~right & ~v(f).isin("", "UNAPPLICABLE"), never)
    for f in S.AMENITIES:
        valid = F.when(by["GATE-K1", f], no).otherwise(F.col(f))
        fix[f] = F.coalesce(fix[f], valid) if f in fix else valid
    first = pois.withColumns(fix)
    second = first.withColumns({f: F.when(F.lower(v(f)).isin(*S.SENTINELS_VALIDATION), no).otherwise(F.col(f)) for f in S.SENTINEL_FIELDS})
    return second


def _media_corrected(pois: DataFrame) -> DataFrame:
    return pois.withColumns({f: F.when(repeated_media(f), F.lit("UNAVAILABLE")).otherwise(F.col(f)) for f in S.MEDIA_FIELDS[1:]})


def repeated_media(field: str) -> Column:
    """The URL stands in an earlier media field."""
    before = S.MEDIA_FIELDS[: S.MEDIA_FIELDS.index(field)]
    return ~v(field).isin("", "UNAVAILABLE", "UNAPPLICABLE") & any_of([v(f) == v(field) for f in before])


def local_findings(pois: DataFrame, prefix: str = "GATE-", key: str = "GlobalID") -> DataFrame:
    """Findings of the row-local rules whose id starts with the prefix."""
    return with_fields(pois).select(F.col(key), F.inline(_found(prefix)))


def _finding(rule: str, severity: str, field: str) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))


def _found(prefix: str) -> Column:
    return F.array_compact(F.array(*(F.when(r.fires, _finding(r.id, r.severity, r.field)) for r in catalogue() if r.id.startswith(prefix))))


def _placeholders_found() -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(v(f)).isin(*S.SENTINELS_VALIDATION), F.lit(f)) for f in S.SENTINEL_FIELDS)))


def _media_found() -> Column:
    """Media fields, of a corrected row that keeps its first values in ``_was``, whose URL an earlier one holds."""
    hit = lambda f: (F.col(f"_was.{f}") != "UNAVAILABLE") & (v(f) == "UNAVAILABLE") & _media_repeated_before(f)
    return F.array_compact(F.array(*(F.when(hit(f), F.lit(f)) for f in S.MEDIA_FIELDS[1:])))


def _late(rows: DataFrame, key: str, rule: str, fields: Column) -> DataFrame:
    return rows.select(F.col(key), F.lit(rule).alias("rule_id"), F.lit("warning").alias("severity"), F.explode(fields).alias("field"))


def placeholder_findings(pois: DataFrame, key: str = "GlobalID") -> DataFrame:
    """Placeholders in text fields; no earlier correction makes or removes one."""
    return _late(with_fields(pois), key, "GATE-SV1", _placeholders_found())


def media_findings(pois: DataFrame, key: str = "GlobalID") -> DataFrame:
    """URLs that an earlier media field holds, judged on corrected values."""
    judged = corrections(with_fields(pois).withColumn("_was", F.struct(*(F.col(f) for f in S.MEDIA_FIELDS))))
    return _late(judged, key, "GATE-DUP", _media_found())


def findings(pois: DataFrame, key: str = "GlobalID") -> DataFrame:
    """One row per finding: key, rule_id, severity, field; the table is scanned once."""
    return _judged(pois).select(F.col(key), F.inline(F.concat("_found", "_late")))


def _warnings(rule: str, fields: Column) -> Column:
    return F.transform(fields, lambda f: F.struct(F.lit(rule).alias("rule_id"), F.lit("warning").alias("severity"), f.alias("field")))


def _found_first(pois: DataFrame) -> DataFrame:
    """Corrected rows, but for repeated media, with their first media in ``_was`` and what rules and placeholders find in ``_found``."""
    full = with_fields(pois).withColumn("_was", F.struct(*(F.col(c) for c in S.MEDIA_FIELDS)))
    return _corrected(full.withColumn("_found", F.concat(_found("GATE-"), _warnings("GATE-SV1", _placeholders_found()))))


def _found_late(rows: DataFrame) -> DataFrame:
    return _media_corrected(rows).withColumn("_late", _warnings("GATE-DUP", _media_found()))


def _judged(pois: DataFrame) -> DataFrame:
    return _found_late(_found_first(pois))


def _media_repeated_before(field: str) -> Column:
    was = lambda f: text(F.col(f"_was.{f}"))
    before = S.MEDIA_FIELDS[: S.MEDIA_FIELDS.index(field)]
    return ~was(field).isin("", "UNAVAILABLE", "UNAPPLICABLE") & any_of([v(f) == was(field) for f in before])


def status(pois: DataFrame, key: str = "GlobalID") -> DataFrame:
    """key, status, blockers, warnings."""
    counts = findings(pois, key).groupBy(key).agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = pois.select(key).join(counts, key, "left").select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blockers", "warnings")))
    return rows.withColumn("status", F.when(F.col("blockers") > 0, "FAIL_BLOCKER").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


# Media that no two places may share.
OWN_MEDIA = ("Exterior_Photo_URL", "Interior_Photo_URL", "Video_URL")


def shared_media(pois: DataFrame, fields=OWN_MEDIA, key: str = "GlobalID") -> DataFrame:
    """key, field, url, others, names: media that other places use too, how often, and the names of the first three uses by key."""
    every = F.array(*(text(F.col(f)) for f in fields))
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), text(F.col(f)).alias("url")) for i, f in enumerate(fields)))
    urls = pois.select(key, F.coalesce("Name_EN", F.lit("")).alias("name"), every.alias("every"), F.explode(each).alias("u")).where(F.col("u.url").startswith("http"))
    urls = urls.select(key, "name", "u.*", F.size(F.filter("every", lambda x: x == F.col("u.url"))).alias("own"))
    counts = urls.groupBy("url").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("url", "n")
    # a place's own uses are no more than the fields
    place = F.row_number().over(Window.partitionBy("url").orderBy(key, "pos"))
    first = urls.withColumn("place", place).where(F.col("place") <= len(fields) + 3).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("place", F.col(key).alias("key"), "name"))).alias("first"))
    names = F.slice(F.filter("first", lambda x: x["key"] != F.col(key)), 1, 3)["name"]
    return urls.join(counts, "url").join(first, "url").select(key, "field", "url", (F.col("n") - F.col("own")).alias("others"), F.array_join(names, ", ").alias("names"))


def table_status(pois: DataFrame, key: str = "GlobalID") -> DataFrame:
    """key, status, blockers, warnings: as :func:`status`, which shared media do not change, with a warning for each of them."""
    shared = shared_media(pois, key=key).groupBy(key).agg(F.count("*").alias("shared"))
    return status(pois, key).join(shared, key, "left").select(key, "status", "blockers", (F.col("warnings") + F.coalesce("shared", F.lit(0))).alias("warnings"))


@dataclass(frozen=True)
class Constraint:
    """What a survey form asks of a field: bounds, a pattern, choices, all judged only where they are given.

    ``when`` names a field and the values of it for which the question is asked:
    then a ``required`` field must be filled, and otherwise it must be blank.
    """

    field: str
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    choices: tuple[str, ...] | None = None
    required: bool = False
    when: tuple[str, tuple[str, ...]] | None = None


def form_findings(pois: DataFrame, constraints: list[Constraint], key: str = "GlobalID") -> DataFrame:
    """key, field, problem (relevance, missing, number, bounds, pattern, choice): the first that a field has.  Fields that the table lacks are blank."""
    value = lambda f: v(f) if f in pois.columns else F.lit("")
    found = []
    for c in constraints:
        x, problem = value(c.field), F.lit(None).cast("string")
        filled = x != ""
        asked = value(c.when[0]).isin(*c.when[1]) if c.when else F.lit(True)
        if c.choices is not None:
            problem = F.when(filled & ~x.isin(*c.choices), "choice").otherwise(problem)
        if c.pattern is not None:
            problem = F.when(filled & ~x.rlike(f"^(?:{c.pattern})$"), "pattern").otherwise(problem)
        if c.least is not None or c.most is not None:
            n = number(x)
            out = (n < F.lit(c.least)) if c.least is not None else F.lit(False)
            out = out | ((n > F.lit(c.most)) if c.most is not None else F.lit(False))
            problem = F.when(filled & n.isNull(), "number").when(filled & out, "bounds").otherwise(problem)
        if c.required:
            problem = F.when(asked & ~filled, "missing").otherwise(problem)
        if c.when:
            problem = F.when(~asked & filled, "relevance").otherwise(problem)
        found.append(F.struct(F.lit(c.field).alias("field"), problem.alias("problem")))
    if not found:
        return pois.select(key, F.lit("").alias("field"), F.lit("").alias("problem")).where("false")
    return pois.select(F.col(key), F.inline(F.filter(F.array(*found), lambda f: f["problem"].isNotNull())))


def taxonomy_findings(pois: DataFrame, taxonomy: DataFrame, key: str = "GlobalID") -> DataFrame:
    """Findings against a table of valid category, subcategory and level3 (null where a level has none).

    An unknown category; a subcategory that its category, if it has any, lacks; a
    third level that its subcategory, if it has any, lacks.  Blank values, and
    levels below an unknown one, are not judged.
    """
    pois = pois.withColumns({c: F.lit("") for c in ("Subcategory", "Category_Level_3") if c not in pois.columns})
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    subs = taxonomy.groupBy(F.col("category").alias("_cat")).agg(F.collect_set(F.when(given("subcategory"), F.col("subcategory"))).alias("_subs"))
    thirds = taxonomy.where(given("subcategory")).groupBy(F.col("category").alias("_cat"), F.col("subcategory").alias("_sub")).agg(F.collect_set(F.when(given("level3"), F.col("level3"))).alias("_thirds"))
    at = {"_cat": v("Category"), "_sub": v("Subcategory"), "_third": v("Category_Level_3")}
    rows = pois.select(F.col(key), *(c.alias(n) for n, c in at.items())).join(subs, "_cat", "left").join(thirds, ["_cat", "_sub"], "left")
    # each table has the rows of a taxonomy, whose places do not make it grow
    many = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    known = F.col("_subs").isNotNull()
    found = F.array_compact(F.array(
        F.when((F.col("_cat") != "") & ~known, _finding("GATE-E4", "warning", "Category")),
        F.when(known & (F.col("_sub") != "") & many("_subs") & ~F.array_contains("_subs", F.col("_sub")), _finding("GATE-E5", "warning", "Subcategory")),
        F.when(known & (F.col("_sub") != "") & (F.col("_third") != "") & many("_thirds") & ~F.array_contains("_thirds", F.col("_third")), _finding("GATE-E6", "warning", "Category_Level_3")),
    ))
    return rows.select(key, F.inline(found))


@dataclass(frozen=True)
class Validated:
    """What a pass over a table found; everything is read from what that pass wrote.

    ``rows``: key, was and now (the row before and after corrections), findings
    (rule_id, severity, field), blockers, warnings, fixes (the fields that change).
    ``totals``: total, with_issues, blockers, warnings, fixable, flagged.
    """

    rows: DataFrame
    totals: dict[str, int]
    key: str

    def findings(self) -> DataFrame:
        return self.rows.select(self.key, F.inline("findings"))

    def issues(self, most: int = 500) -> DataFrame:
        """The first places by key that have findings, with their status and numbers."""
        status = F.when(F.col("blockers") > 0, "FAIL_BLOCKER").otherwise("PASS_WITH_WARNINGS")
        rows = self.rows.where((F.col("blockers") > 0) | (F.col("warnings") > 0))
        # as the original: what other places do leaves the status as it is
        alone = F.when((F.col("blockers") == 0) & ~F.exists("findings", lambda f: f["rule_id"] != "CROSS-M3"), "PASS").otherwise(status)
        return rows.select(self.key, F.coalesce("was.Name_EN", F.lit("")).alias("Name_EN"), alone.alias("status"), "blockers", "warnings", F.size("fixes").cast("long").alias("fixes_available")).orderBy(self.key).limit(most)

    def table(self, apply_fixes: bool = False, flag_violations: bool = False) -> DataFrame:
        """The table after what was asked for: corrected values, and flags with a reason for places with blockers."""
        names = [c for c in self.rows.schema["was"].dataType.names if not c.startswith("_absent_")]
        chosen = {c: F.col(f"{'now' if apply_fixes else 'was'}.{c}") for c in names}
        if flag_violations:
            ids = F.transform(F.filter("findings", lambda f: f["severity"] == "blocker"), lambda f: f["rule_id"])
            reason = F.substring(F.concat(F.lit("Auto-validation: "), F.col("blockers").cast("string"), F.lit(" blocker(s) - "), F.array_join(F.slice(ids, 1, 3), "; ")), 1, 200)
            hit = F.col("blockers") > 0
            chosen["flagged"] = F.when(hit, F.lit(True)).otherwise(chosen.get("flagged", F.lit(None).cast("boolean")))
            chosen["flag_reason"] = F.when(hit, reason).otherwise(chosen.get("flag_reason", F.lit(None).cast("string")))
        return self.rows.select(*(c.alias(n) for n, c in chosen.items()))


def validate_table(pois: DataFrame, key: str = "GlobalID") -> Validated:
    """All rules over a table that is scanned once: row by row, then what corrections repeat, then media that places share.

    Null and empty values are judged by the rules; an empty table has totals of 0;
    rows that repeat a key are judged each, and shared media are those of other keys.
    """
    names = pois.columns
    was = F.struct(*(F.col(c) for c in names), *(F.col(c).alias(f"_absent_{c}") for c in S.MEDIA_FIELDS if c not in names))
    local = written(_found_first(with_fields(pois).withColumn("_row", was)), "validated")
    late = _found_late(local)
    owned = local.select(F.col(key), F.col("_row.Name_EN").alias("Name_EN") if "Name_EN" in names else F.lit("").alias("Name_EN"), *(F.col(f"_was.{f}").alias(f) for f in OWN_MEDIA))
    shared = shared_media(owned, key=key).select(key, F.struct(F.lit("CROSS-M3").alias("rule_id"), F.lit("warning").alias("severity"), "field").alias("f")).groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("_shared"))
    none = F.array().cast("array<struct<rule_id:string,severity:string,field:string>>")
    found = late.join(shared, key, "left").select(
        key, F.col("_row").alias("was"), F.struct(*(F.col(c) for c in names)).alias("now"), F.concat("_found", "_late", F.coalesce("_shared", none)).alias("findings"),
    )
    count = lambda severity: F.size(F.filter("findings", lambda f: f["severity"] == severity)).cast("long")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")) & F.col(f"now.{c}").isNotNull(), F.lit(c)) for c in names)))
    judged = found.withColumns({"blockers": count("blocker"), "warnings": count("warning"), "fixes": differs})
    seen = Observation()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    has = lambda c: total(c.cast("int"))
    judged = judged.observe(
        seen, F.count(F.lit(1)).alias("total"), has((F.col("blockers") > 0) | (F.col("warnings") > 0)).alias("with_issues"), total(F.col("blockers")).alias("blockers"),
        total(F.col("warnings")).alias("warnings"), has(F.size("fixes") > 0).alias("fixable"), has(F.col("blockers") > 0).alias("flagged"),
    )
    return Validated(written(judged, "validated"), seen.get, key)


def approval_blockers(pois: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """GlobalID, reasons: why a place can't be approved; counts (GlobalID, blockers), as :func:`status` gives them, add theirs."""
    if counts is not None:
        pois = pois.join(counts.select("GlobalID", F.col("blockers").alias("_blockers")), "GlobalID", "left")
    failed = F.lit(None).cast("string") if counts is None else F.when(F.col("_blockers") > 0, F.concat(F.lit("validation:"), F.col("_blockers").cast("string")))
    lat, lon = number(F.col("Latitude")), number(F.col("Longitude"))
    found = F.array_compact(F.array(
        F.when(F.col("Review_Status").isin("Rejected", "Archived"), F.concat(F.lit("status:"), F.col("Review_Status"))),
        *(F.when(is_blank(F.col(f), "queue"), F.lit(f"missing:{f}")) for f in S.REQUIRED),
        F.when(~is_blank(F.col("Latitude"), "queue") & ~is_blank(F.col("Longitude"), "queue"), F.when(lat.isNull() | lon.isNull(), F.lit("coordinates:invalid")).when((lat == 0) & (lon == 0), F.lit("coordinates:zero"))),
        F.when(F.coalesce("flagged", F.lit(False)), F.lit("flagged")),
        failed,
        F.when(number(F.col("QA_Score")).cast("int") < 95, F.lit("qa_score")),
    ))
    return pois.select("GlobalID", found.alias("reasons"))
