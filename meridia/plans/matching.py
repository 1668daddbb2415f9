"""Normalisers, similarities and entity resolution as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geo
from ..functions import text as X
from ..operators import resolve as R
from .registry import Register

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def _unless(c: str, value: str) -> str:
    return f"CASE WHEN lower({_trim(c)}) IN ('', {_list(S.SENTINELS_MATCHING)}) THEN '' ELSE {value} END"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _no_suffix(c: str) -> str:
    dotted, plain = "|".join(S.EN_SUFFIXES_WITH_DOT), "|".join(S.EN_SUFFIXES)
    return f"regexp_replace(lower({_trim(c)}), '\\b(?:(?:{dotted})\\.?|{plain})\\b', '', 'g')"


def _arabic(c: str) -> str:
    out = f"translate(regexp_replace({_trim(c)}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), '{S.AR_LETTERS[0]}', '{S.AR_LETTERS[1]}')"
    for words in (S.AR_SUFFIXES, S.AR_CATEGORY_WORDS):
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            out = f"replace({out}, '{w}', '')"
    return _unless(c, _squeeze(f"regexp_replace({out}, '[^0-9A-Za-z_\\s\\x{{0600}}-\\x{{06FF}}]', '', 'g')"))


EN = _unless("Name_EN", _squeeze(f"regexp_replace(array_to_string(list_filter(regexp_split_to_array({_no_suffix('Name_EN')}, '\\s+'), lambda w: w <> '' AND w NOT IN ({_list(S.EN_CATEGORY_WORDS)})), ' '), '[^0-9A-Za-z_\\s]', '', 'g')"))
AR = _arabic("Name_AR")
BRAND = f"list_filter(regexp_split_to_array(regexp_replace({_no_suffix('Name_EN')}, '[^0-9A-Za-z_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_list((*S.EN_CATEGORY_WORDS, *S.EN_STOPWORDS))}))"
_DIGITS = f"ltrim(ltrim(regexp_replace({_trim('Phone_Number')}, '[^0-9]', '', 'g'), '96'), '0')"
PHONE = _unless("Phone_Number", f"CASE WHEN length({_DIGITS}) >= 7 THEN substr({_DIGITS}, 1, 9) ELSE '' END")
LICENCE = _unless("Commercial_License", f"regexp_replace({_trim('Commercial_License')}, '[^0-9]', '', 'g')")
DOMAIN = _unless("Website", f"split_part(split_part(regexp_replace(regexp_replace(lower({_trim('Website')}), '^https?://', ''), '^www\\.', ''), '/', 1), '?', 1)")
_RULES = sorted(S.TRANSLITERATION, key=lambda k: (-len(k), k))


def _translit(c: str) -> str:
    table = ", ".join(f"'{k}': '{S.TRANSLITERATION[k]}'" for k in _RULES)
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '({'|'.join(_RULES)}| )'), lambda p: MAP {{{table}, ' ': ' '}}[p]), '')"


def _grams(c: str) -> str:
    return f"CASE WHEN length({c}) >= 2 THEN list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) ELSE [{c}] END"


def _dice(x: str, y: str) -> str:
    """Over columns of the pair table that hold texts without spaces and their character pairs."""
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE WHEN length({x}) < 2 OR length({y}) < 2 THEN CASE WHEN {x} = {y} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect({x}_g, {y}_g)) * 2.0::DOUBLE / (len({x}_g) + len({y}_g)) * 100 END"


def _number(c: str) -> str:
    return f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0::DOUBLE)"


PLACES = f"""
, p0 AS (SELECT GlobalID AS gid, {_number('Latitude')} AS lat, {_number('Longitude')} AS lon, Name_EN AS name, {_trim('Category')} AS category, {EN} AS en, {AR} AS ar, {BRAND} AS brand,
    {PHONE} AS phone, {LICENCE} AS licence, {DOMAIN} AS domain, {_unless('Google_Map_URL', _trim('Google_Map_URL'))} AS map, coalesce(Building_Number, '') || '|' || coalesce(Floor_Number, '') AS address FROM poi),
p1 AS (SELECT *, {_translit('en')} AS en_ar, CASE WHEN phone = '' THEN 0 ELSE count(*) OVER (PARTITION BY phone) END AS phone_n, CASE WHEN licence = '' THEN 0 ELSE count(*) OVER (PARTITION BY licence) END AS licence_n,
    replace(en, ' ', '') AS xen, replace(ar, ' ', '') AS xar FROM p0),
p2 AS (SELECT *, replace(en_ar, ' ', '') AS xtr FROM p1),
p AS (SELECT *, {_grams('xen')} AS xen_g, {_grams('xar')} AS xar_g, {_grams('xtr')} AS xtr_g FROM p2 WHERE lat <> 0 OR lon <> 0)"""

_COLS = "gid lat lon name category en ar brand phone licence domain map address en_ar phone_n licence_n xen xar xtr xen_g xar_g xtr_g".split()
_HAV = "2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * power(sin(radians(b_lon - a_lon) / 2), 2))))"
PAIRS = f""",
a AS (SELECT {', '.join(f'{c} AS a_{c}' for c in _COLS)}, CAST(trunc(lat / 0.001::DOUBLE) AS INT) + i AS cx, CAST(trunc(lon / 0.001::DOUBLE) AS INT) + j AS cy, i AS dl, j AS dm FROM p, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j)),
b AS (SELECT {', '.join(f'{c} AS b_{c}' for c in _COLS)}, CAST(trunc(lat / 0.001::DOUBLE) AS INT) AS cx, CAST(trunc(lon / 0.001::DOUBLE) AS INT) AS cy FROM p),
q0 AS (SELECT *, {_HAV} AS m FROM a JOIN b USING (cx, cy) WHERE b_gid > a_gid),
q AS (SELECT * FROM q0 WHERE m <= 100)"""

_FAM = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CATEGORY_FAMILY.items()) + " END"


def _pairs_in(table: dict) -> str:
    return _list(sorted("|".join(sorted((k, v))) for k, vs in table.items() for v in vs))


_A, _Bf = _FAM.format(c="a_category"), _FAM.format(c="b_category")
_KEY = f"least({_A}, {_Bf}) || '|' || greatest({_A}, {_Bf})"
AGREE = f"CASE WHEN a_category = '' OR b_category = '' THEN 'unknown' WHEN lower(a_category) = lower(b_category) THEN 'same' WHEN {_A} IS NULL OR {_Bf} IS NULL THEN 'unknown' WHEN {_A} = {_Bf} THEN 'compatible' WHEN {_KEY} IN ({_pairs_in(S.NEVER_THE_SAME)}) THEN 'hard_reject' WHEN {_KEY} IN ({_pairs_in(S.RELATED)}) THEN 'compatible' ELSE 'incompatible' END"
_BRANDSIM = """CASE WHEN len(a_brand) = 0 OR len(b_brand) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(a_brand), list_distinct(b_brand))) * 100.0::DOUBLE / len(list_distinct(list_concat(a_brand, b_brand)))
    * CASE WHEN len(list_intersect(list_distinct(a_brand), list_distinct(b_brand))) = len(list_distinct(CASE WHEN len(a_brand) <= len(b_brand) THEN a_brand ELSE b_brand END))
        AND least(len(a_brand), len(b_brand)) * 1.0::DOUBLE / greatest(len(a_brand), len(b_brand)) < 0.5 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END END"""
SCORES = f""",
s0 AS (SELECT *, {AGREE} AS agree, {_BRANDSIM} AS brandsim, CASE WHEN m <= 10 THEN 100.0::DOUBLE WHEN m <= 25 THEN 90.0::DOUBLE WHEN m <= 50 THEN 75.0::DOUBLE WHEN m <= 100 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS dist,
    list_filter([CASE WHEN a_licence <> '' AND b_licence <> '' THEN CASE WHEN a_licence = b_licence THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END, CASE WHEN a_domain <> '' AND b_domain <> '' THEN CASE WHEN a_domain = b_domain THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END,
        CASE WHEN a_map <> '' AND b_map <> '' THEN CASE WHEN a_map = b_map THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END, CASE WHEN a_address <> '|' AND b_address <> '|' THEN CASE WHEN a_address = b_address THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END], lambda x: x IS NOT NULL) AS signals,
    a_phone <> '' AND a_phone = b_phone AS same_phone, a_licence <> '' AND a_licence = b_licence AS same_licence, a_domain <> '' AND a_domain = b_domain AS same_domain FROM q),
s1 AS (SELECT *, coalesce(greatest(CASE WHEN a_en <> '' AND b_en <> '' THEN {_dice('a_xen', 'b_xen')} END, CASE WHEN a_en <> '' AND b_en <> '' AND brandsim > 0 THEN brandsim END, CASE WHEN a_ar <> '' AND b_ar <> '' THEN {_dice('a_xar', 'b_xar')} END,
        CASE WHEN a_en_ar <> '' AND b_ar <> '' THEN {_dice('a_xtr', 'b_xar')} END, CASE WHEN b_en_ar <> '' AND a_ar <> '' THEN {_dice('b_xtr', 'a_xar')} END), 0.0::DOUBLE) AS sim,
    CASE WHEN len(signals) > 0 THEN list_sum(signals) / len(signals) ELSE 0.0::DOUBLE END AS aux, same_phone AND greatest(a_phone_n, b_phone_n) >= 3 AS shared_phone, same_licence AND greatest(a_licence_n, b_licence_n) < 3 AS own_licence,
    same_phone AND m <= 50 AS near_phone, same_domain AND m <= 100 AS near_domain, agree IN ('incompatible', 'hard_reject') AS conflict, agree = 'hard_reject' AS never FROM s0),
s2 AS (SELECT *, same_phone AND NOT shared_phone AS own_phone, CASE WHEN shared_phone THEN 30.0::DOUBLE WHEN same_phone THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS phone_sc, sim >= 60 OR (same_phone AND NOT shared_phone) OR aux >= 50 AS identified,
    CASE agree WHEN 'same' THEN 100.0::DOUBLE WHEN 'compatible' THEN 60.0::DOUBLE WHEN 'unknown' THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS cat_sc FROM s1),
s3 AS (SELECT *, 0.50::DOUBLE * sim + 0.15::DOUBLE * CASE WHEN identified THEN dist ELSE dist * 0.3::DOUBLE END + 0.15::DOUBLE * cat_sc + 0.15::DOUBLE * phone_sc + 0.05::DOUBLE * aux AS f0 FROM s2),
s4 AS (SELECT *, CASE WHEN own_licence THEN greatest(f0, CASE WHEN conflict THEN 70.0::DOUBLE ELSE 90.0::DOUBLE END) ELSE f0 END AS f1 FROM s3),
s5 AS (SELECT *, CASE WHEN near_phone AND own_phone AND NOT conflict THEN greatest(f1, CASE WHEN sim >= 40 THEN 85.0::DOUBLE ELSE 75.0::DOUBLE END) ELSE f1 END AS f2 FROM s4),
s6 AS (SELECT *, CASE WHEN near_domain AND NOT conflict THEN greatest(f2, 85.0::DOUBLE) ELSE f2 END AS f3 FROM s5),
s7 AS (SELECT *, CASE WHEN conflict THEN f3 * CASE WHEN sim < 85 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END ELSE f3 END AS f4 FROM s6),
s8 AS (SELECT *, CASE WHEN m <= 20 AND sim >= 90 AND agree IN ('same', 'compatible') THEN greatest(f4, 92.0::DOUBLE) ELSE f4 END AS f5 FROM s7),
s9 AS (SELECT *, CASE WHEN never THEN 0.0::DOUBLE WHEN own_phone AND m <= 30 AND NOT conflict AND sim >= 60 THEN greatest(f5, 88.0::DOUBLE) ELSE f5 END AS final, NOT never AND (own_licence OR near_phone OR near_domain) AS tier1 FROM s8)"""
FULL = PLACES + PAIRS + SCORES


@query("str_01", "poi", sql=f"SELECT GlobalID, {AR} AS ar FROM poi")
def arabic_names(poi):
    return poi.select("GlobalID", X.normalize_arabic(F.col("Name_AR")).alias("ar"))


@query("str_02", "poi", sql=f"SELECT GlobalID, {EN} AS en FROM poi")
def english_names(poi):
    return poi.select("GlobalID", X.normalize_english(F.col("Name_EN")).alias("en"))


@query("str_03", "poi", sql=f"SELECT GlobalID, array_to_string({BRAND}, ' ') AS brand FROM poi")
def brand_cores(poi):
    return poi.select("GlobalID", F.array_join(X.brand_words(F.col("Name_EN")), " ").alias("brand"))


@query("str_04", "poi", sql=f"SELECT GlobalID, {PHONE} AS phone FROM poi")
def phones(poi):
    return poi.select("GlobalID", X.normalize_phone(F.col("Phone_Number")).alias("phone"))


@query("str_05", "poi", sql=f"SELECT GlobalID, {LICENCE} AS licence FROM poi")
def licences(poi):
    return poi.select("GlobalID", X.normalize_license(F.col("Commercial_License")).alias("licence"))


@query("str_06", "poi", sql=f"SELECT GlobalID, {DOMAIN} AS domain FROM poi")
def domains(poi):
    return poi.select("GlobalID", X.website_domain(F.col("Website")).alias("domain"))


@query("str_07", "poi", sql=f"SELECT GlobalID, {_translit('coalesce(Name_EN, chr(32))')} AS ar FROM poi")
def transliterations(poi):
    return poi.select("GlobalID", X.transliterate(F.coalesce("Name_EN", F.lit(" "))).alias("ar"))


@query("str_08", "customer", sql=f"""
WITH t AS (SELECT c_custkey, replace(c_mktsegment, ' ', '') AS x, replace(c_name, ' ', '') AS y FROM customer), g AS (SELECT *, {_grams('x')} AS x_g, {_grams('y')} AS y_g FROM t)
SELECT c_custkey, round({_dice('x', 'y')}, 6) AS dice FROM g""")
def dice(customer):
    return customer.select("c_custkey", F.round(X.dice(F.col("c_mktsegment"), F.col("c_name")), 6).alias("dice"))


@query("join_02", "poi", sql=PLACES + " SELECT gid, phone_n, licence_n FROM p1")
def frequencies(poi):
    return R.prepare(poi).select("gid", "phone_n", "licence_n")


@query("join_01", "poi", sql=PLACES + PAIRS + " SELECT a_gid AS a, b_gid AS b, round(m, 1) AS distance_m FROM q")
def spatial_pairs(poi):
    places = R.prepare(poi).where("lat <> 0 or lon <> 0").select("pos", "gid", "lat", "lon")
    return geo.near_pairs(places, 100.0).select(F.col("a_gid").alias("a"), F.col("b_gid").alias("b"), F.round("distance_m", 1).alias("distance_m"))


@query("er_07", "poi", sql=PLACES + PAIRS + f" SELECT a_gid AS a, b_gid AS b, {AGREE} AS agreement FROM q")
def agreements(poi):
    places = R.prepare(poi).where("lat <> 0 or lon <> 0").select("pos", "gid", "lat", "lon", "category")
    pairs = R.pairs_with(places, ("category",), 100.0, agreement=R.category_agreement(F.col("a_category"), F.col("b_category")))
    return pairs.select(F.col("a_gid").alias("a"), F.col("b_gid").alias("b"), "agreement")


@query("er_score", "poi", sql=FULL + """ SELECT a_gid AS source_gid, b_gid AS candidate_gid, round(sim, 1) AS name_score, round(dist, 1) AS distance_score, round(cat_sc, 1) AS category_score,
    round(CASE WHEN never THEN CASE WHEN same_phone THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE phone_sc END, 1) AS phone_score, round(aux, 1) AS auxiliary_score, round(final, 1) AS final_score,
    CASE WHEN final >= 85 THEN 'MATCH' WHEN final >= 70 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_status, round(m, 1) AS distance_m, tier1 AS tier1_match FROM s9""")
def scores(poi):
    return R.score_rows(poi, "source_gid", "candidate_gid", "name_score", "distance_score", "category_score", "phone_score", "auxiliary_score", "final_score", "match_status", "distance_m", "tier1_match")


@query("er_edges", "poi", sql=FULL + " SELECT a_gid AS a, b_gid AS b FROM s9 WHERE round(final, 1) >= 70")
def edges(poi):
    pairs = R.score_rows(poi, "source_gid", "candidate_gid", qualifying=(S.MATCH, S.POSSIBLE, True))
    return pairs.select(F.col("source_gid").alias("a"), F.col("candidate_gid").alias("b"))


@query("er_14", "poi", sql=FULL + " SELECT CASE WHEN final >= 85 THEN 'MATCH' WHEN final >= 70 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_status, count(*) AS n FROM s9 GROUP BY 1")
def by_status(poi):
    return R.score_counts(poi).groupBy("match_status").agg(F.sum("n").alias("n"))


_PERCENT = lambda c: f"CAST(CAST(round({c}) AS INTEGER) AS VARCHAR)"
REASONS = f"""CASE WHEN never THEN 'hard_reject_category_family,category_mismatch' ELSE array_to_string(list_filter([
    CASE WHEN shared_phone THEN 'phone_shared_freq_' || greatest(a_phone_n, b_phone_n) END, CASE WHEN NOT identified AND dist > 0 THEN 'distance_gated_weak_identity' END,
    CASE WHEN same_licence AND greatest(a_licence_n, b_licence_n) >= 3 THEN 'license_shared_freq_' || greatest(a_licence_n, b_licence_n) END,
    CASE WHEN conflict THEN CASE WHEN sim < 85 THEN 'contradiction_category_name' ELSE 'category_conflict_penalty' END END,
    CASE WHEN sim >= 90 THEN 'name_' || {_PERCENT('sim')} || 'pct' WHEN sim >= 75 THEN 'name_fuzzy_' || {_PERCENT('sim')} || 'pct' END,
    CASE WHEN own_phone THEN 'phone_exact' WHEN shared_phone THEN 'phone_exact_shared' END, CASE WHEN own_licence THEN 'tier1_license_exact' END, CASE WHEN near_phone THEN 'tier1_phone_exact_near' END, CASE WHEN near_domain THEN 'tier1_website_domain' END,
    CASE WHEN agree = 'same' THEN 'same_category' WHEN agree = 'compatible' THEN 'compatible_category' WHEN conflict THEN 'category_mismatch' END,
    CASE WHEN aux > 0 THEN 'aux_' || {_PERCENT('aux')} END], lambda x: x IS NOT NULL), ',') END"""


@query("er_reasons", "poi", sql=FULL + f" SELECT a_gid AS source_gid, b_gid AS candidate_gid, {REASONS} AS reasons FROM s9")
def reasons(poi):
    return R.score_rows(poi, "source_gid", "candidate_gid", "match_reasons").withColumnRenamed("match_reasons", "reasons")


GROUPS = FULL + """,
e AS MATERIALIZED (SELECT a_gid AS a, b_gid AS b, round(final, 1) AS final_score, CASE WHEN final >= 85 THEN 'MATCH' WHEN final >= 70 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_status, dl, dm FROM s9 WHERE round(final, 1) >= 70),
n AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT a AS v FROM e UNION SELECT b FROM e)),
l AS MATERIALIZED (SELECT n.i, list(m.i ORDER BY m.i) AS larger FROM e JOIN n ON n.v = e.a JOIN n m ON m.v = e.b GROUP BY n.i),
r AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS took
    UNION ALL
    SELECT i, list_concat(used, t), t FROM (
        SELECT r.i + 1 AS i, r.used, CASE WHEN l.i IS NULL OR list_contains(r.used, r.i + 1) THEN CAST([] AS BIGINT[]) ELSE list_filter(l.larger, lambda y: NOT list_contains(r.used, y)) END AS t
        FROM r LEFT JOIN l ON l.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM n))),
g AS (SELECT i, unnest(took) AS j FROM r),
grouped AS (SELECT a AS anchor, b AS member, row_number() OVER (PARTITION BY a ORDER BY dl, dm, b) AS place, final_score, match_status FROM g JOIN n ON n.i = g.i JOIN n m ON m.i = g.j JOIN e ON e.a = n.v AND e.b = m.v)"""


@query("er_groups", "poi", sql=GROUPS + " SELECT anchor, member, CAST(place AS INTEGER) AS place, final_score, match_status FROM grouped")
def groups(poi):
    return R.detect(poi, keep=("final_score", "match_status")).select("anchor", "member", "place", "final_score", "match_status")


@query("er_golden", "poi")
def golden(poi):
    found = R.detect(poi, keep=()).select("anchor", "member", "place")
    return R.golden_records(poi, found).select("GlobalID", "Phone_Number", "Website", "Exterior_Photo_URL", F.array_join("removed", ",").alias("removed"))


@query("fuzzy_indel", "poi")
def indel(poi):
    return R.score_rows(poi, "source_gid", "candidate_gid", "name_score", "final_score", "match_status", metric="indel")

# the scan of the greedy groups goes node by node
ORACLES["er_groups"] = ORACLES["er_groups"].replace("WITH ", "WITH RECURSIVE ", 1)
