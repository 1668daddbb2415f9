"""Review life cycle: transitions, versioned updates with audit rows, upserts, drafts and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.values import is_blank

SYSTEM_FIELDS = ("GlobalID", "review_version", "created_at", "updated_at")


def may_move(status: Column, target: Column) -> Column:
    """Whether a status may follow; unknown statuses count as none, a blank target changes nothing."""
    table = F.create_map(*(x for k, vs in S.TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, vs)) if vs else F.array().cast("array<string>"))))
    known = F.when(F.coalesce(status, F.lit("")).isin(*S.TRANSITIONS), F.coalesce(status, F.lit(""))).otherwise(F.lit(""))
    return is_blank(target) | F.array_contains(F.element_at(table, known), target)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def changed_fields(old: str, new: str, fields: list[str]) -> Column:
    """array<struct<field, old, new>> of fields that a change names (not null) and that differ as text; null equals ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.array_compact(F.array(*(
        F.when(F.col(f"{new}.{f}").isNotNull() & (text(f"{old}.{f}") != text(f"{new}.{f}")), F.struct(F.lit(f).alias("field"), text(f"{old}.{f}").alias("old"), text(f"{new}.{f}").alias("new"))) for f in fields
    )))


def apply_updates(base: DataFrame, updates: DataFrame, strict: bool = True, key: str = "GlobalID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new base, audit rows, conflicts) for one update per key.

    updates: key, review_version, reviewer, and any fields of the base; null means
    "leave".  In strict mode an update with another version or with a status that
    may not follow is a conflict.  A reviewed place whose major fields change goes
    back to Draft, unless the update sets a status.  Updates for unknown keys are
    conflicts.  ``strict=False`` checks nothing, keeps no audit and reverts when a
    major field is named at all.
    """
    fields = [c for c in updates.columns if c in base.columns and c not in SYSTEM_FIELDS]
    u, b = updates.alias("u"), base.alias("b")
    joined = u.join(b, F.col(f"u.{key}") == F.col(f"b.{key}"), "left").select(F.struct("u.*").alias("u"), F.struct("b.*").alias("b"))
    target = F.col("u.Review_Status") if "Review_Status" in fields else F.lit(None).cast("string")
    reason = F.when(F.col(f"b.{key}").isNull(), "unknown")
    if strict:
        reason = reason.when(~F.col("u.review_version").eqNullSafe(F.col("b.review_version")), "version").when(~may_move(F.col("b.Review_Status"), target), "transition")
    judged = joined.withColumn("conflict", reason).withColumn("changes", changed_fields("b", "u", fields))
    conflicts = judged.where("conflict is not null").select(F.col(f"u.{key}").alias(key), "conflict", F.col("u.review_version").alias("sent_version"), F.col("b.review_version").alias("current_version"))
    major = [f for f in fields if f not in S.MINOR_FIELDS]
    touched = F.exists("changes", lambda c: c["field"].isin(*major)) if strict else F.lit(False) if not major else F.coalesce(*(F.col(f"u.{f}").cast("string") for f in major)).isNotNull()
    reverts = is_blank(target) & (F.col("b.Review_Status") == "Reviewed") & touched
    good = judged.where("conflict is null").withColumn("reverts", F.coalesce(reverts, F.lit(False)))

    def value(c: str) -> Column:
        own = F.col(f"b.{c}")
        if c == "review_version":
            return (F.coalesce(own, F.lit(0)) + 1).cast(base.schema[c].dataType).alias(c)
        if c in fields:
            own = F.coalesce(F.col(f"u.{c}"), own)
        if c == "Review_Status":
            own = F.when(F.col("reverts"), F.lit("Draft")).otherwise(own)
        if c == "draft_reason":
            own = F.when(F.col("reverts"), F.lit("modified")).otherwise(own)
        return own.alias(c)

    fresh = good.select(*(value(c) for c in base.columns))
    kept = base.join(fresh.select(key), key, "left_anti").select(*base.columns)
    audit = good.select(F.col(f"u.{key}").alias(key), F.col("u.reviewer").alias("reviewer") if "reviewer" in updates.columns else F.lit(None).cast("string").alias("reviewer"), F.lit("edit").alias("action"), F.inline("changes")) if strict else good.sparkSession.createDataFrame([], f"{key} string, reviewer string, action string, field string, old string, new string")
    return kept.unionByName(fresh), audit, conflicts


def upsert(base: DataFrame, rows: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows replace those with their keys; nulls, and the columns of ``keep_old``, leave what was there."""
    b, r = base.alias("b"), rows.alias("r")
    on = [F.col(f"b.{k}") == F.col(f"r.{k}") for k in keys]
    both = b.join(r, on, "full")

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"b.{c}")
        pair = (F.col(f"b.{c}"), F.col(f"r.{c}"))
        return F.coalesce(*(pair if c in keep_old or c in keys else pair[::-1]))

    return both.select(*(value(c).alias(c) for c in base.columns))


def aligned(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Only the columns that the target has; those it lacks become null."""
    return rows.select(*(F.col(c).cast(target.schema[c].dataType) if c in rows.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def reject(pois: DataFrame, ids: DataFrame, reason: str, key: str = "GlobalID") -> DataFrame:
    """Status Rejected with a reason, which must not be blank; places that are rejected already keep theirs."""
    if not reason.strip():
        raise ValueError("a reason is required")
    hit = pois.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    now = F.coalesce("_hit", F.lit(False)) & ~F.coalesce(F.col("Review_Status") == "Rejected", F.lit(False))
    return hit.withColumn("rejected_reason", F.when(now, reason).otherwise(F.col("rejected_reason"))).withColumn("Review_Status", F.when(now, "Rejected").otherwise(F.col("Review_Status"))).select(*pois.columns)


def archive(pois: DataFrame, ids: DataFrame, reason: str = "", key: str = "GlobalID") -> DataFrame:
    hit = pois.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.withColumn("archived_reason", F.when(F.col("_hit"), reason).otherwise(F.col("archived_reason"))).withColumn("Review_Status", F.when(F.col("_hit"), "Archived").otherwise(F.col("Review_Status"))).select(*pois.columns)


def delete(pois: DataFrame, ids: DataFrame, key: str = "GlobalID") -> DataFrame:
    return pois.join(ids.select(key).distinct(), key, "left_anti").select(*pois.columns)


def migrate_categories(pois: DataFrame, by_category: dict[str, tuple[str, str]], by_both: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """+ new_category, new_subcategory: the pair's own entry, else the category's, else as they are; blank categories stay."""
    pair = F.create_map(*(x for (c, s), (nc, ns) in by_both.items() for x in (F.lit(f"{c}>{s}"), F.struct(F.lit(nc).alias("c"), F.lit(ns).alias("s")))))
    one = F.create_map(*(x for c, (nc, ns) in by_category.items() for x in (F.lit(c), F.struct(F.lit(nc).alias("c"), F.lit(ns).alias("s")))))
    sub = F.coalesce(F.col("Subcategory"), F.lit(""))
    found = F.coalesce(F.try_element_at(pair, F.concat(F.col("Category"), F.lit(">"), sub)), F.try_element_at(one, F.col("Category")))
    blank = is_blank(F.col("Category"))
    return pois.withColumn("new_category", F.when(blank, F.col("Category")).otherwise(F.coalesce(found["c"], F.col("Category")))).withColumn("new_subcategory", F.when(blank, sub).otherwise(F.coalesce(found["s"], sub)))


def with_lifecycle_columns(pois: DataFrame) -> DataFrame:
    """Adds the life-cycle columns that are absent, and the defaults that follow from older statuses."""
    kinds = {"flagged": "boolean", "flag_reason": "string", "draft_reason": "string", "archived_reason": "string", "rejected_reason": "string", "last_reviewed_at": "timestamp_ntz", "last_reviewed_by": "string", "review_version": "int"}
    out = pois.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in pois.columns})
    was_flag = F.coalesce(F.col("Review_Status") == "Flagged", F.lit(False))
    out = out.withColumn("flagged", F.coalesce(F.col("flagged"), F.lit(False)) | was_flag).withColumn("Review_Status", F.when(was_flag, "Draft").otherwise(F.col("Review_Status"))).withColumn("review_version", F.coalesce("review_version", F.lit(0)))
    return out.withColumn("draft_reason", F.when((F.col("Review_Status") == "Draft") & is_blank(F.col("draft_reason")), "new").otherwise(F.col("draft_reason")))


def quick_check(drafts: DataFrame) -> DataFrame:
    """+ QA_Blockers, QA_Warnings of imported drafts."""
    from ..functions.values import number

    n = lambda c: c.cast("int")
    short = lambda c: F.length(F.coalesce(F.trim(F.col(c)), F.lit(""))) < 2
    lat, lon = number(F.col("Latitude")), number(F.col("Longitude"))
    place = F.when(lat.isNull() | lon.isNull(), 1).otherwise(n(~lat.between(15, 35)) + n(~lon.between(35, 60)))
    return drafts.withColumn("QA_Blockers", n(short("Name_AR")) + n(short("Name_EN")) + n(is_blank(F.col("Category"))) + place).withColumn("QA_Warnings", n(is_blank(F.col("Phone_Number"))) + n(is_blank(F.col("Website"))))


def confirm_drafts(drafts: DataFrame, pois: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to add to the places, drafts refused for their name); only pending drafts are looked at."""
    pending = drafts.where(F.coalesce("Draft_Status", F.lit("pending")) == "pending")
    if force:
        good, refused = pending, pending.where("false")
    else:
        names = pois.select(F.col("Name_EN").alias("_name")).where("_name is not null and _name <> ''").distinct()
        good = pending.join(names, pending.Name_EN == names._name, "left_anti")
        refused = pending.join(names, pending.Name_EN == names._name, "left_semi")
    ready = good.withColumn("Review_Status", F.lit("Draft")).withColumn("draft_reason", F.lit("imported")).withColumn("review_version", F.lit(0))
    return aligned(ready, pois), refused


def reset_versions(pois: DataFrame, version: int = 1) -> DataFrame:
    """Every place at one version."""
    return pois.withColumn("review_version", F.lit(version).cast(pois.schema["review_version"].dataType))


def _outcome(pois: DataFrame, ids: DataFrame, action: str, sets: dict[str, Column], was: Column, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, audit rows as :func:`exchange.audit_log` takes them, refused ids) of an action on some places.

    ``was`` tells, for a place, why it is refused, or null.  Ids without a place are refused too.
    """
    asked = ids.select(key, "reviewer", "reason").groupBy(key).agg(F.min(F.struct("reviewer", "reason")).alias("ask"))
    known = asked.join(pois, key).withColumn("refused", was)
    missing = asked.join(pois.select(key), key, "left_anti").select(key, F.lit("not found").alias("refused"))
    refused = known.where("refused is not null").select(key, "refused").unionByName(missing)
    good = known.where("refused is null")
    # truth values are logged as True and False
    text = lambda c, name: F.coalesce(F.initcap(c.cast("string")) if pois.schema[name].dataType.simpleString() == "boolean" else c.cast("string"), F.lit(""))
    old = [x for name in sets for x in (F.lit(name), text(F.col(name), name))]
    new = [x for name, value in sets.items() for x in (F.lit(name), text(value, name))]
    title = F.coalesce(F.nullif("Name_EN", F.lit("")), "Name_AR", F.lit(""))
    changes = good.select(key, title.alias("name"), F.col("ask.reviewer").alias("reviewer"), F.lit(action).alias("action"), F.col("ask.reason").alias("reason"), F.create_map(*old).alias("old"), F.create_map(*new).alias("new"))
    fresh = good.select(key, *(sets.get(c, F.col(c)).alias(c) for c in pois.columns if c != key))
    table = pois.join(good.select(key), key, "left_anti").unionByName(fresh.select(*pois.columns))
    return table, changes, refused


def reject_places(pois: DataFrame, ids: DataFrame, key: str = "GlobalID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, changes for the audit log, refused) of rejections; ids: key, reviewer, reason.

    Refused are places that are rejected already, ids without a reason and ids
    without a place.  Rejection is final; any other status may be rejected.
    """
    why = F.when(F.coalesce("Review_Status", F.lit("")) == "Rejected", "already rejected").when(is_blank(F.col("ask.reason")), "a reason is required")
    return _outcome(pois, ids, "reject", {"Review_Status": F.lit("Rejected"), "rejected_reason": F.col("ask.reason")}, why, key)


def archive_places(pois: DataFrame, ids: DataFrame, key: str = "GlobalID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`reject_places`, for the archive: from any status, with or without a reason."""
    return _outcome(pois, ids, "archive", {"Review_Status": F.lit("Archived"), "archived_reason": F.coalesce("ask.reason", F.lit(""))}, F.lit(None).cast("string"), key)


def flag_places(pois: DataFrame, ids: DataFrame, flagged: bool = True, key: str = "GlobalID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`reject_places`, for the flag, which leaves the status as it is; flag_reason and Review_Flag are the reason, or '' without a flag."""
    reason = F.coalesce("ask.reason", F.lit("")) if flagged else F.lit("")
    sets = {"flagged": F.lit(flagged), "flag_reason": reason, "Review_Flag": reason}
    return _outcome(pois, ids, "flag" if flagged else "unflag", sets, F.lit(None).cast("string"), key)
