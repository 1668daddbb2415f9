"""Filters, projections and aggregations over places and their audit log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_blank, number, status_or_draft, strip


def long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def select_places(pois: DataFrame, status: str | None = None, category: str | None = None, flagged: bool | None = None, ids: list[str] | None = None, search: str | None = None) -> DataFrame:
    """The conjunction of the filters given; ``__empty__`` as category means none."""
    tests = []
    if status:
        tests.append(F.col("Review_Status") == status)
    if category:
        tests.append(is_blank(F.col("Category")) if category == "__empty__" else F.col("Category") == category)
    if flagged is not None:
        tests.append(F.coalesce("flagged", F.lit(False)) if flagged else ~F.coalesce("flagged", F.lit(False)))
    if ids is not None:
        tests.append(F.col("GlobalID").isin([i.strip() for i in ids if i.strip()]))
    if search:
        tests.append(F.col("Name_EN").ilike(f"%{search}%") | F.col("Name_AR").ilike(f"%{search}%") | F.col("GlobalID").ilike(f"%{search}%"))
    return pois.where(reduce(lambda a, b: a & b, tests)) if tests else pois


def page(rows: DataFrame, order: list[Column], number_: int = 0, size: int = 50, most: int = 500) -> DataFrame:
    size = min(size, most)
    return rows.orderBy(*order).offset(number_ * size).limit(size)


def decision(pois: DataFrame) -> Column:
    s = F.col("Review_Status")
    return F.when(s == "Rejected", "Rejected").when(s == "Archived", "Archived").when(F.coalesce("flagged", F.lit(False)), "Flagged").when(s.isin("Reviewed", "Approved"), "Reviewed").otherwise("Draft")


def status_statistics(pois: DataFrame) -> DataFrame:
    s = status_or_draft(F.col("Review_Status"))
    return pois.agg(
        long(F.count("*"), "total"), *(long(F.count_if(s == x), x.lower()) for x in ("Draft", "Reviewed", "Archived", "Rejected")),
        long(F.count_if(F.coalesce("flagged", F.lit(False))), "flagged"), F.coalesce(F.round(F.avg(number(F.col("QA_Score"))), 1), F.lit(0.0)).alias("avg_qa"),
    )


def queue_summary(pois: DataFrame, as_of: Column) -> DataFrame:
    s = status_or_draft(F.col("Review_Status"))
    no_media = is_blank(F.col("Exterior_Photo_URL"), "queue") | is_blank(F.col("Interior_Photo_URL"), "queue")
    return pois.agg(
        long(F.count_if(s == "Draft"), "drafts"), long(F.count_if(F.coalesce("flagged", F.lit(False))), "flagged"), long(F.count_if(s == "Reviewed"), "reviewed"),
        long(F.count_if(s == "Rejected"), "rejected"), long(F.count_if(s == "Archived"), "archived"),
        long(F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS")), "recent"), long(F.count_if(no_media), "needs_media"),
    )


def readiness(pois: DataFrame) -> DataFrame:
    s = status_or_draft(F.col("Review_Status"))
    none = is_blank(F.col("Exterior_Photo_URL"), "queue") & is_blank(F.col("Interior_Photo_URL"), "queue")
    return pois.agg(long(F.count("*"), "total"), long(F.count_if(s == "Reviewed"), "reviewed"), long(F.count_if(s == "Draft"), "draft"), long(F.count_if(F.coalesce("flagged", F.lit(False))), "flagged"), long(F.count_if(none), "missing_media"))


def breakdown(pois: DataFrame, column: str, none: str) -> DataFrame:
    s = status_or_draft(F.col("Review_Status"))
    name = F.when(is_blank(F.col(column)), none).otherwise(F.col(column)).alias("name")
    return pois.groupBy(name).agg(long(F.count("*"), "total"), long(F.count_if(s == "Reviewed"), "reviewed"), long(F.count_if(s == "Draft"), "draft"))


def reviewer_productivity(audit: DataFrame) -> DataFrame:
    a = F.col("action")
    approved = (a == "approve") | ((a == "status_change") & (F.col("new_value") == "Reviewed"))
    return audit.groupBy("reviewer").agg(
        long(F.count("*"), "actions"), long(F.count_if(approved), "approvals"), long(F.count_if(a == "reject"), "rejections"), long(F.count_if(a == "edit"), "edits"),
        long(F.countDistinct("global_id"), "places"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), long(F.countDistinct(F.to_date("created_at")), "days"),
    )


def daily_actions(audit: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    return audit.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy(F.to_date("created_at").alias("day"), "reviewer").agg(long(F.count("*"), "actions"))


def null_rates(pois: DataFrame, fields: list[str], limit: float = 50.0) -> DataFrame:
    """field, blanks, percent, state: one pass over the table."""
    counts = pois.agg(F.count("*").alias("n"), *(F.count_if(is_blank(F.col(f))).alias(f) for f in fields))
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("blanks")) for f in fields))).alias("x")).select("x.field", long(F.col("x.blanks"), "blanks"), F.when(F.col("n") > 0, F.round(F.col("x.blanks") * 100.0 / F.col("n"), 1)).otherwise(0.0).alias("percent"))
    return rows.withColumn("state", F.when(F.col("percent") > limit, "warn").otherwise("pass"))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~is_blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(long(F.count("*"), "n")).where("n > 1")


def histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Half-open bins; what lies outside belongs to none."""
    bins = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        bins = F.when((F.col(column) >= a) & (F.col(column) < b), i).otherwise(bins)
    return rows.withColumn("bin", bins).where("bin is not null").groupBy("bin").agg(long(F.count("*"), "n"))


# What a filled field is worth.
INVOICE = {
    "Name_EN": 5.0, "Name_AR": 5.0, "Category": 3.0, "Subcategory": 2.0, "Phone_Number": 5.0, "Email": 3.0, "Website": 3.0, "Working_Hours": 4.0, "Working_Days": 3.0, "Exterior_Photo_URL": 8.0,
    "Interior_Photo_URL": 8.0, "Menu_Photo_URL": 6.0, "Video_URL": 10.0, "License_Photo_URL": 5.0, "Latitude": 3.0, "Longitude": 3.0, "District_EN": 3.0, "District_AR": 2.0,
}


def value_of(fields: dict[str, float]) -> Column:
    """Sum of the prices of fields that are given."""
    return reduce(lambda a, b: a + b, [F.when(is_blank(F.col(f), "invoice") | (strip(F.col(f)) == ""), 0.0).otherwise(p) for f, p in fields.items()])


def invoice(pois: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    return pois.withColumn("value", value_of(fields or INVOICE)).groupBy("Category").agg(long(F.count("*"), "places"), F.round(F.sum("value"), 2).alias("value"), F.max("value").alias("most"))


def accuracy_gate(out: DataFrame, errors: list[DataFrame], licence_errors: int, media_errors: int, key: str = "GlobalID", least: float = 98.0) -> DataFrame:
    """rows, bad, accuracy, passed over distinct bad ids."""
    bad = reduce(lambda a, b: a.unionByName(b), [e.select(key) for e in errors]).distinct().agg(long(F.count("*"), "bad"))
    n = out.agg(long(F.count("*"), "rows"))
    rate = F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("bad")) * 100.0 / F.col("rows"), 2)).otherwise(0.0)
    # both sides are one row
    return n.withColumn("k", F.lit(1)).join(bad.withColumn("k", F.lit(1)), "k").drop("k").withColumn("accuracy", rate).withColumn("passed", (F.col("accuracy") >= least) & F.lit(licence_errors == 0 and media_errors == 0))


def top(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(F.col(column).alias("name")).agg(long(F.count("*"), "n")).orderBy(F.desc("n"), F.asc_nulls_last("name")).limit(n)


def timeline(audit: DataFrame, gap: str = "2 seconds", most: int = 200) -> DataFrame:
    """Events per place, newest first: rows join the current event while action and reviewer are its own and they lie within the gap of its first row.

    The anchor does not advance, so this is a fold over the ordered rows and not a
    session window.  A place's rows are at most ``most``, the newest.
    """
    newest = Window.partitionBy("global_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = audit.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    item = F.struct("place", "action", "reviewer", "created_at", "id")
    kind = "array<struct<action:string,reviewer:string,at:timestamp,rows:bigint>>"
    kind = kind.replace("timestamp", dict(audit.dtypes)["created_at"])
    rows = rows.groupBy("global_id").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def add(events: Column, x: Column) -> Column:
        last = F.try_element_at(events, F.lit(-1))
        same = last["action"].eqNullSafe(x["action"]) & last["reviewer"].eqNullSafe(x["reviewer"]) & (x["created_at"] > last["at"] - F.expr(f"INTERVAL {gap}"))
        grown = F.struct(last["action"].alias("action"), last["reviewer"].alias("reviewer"), last["at"].alias("at"), (last["rows"] + 1).alias("rows"))
        fresh = F.struct(x["action"].alias("action"), x["reviewer"].alias("reviewer"), x["created_at"].alias("at"), F.lit(1).cast("long").alias("rows"))
        return F.when((F.size(events) > 0) & same, F.concat(F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(events, F.array(fresh)))

    return rows.select("global_id", F.posexplode(F.aggregate("items", F.array().cast(kind), add)).alias("event", "e")).select("global_id", "event", "e.action", "e.reviewer", "e.at", "e.rows")


def draft_statistics(drafts: DataFrame, most: int = 30) -> DataFrame:
    """grouping, name, n: drafts in all, by status, by verdict, pending ones by category (the ``most`` largest) and by their checks.

    One scan: the groupings are sets of one aggregation.  Blank categories are
    "(empty)"; ties go by name.
    """
    pending = F.coalesce(F.col("Draft_Status") == "pending", F.lit(False))
    checks = F.when(F.col("QA_Blockers") == 0, "qa_pass").when(F.col("QA_Blockers") > 0, "qa_fail")
    rows = drafts.select(
        F.col("Draft_Status").alias("by_status"), F.col("Dup_Verdict").alias("by_verdict"), pending.alias("pending"),
        F.when(pending, F.coalesce(F.nullif("Category", F.lit("")), F.lit("(empty)"))).alias("by_category"), F.when(pending, checks).alias("by_check"),
    )
    names = ["by_status", "by_verdict", "by_category", "by_check"]
    cells = rows.groupingSets([[F.col(c)] for c in names] + [[]], *names).agg(F.grouping_id(*names).alias("set"), F.count(F.lit(1)).alias("n"))
    # the bit of a grouping is 0 where its column counts; with all four set, everything is counted
    bit = {c: 15 - (8 >> i) for i, c in enumerate(names)}
    grouping, name = F.lit("total"), F.lit(None).cast("string")
    for c in names:
        grouping, name = F.when(F.col("set") == bit[c], c).otherwise(grouping), F.when(F.col("set") == bit[c], F.col(c)).otherwise(name)
    found = cells.select(grouping.alias("grouping"), name.alias("name"), "n").where("grouping not in ('by_category', 'by_check') or name is not null")
    place = F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("n"), "name"))
    return found.withColumn("place", place).where((F.col("grouping") != "by_category") | (F.col("place") <= most)).drop("place")


def page_with_total(rows: DataFrame, order: list[Column], number_: int = 0, size: int = 50, most: int = 500) -> DataFrame:
    """A page of the rows, each with ``total``, the number of all of them."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(rows, order, number_, size, most).crossJoin(F.broadcast(total))


def score_distribution(scores: Column, bins: list[tuple[float, float]], n: Column | None = None) -> list[Column]:
    """Aggregates of a score: least, greatest, mean (of one digit) and the number in each bin, its upper end excluded; a row may stand for ``n``."""
    mean = F.avg(scores) if n is None else F.sum(scores * n) / F.sum(n)
    inside = lambda where: F.count_if(where) if n is None else F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")
    return [
        F.min(scores).alias("least"), F.max(scores).alias("greatest"), F.round(mean, 1).alias("mean"),
        *(inside((scores >= low) & (scores < high)).alias(f"from_{low}_to_{high}") for low, high in bins),
    ]
