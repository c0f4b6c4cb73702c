"""Completeness, states, quotas and lists of catalog items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L

ITEM_SLOTS = ["manufacturer_name", "brand_name", "dept", "class", "fine", "classpath"]
DESCRIPTION_SLOTS = ["invoice_desc", "mobile_desc", "short_desc", "long_desc1"]
SPEC_SLOTS = ["upc", "length", "width", "height", "weight", "warranty"]


def filled(c: Column) -> Column:
    """1 for a value that is neither null, empty nor zero."""
    text = c.cast("string")
    return F.coalesce(((text != "") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0)).cast("int"), F.lit(0))


def completeness(items: DataFrame, descriptions: DataFrame, attributes: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, filled, score, new_status): 21 expected slots; enriched needs the critical fields and at least 60 per cent."""
    d = descriptions.where(F.col("field_name").isin(DESCRIPTION_SLOTS) & (F.col("value") != "")).groupBy(F.col("item_id").alias("id")).agg(F.countDistinct("field_name").alias("d"))
    a = attributes.groupBy(F.col("item_id").alias("id")).agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("a"))
    s = specs.select(F.col("item_id").alias("id"), sum((filled(F.col(c)) for c in SPEC_SLOTS if c in specs.columns), F.lit(0)).alias("s"))
    rows = items.join(d, "id", "left").join(a, "id", "left").join(s, "id", "left")
    total = sum((filled(F.col(c)) for c in ITEM_SLOTS), F.lit(0)) + F.coalesce("d", F.lit(0)) + F.coalesce("a", F.lit(0)) + F.coalesce("s", F.lit(0))
    rows = rows.withColumn("filled", total.cast("long")).withColumn("score", F.floor(F.col("filled") * 100 / 21 + 0.5).cast("long"))
    critical = F.lit(True)
    for c in L.CRITICAL_FIELDS:
        critical = critical & (filled(F.col(c)) == 1)
    return rows.select("id", "filled", "score", F.when(critical & (F.col("score") >= 60), "enriched").otherwise("review").alias("new_status"))


def field_confidence(items: DataFrame, logs: DataFrame) -> DataFrame:
    """(id, field_confidence): mean confidence of an item's logs to two places, 0 without any."""
    means = logs.groupBy(F.col("item_id").alias("id")).agg(F.floor(F.avg("confidence") * 100 + 0.5).alias("m"))
    return items.select("id").join(means, "id", "left").select("id", (F.coalesce("m", F.lit(0)) / 100).alias("field_confidence"))


def step_order(step: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in L.STEPS]), step)


def first_failure(logs: DataFrame) -> DataFrame:
    """(item_id, failed_step, error): the first step in order that failed, and its earliest message; later steps do not count."""
    bad = logs.where("status = 'error'").withColumn("_o", step_order(F.col("step")))
    return bad.groupBy("item_id").agg(F.min_by(F.struct("step", "error"), F.struct("_o", "created_at", "log_id")).alias("f")).select("item_id", F.col("f.step").alias("failed_step"), F.col("f.error").alias("error"))


def batch_summary(items: DataFrame) -> DataFrame:
    """(batch_id, processed, enriched, needs_review, skipped, avg_confidence)."""
    done = F.col("status").isin("enriched", "review", "failed")
    return items.groupBy("batch_id").agg(
        F.count_if(done).alias("processed"), F.count_if(F.col("status") == "enriched").alias("enriched"), F.count_if(F.col("status") == "review").alias("needs_review"), F.count_if(~done).alias("skipped"),
        F.round(F.avg(F.when(done, F.col("confidence_score"))), 4).alias("avg_confidence"),
    )


def quota_admission(queue: DataFrame, used: int, limit: int) -> DataFrame:
    """The first items of a queue (id) in order that today's remaining quota admits; the batch itself uses one unit.

    Only as many rows as the quota admits are kept by each task before they meet.
    """
    left = max(0, limit - used - 1)
    return queue.orderBy("id").limit(left)


def usage_summary(logs: DataFrame, limit: int) -> DataFrame:
    """(day, used, remaining, near_limit, avoided): attempts of each day against the limit, and calls that evidence saved."""
    rows = logs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("attempts").cast("long")).alias("used"), F.count_if(F.col("matched") & (F.col("needs") == 0)).alias("avoided"))
    left = F.greatest(F.lit(limit) - F.col("used"), F.lit(0))
    return rows.select("day", "used", left.cast("long").alias("remaining"), (left <= -(-limit // 10)).alias("near_limit"), "avoided")


def reconcile_states(items: DataFrame, logs: DataFrame, now: int, stale_seconds: int = 600, newest: int = 20) -> DataFrame:
    """(id, class, new_status, failed_step) of items that are enriching, enriched or in review.

    An enriching item without an update for ``stale_seconds`` has failed: at the step of its last
    log if that is an error, else at the first step its newest logs do not show as done, else at
    finalize. An enriched item without critical fields goes to review. Times are seconds.
    """
    order = Window.partitionBy("item_id").orderBy(F.col("created_at").desc(), F.col("log_id").desc())
    latest = logs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest)
    state = latest.groupBy(F.col("item_id").alias("id")).agg(F.min_by(F.struct("status", "step"), "_n").alias("last"), F.collect_set(F.when(F.col("status") == "success", F.col("step"))).alias("done"))
    rows = items.where(F.col("status").isin("enriching", "enriched", "review")).join(state, "id", "left")
    undone = F.get(F.array_except(F.array(*[F.lit(s) for s in L.STEPS]), F.coalesce("done", F.array().cast("array<string>"))), F.lit(0))
    step = F.when(F.col("last").isNull(), "unknown").when(F.col("last.status") == "error", F.col("last.step")).otherwise(F.coalesce(undone, F.lit("finalize")))
    critical = F.lit(True)
    for c in L.CRITICAL_FIELDS:
        critical = critical & (filled(F.col(c)) == 1)
    stale = F.col("updated_at") < now - stale_seconds
    kind = F.when(F.col("status") == "review", "VALID_REVIEW").when(F.col("status") == "enriched", F.when(critical, "VALID_ENRICHED").otherwise("INVALID")).otherwise(F.when(stale, "STALE").otherwise("ACTIVE"))
    rows = rows.withColumn("class", kind)
    return rows.select("id", "class", F.when(F.col("class") == "STALE", "failed").when(F.col("class") == "INVALID", "review").otherwise(F.col("status")).alias("new_status"), F.when(F.col("class") == "STALE", step).alias("failed_step"))


def list_page(items: DataFrame, page: int = 1, size: int = 50, **filters) -> DataFrame:
    """The rows of ``list_items`` with total (of all items that the filters leave) and total_pages."""
    total = list_items(items, page=1, size=None, **filters).agg(F.count(F.lit(1)).alias("total"))
    rows = list_items(items, page=page, size=size, **filters).join(F.broadcast(total))  # one row
    return rows.withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def list_items(items: DataFrame, search: str | None = None, status: str | None = None, batch=None, page: int = 1, size: int | None = 50) -> DataFrame:
    """One page of items (all of them, unordered, without a size), newest first: filtered by status, batch and a part of number, description or manufacturer."""
    if status is not None:
        items = items.where(F.col("status") == status)
    if batch is not None:
        items = items.where(F.col("batch_id") == batch)
    if search:
        items = items.where(F.contains(F.lower("mfg_part_num"), F.lit(search.lower())) | F.contains(F.lower("part_desc"), F.lit(search.lower())) | F.contains(F.lower("manufacturer_name"), F.lit(search.lower())))
    if size is None:
        return items
    return items.orderBy(F.col("updated_at").desc(), "id").offset((page - 1) * size).limit(size)


def status_counts(items: DataFrame) -> DataFrame:
    """(status, label, n) of every known status, zeros included, and of all unknown ones together."""
    names = items.sparkSession.createDataFrame([(s, s.capitalize()) for s in L.STATUSES] + [("unknown", "Unknown")], "status string, label string")
    counts = items.groupBy(F.when(F.col("status").isin(L.STATUSES), F.col("status")).otherwise("unknown").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "status", "left").select("status", "label", F.coalesce("n", F.lit(0)).alias("n"))
