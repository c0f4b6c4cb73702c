"""The delivery layout of 252 text columns, filled from tables, from canonical products or from text; and audits of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The delivery headers in order; the runs of features and attributes follow a rule.
_HEAD = [
    "MFR URL", "Ref URL 1", "Ref URL 2", "Ref URL 3", "Ref URL 4", "Ref URL 5", "PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER",
    "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME",
    "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC",
    "MARKETING_DESCRIPTION",
]
_MIDDLE = [
    "With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name",
]
_TAIL = [
    "UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information", "LENGTH", "LENGTH_UOM",
    "HEIGHT", "HEIGHT_UOM", "WIDTH", "WIDTH_UOM", "WEIGHT", "WEIGHT_UOM", "VOLUME", "VOLUME_UOM", "Product Image", "Alternate Image 1",
    "Alternate Image 2", "Alternate Image 3", "Alternate Image 4", "SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet",
    "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing",
    "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1",
    "Country Of Origin", "Discontinued", "Actual Image (Yes/No)",
]
FEATURES = [f"ITEM_FEATURES_{i}" for i in range(1, 21)]
ATTRIBUTES = [f"ATTRIBUTE_{k} {i}" for i in range(1, 51) for k in ("LABEL", "VALUE", "UOM")]
HEADERS = _HEAD + FEATURES + _MIDDLE + ATTRIBUTES + _TAIL

#: Internal field of each header that has a source; the others are always empty.
HEADER_FIELD = {
    "PART_NUMBER": "mfg_part_num",
    "SKU - MY_PART_NUMBER": "mfg_part_num",
    "Mfg_Part_Num": "mfg_part_num",
    "MANUFACTURER_PART_NUMBER": "mfg_part_num",
    "Dept": "dept",
    "Class": "class",
    "Fine": "fine",
    "Part_Desc": "part_desc",
    "E1_Brand": "e1_brand",
    "Unilog_Brand": "unilog_brand",
    "DIB_Brand": "dib_brand",
    "Part_Manuf": "part_manuf",
    "MANUFACTURER_NAME": "manufacturer_name",
    "BRAND_NAME": "brand_name",
    "TRADE_NAME": "trade_name",
    "ALTERNATE_PART_NUMBER": "alternate_part_number",
    "Classpath": "classpath",
    "MOBILE_DESC": "mobile_desc",
    "INVOICE_DESC": "invoice_desc",
    "SHORT_DESC": "short_desc",
    "LONG_DESC1": "long_desc1",
    "RETAIL_DESC": "retail_desc",
    "MARKETING_DESCRIPTION": "marketing_description",
    "UPC": "upc",
    "EAN": "ean",
    "GTIN": "gtin",
    "UNSPSC": "unspsc",
    "Warranty": "warranty",
    "List Price": "list_price",
    "LENGTH": "length",
    "LENGTH_UOM": "length_uom",
    "HEIGHT": "height",
    "HEIGHT_UOM": "height_uom",
    "WIDTH": "width",
    "WIDTH_UOM": "width_uom",
    "WEIGHT": "weight",
    "WEIGHT_UOM": "weight_uom",
    "Country Of Origin": "country_of_origin",
    "Actual Image (Yes/No)": "actual_image_flag",
} | {h: h.lower() for h in FEATURES} | {h: h.lower().replace(" ", "_") for h in ATTRIBUTES}
DESCRIPTIONS = ["mobile_desc", "invoice_desc", "short_desc", "long_desc1", "retail_desc", "marketing_description"]


def plain_number(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    n = c.try_cast("double") if not isinstance(c, str) else F.col(c).cast("double")
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def _layout(df: DataFrame, key: str, cells: dict[str, Column]) -> DataFrame:
    return df.select(key, *[F.coalesce(cells.get(h, F.lit(None)).cast("string"), F.lit("")).alias(h) for h in HEADERS])


def _common(columns: list[str]) -> dict[str, Column]:
    return {h: F.col(f) for h, f in HEADER_FIELD.items() if f in columns}


def delivery_from_tables(items: DataFrame, descriptions: DataFrame, attributes: DataFrame, specs: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row of 252 texts per item; features 1 to 20 repeat attribute values 1 to 20. Children are gathered as maps, once each.

    The image flag is Yes for items with a product image that has a URL, else No.
    """
    d = descriptions.where(F.col("field_name").isin(DESCRIPTIONS)).groupBy(F.col("item_id").alias("id")).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in DESCRIPTIONS])
    a = attributes.where("seq between 1 and 50").groupBy(F.col("item_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("seq", F.struct("label", "value", "uom")))).alias("_a"))
    numbers = [c for c in ("list_price", "length", "width", "height", "weight") if c in specs.columns]
    s = specs.withColumns({c: plain_number(c) for c in numbers}).withColumnRenamed("item_id", "id")
    rows = items.join(d, "id", "left").join(a, "id", "left").join(s, "id", "left")
    if assets is not None:
        image = (F.col("asset_type") == "product_image") & (F.coalesce("url", F.lit("")) != "")
        rows = rows.join(assets.groupBy(F.col("item_id").alias("id")).agg(F.max(F.coalesce(image, F.lit(False))).alias("_image")), "id", "left")
    cells = _common(rows.columns)
    cells["Actual Image (Yes/No)"] = F.when(F.col("_image"), "Yes").otherwise("No") if assets is not None else F.lit("No")
    at = lambda i, k: F.try_element_at("_a", F.lit(i))[k]
    cells |= {f"ATTRIBUTE_{k.upper()} {i}": at(i, k) for i in range(1, 51) for k in ("label", "value", "uom")}
    cells |= {f"ITEM_FEATURES_{i}": at(i, "value") for i in range(1, 21)}
    return _layout(rows, "id", cells)


def delivery_from_canonical(products: DataFrame, key: str = "id") -> DataFrame:
    """The layout from nested products: features and attributes by position, descriptions and specs by name."""
    cells = _common(products.columns)
    names = products.schema["specs"].dataType.names if "specs" in products.columns else []
    for h, f in HEADER_FIELD.items():
        if f in names:
            cells[h] = plain_number(F.col(f"specs.{f}")) if f in ("list_price", "length", "width", "height", "weight") else F.col(f"specs.{f}")
        elif f in DESCRIPTIONS and "descriptions" in products.columns:
            cells[h] = F.try_element_at("descriptions", F.lit(f))
    cells |= {f"ATTRIBUTE_{k.upper()} {i}": F.get("attributes", F.lit(i - 1))[k] for i in range(1, 51) for k in ("label", "value", "uom")}
    image = F.exists("assets", lambda a: (a["asset_type"] == "product_image") & (F.coalesce(a["url"], F.lit("")) != "")) if "assets" in products.columns else F.lit(False)
    cells["Actual Image (Yes/No)"] = F.when(image, "Yes").otherwise("No")
    if "features" in products.columns:
        cells |= {f"ITEM_FEATURES_{i}": F.get("features", F.lit(i - 1))["value"] for i in range(1, 21)}
    return _layout(products, key, cells)


def delivery_features_from_text(delivery: DataFrame, text: DataFrame, key: str = "id") -> DataFrame:
    """The layout with features 1 to 20 from a semicolon-separated text (key, text) instead."""
    parts = F.filter(F.transform(F.split("_text", ";"), lambda p: F.trim(p)), lambda p: p != "")
    rows = delivery.join(text.select(key, F.col("text").alias("_text")), key, "left").withColumn("_p", parts)
    return rows.withColumns({f"ITEM_FEATURES_{i}": F.coalesce(F.get("_p", F.lit(i - 1)), F.lit("")) for i in range(1, 21)}).drop("_text", "_p")


def brand_passthrough(delivery: DataFrame, feed: DataFrame, columns: dict[str, str], key: str = "id") -> DataFrame:
    """Fills headers from raw feed columns ({header: column}); placeholders that start with two hyphens become empty."""
    raw = feed.select(F.col("row_idx").alias(key), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns.values())])
    rows = delivery.join(raw, key, "left")
    kept = lambda c: F.coalesce(F.when(~F.trim(c).startswith("--"), c), F.lit(""))
    return rows.withColumns({h: kept(F.col(f"_{i}")) for i, h in enumerate(columns)}).drop(*[f"_{i}" for i in range(len(columns))])


def status_totals(products: DataFrame) -> DataFrame:
    """(field, status, cells) over all 252 headers of products with value_status, by field and, with a null field, in all.

    Statuses are counted by field first, and so are the products themselves; a field then counts once for each of
    its headers, so the products are never multiplied by the layout. What follows works on one row for each field and status.
    """
    spark = products.sparkSession
    shown: dict[str, int] = {}
    for f in HEADER_FIELD.values():
        shown[f] = shown.get(f, 0) + 1
    entries = F.map_concat(F.map_from_arrays(F.array(F.lit("(none)")), F.array(F.lit("static_empty"))), "value_status")
    counts = products.select(F.explode(entries).alias("field", "status")).groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))
    fixed = [("(none)", len(HEADERS) - len(HEADER_FIELD))]
    headers = spark.createDataFrame(list(shown.items()) + fixed, "field string, headers int")
    known = headers.join(counts, "field", "left").select("field", "status", F.coalesce("n", F.lit(0)).alias("n"), "headers")
    all_rows = F.max(F.when(F.col("field") == "(none)", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    known = known.withColumns({"all": F.coalesce(all_rows, F.lit(0)), "told": F.sum("n").over(Window.partitionBy("field"))})
    unknown = known.select("field", F.lit("unresolved").alias("status"), ((F.col("all") - F.col("told")) * F.col("headers")).alias("cells")).distinct()
    rows = known.where("status is not null").select("field", "status", (F.col("n") * F.col("headers")).alias("cells")).unionByName(unknown).where("cells > 0")
    return rows.groupingSets([[F.col("field"), F.col("status")], [F.col("status")]], "field", "status").agg(F.sum("cells").cast("long").alias("cells"))


def unprovenanced(products: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): present values without a provenance record; there should be none."""
    bare = [F.when(F.col(f).isNotNull() & ~F.coalesce(F.map_contains_key("field_provenance", F.lit(f)), F.lit(False)), F.lit(f)) for f in fields]
    return products.select(F.explode(F.array_compact(F.array(*bare))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def fields_by_source(products: DataFrame) -> DataFrame:
    """(field, source_type, n): present fields by the source of their value."""
    return products.select(F.explode("field_provenance").alias("field", "p")).groupBy("field", F.col("p.source_type").alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


def run_outcomes(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """(row_idx, outcome, primary_row, stage): exactly one outcome for each input row: processed, duplicate or failed.

    ``rows`` has row_idx and primary_row; ``failed`` (row_idx, stage) of primary rows. A duplicate
    shares the fate of its primary row.
    """
    bad = failed.groupBy("row_idx").agg(F.min("stage").alias("stage")).withColumnRenamed("row_idx", "primary_row")
    out = rows.join(bad, "primary_row", "left")
    outcome = F.when(F.col("stage").isNotNull(), "failed").when(F.col("row_idx") != F.col("primary_row"), "duplicate").otherwise("processed")
    return out.select("row_idx", outcome.alias("outcome"), "primary_row", "stage")


def external_fields(products: DataFrame) -> DataFrame:
    """(field, n): present fields whose value came from an external source."""
    return fields_by_source(products).where("source_type = 'external'").select("field", "n")


def run_metrics(outcomes: DataFrame, identities: DataFrame, evidence: DataFrame, products: DataFrame) -> DataFrame:
    """One row of the totals of a run.

    ``evidence`` has one row for each product that was searched: row_idx, retrieved, matched, fields (extracted without a
    model), needs (left for one), asked (a model was), cached. ``products`` has row_idx and value_status. Only primary rows are worked on, so a
    duplicate adds nothing but itself; rows without identity are processed and not searched. Totals are of one
    grouping and single-row joins: there are no counters.
    """
    rows = outcomes.join(identities.select("row_idx", "strength"), "row_idx").join(evidence, "row_idx", "left")
    states = products.select("row_idx", *[F.size(F.map_filter("value_status", lambda k, v: v == s)).alias(f"_{s}") for s in ("conflicting", "unresolved", "invalid")])
    rows = rows.join(states, "row_idx", "left")
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    work = F.col("primary_row") == F.col("row_idx")
    searched = work & (F.col("strength") != "none")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows_in"), is_("processed").alias("processed"), is_("failed").alias("failed"), is_("duplicate").alias("duplicates"), count(work & (F.col("strength") == "none")).alias("no_identity"), count(searched & F.col("matched")).alias("with_evidence"),
        count(searched & ~F.coalesce("cached", F.lit(False))).alias("searches"), count(searched & F.col("retrieved") & ~F.col("cached")).alias("retrievals"), total(searched & F.col("matched"), "fields").alias("deterministic_fields"),
        count(searched & F.col("asked")).alias("model_calls"), count(searched & F.col("matched") & (F.col("needs") == 0)).alias("model_calls_avoided"), count(searched & F.col("cached")).alias("cache_hits"), count(searched & ~F.coalesce("cached", F.lit(False))).alias("cache_misses"),
        total(work, "_conflicting").alias("conflicts"), total(work, "_unresolved").alias("unresolved_fields"), total(work, "_invalid").alias("invalid_fields"),
    )
