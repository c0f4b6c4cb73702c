"""Canonical products: seeds from resolved fields, nested assembly from catalog tables, attributes, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import computed

#: Fields of an item that its table states, identity and taxonomy.
STATED = ["mfg_part_num", "manufacturer_name", "brand_name", "dept", "class", "fine", "classpath"]
SPEC_FIELDS = ["upc", "ean", "list_price", "length", "weight", "warranty"]


def _present(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def seed_products(resolved: DataFrame, fields: list[str], retrieved_at: str | None = None) -> DataFrame:
    """One product per row of resolved (row_idx, fields), as ``normalize.resolve_rows`` gives them.

    Every field becomes a text column (null if invalid), measures get a ``_uom`` column, and two
    maps hold the status of all fields and the provenance of present ones: source_type input, no source_url or source_title, the
    raw cells as evidence, confidence 0.99 if verified and 0.5 otherwise, and ``retrieved_at``. prop_65 is read as yes or no. Fields
    without a cell are unresolved. All of it is local to the row.
    """
    known = F.map_from_entries(F.transform(F.filter("fields", lambda f: f["field"].isin(fields)), lambda f: F.struct(f["field"].alias("key"), f.alias("value"))))
    rows = computed(resolved, {"_f": known})
    entry = lambda f: F.try_element_at("_f", F.lit(f))
    text = lambda e: F.when(e["status"] != "invalid", F.coalesce(e["value"], e["number"].cast("string")))
    columns = [text(entry(f)).alias(f) for f in fields] + [entry(f)["uom"].alias(f"{f}_uom") for f in fields if f in L.MEASURES]
    status = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(entry(f)["status"], F.lit("unresolved")) for f in fields]))
    source = lambda e: F.struct(F.lit("input").alias("source_type"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("source_title"), F.array_join(F.transform(e["contributions"], lambda c: F.concat(c["column"], F.lit(": "), c["raw"])), "; ").alias("evidence"), F.when(e["status"] == "verified", 0.99).otherwise(0.5).alias("confidence"), F.lit(retrieved_at).cast("timestamp").alias("retrieved_at"))
    provenance = F.transform_values(F.map_filter("_f", lambda k, e: text(e).isNotNull()), lambda k, e: source(e))
    out = rows.select("row_idx", *columns, status.alias("value_status"), provenance.alias("field_provenance"))
    if "prop_65" in fields:
        p = F.lower(F.trim("prop_65"))
        out = out.withColumn("prop_65", F.when(p.isin("yes", "y", "true", "1"), "true").when(p.isin("no", "n", "false", "0"), "false"))
    return out


def assemble(items: DataFrame, descriptions: DataFrame, attributes: DataFrame, specs: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Items with their descriptions as a map, attributes as an array by seq, specs as a struct, assets as an array, and value_status.

    Assets (item_id, asset_type, url, sort_order) keep those with a URL, by canonical type. Present identity and taxonomy
    fields are verified, present descriptions and specs inferred, all others unresolved.
    """
    d = descriptions.groupBy(F.col("item_id").alias("id")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("field_name", "value")))).alias("descriptions"))
    a = attributes.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "label", "value", "uom"))).alias("attributes"))
    s = specs.select(F.col("item_id").alias("id"), F.struct(*[c for c in specs.columns if c != "item_id"]).alias("specs"))
    out = items.join(d, "id", "left").join(a, "id", "left").join(s, "id", "left")
    none = F.array().cast("array<struct<seq:int,label:string,value:string,uom:string>>")
    out = out.withColumn("attributes", F.coalesce("attributes", none))
    kind = "array<struct<sort_order:int,asset_type:string,url:string>>"
    if assets is not None:
        one = F.struct(F.col("sort_order").cast("int").alias("sort_order"), "asset_type", F.trim("url").alias("url"))
        out = out.join(normalize_assets(assets).groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("assets")), "id", "left")
    out = out.withColumn("assets", F.coalesce("assets", F.array().cast(kind)) if assets is not None else F.array().cast(kind))
    told = [(f, _present(f), "verified") for f in STATED if f in items.columns]
    told += [(f, F.coalesce(_present(F.try_element_at("descriptions", F.lit(f))), F.lit(False)), "inferred") for f in L.MAX_LENGTHS]
    told += [(f, _present(F.col(f"specs.{f}")), "inferred") for f in specs.columns if f != "item_id"]
    return out.withColumn("value_status", F.create_map(*[x for f, test, status in told for x in (F.lit(f), F.when(test, status).otherwise("unresolved"))]))


def default_status(products: DataFrame, fields: list[str]) -> DataFrame:
    """Completes value_status: an explicit status wins, else present values are inferred and others unresolved."""
    implied = F.create_map(*[x for f in fields for x in (F.lit(f), F.when(_present(f), "inferred").otherwise("unresolved"))])
    return products.withColumn("value_status", F.map_zip_with(implied, F.coalesce("value_status", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a)))


#: Where a value comes from.
PROVENANCE = "struct<source_type:string,source_url:string,source_title:string,evidence:string,confidence:double,retrieved_at:timestamp>"
#: Members of the items of each nested array of a product.
NESTED = {"features": {"name": "string", "value": "string"}, "attributes": {"seq": "int", "label": "string", "value": "string", "uom": "string"}, "assets": {"sort_order": "int", "asset_type": "string", "url": "string"}}


def append_nested(products: DataFrame, column: str, additions: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Products with features, attributes or assets (``column``) appended, in the order of ``order``, each with its provenance.

    ``additions`` has the key, the order, the members of an item and, if they come from somewhere, provenance (``PROVENANCE``). Items that
    are there have none unless they hold one. Additions of unknown products are left out; other columns of them are ignored.
    """
    members = NESTED[column]
    none = F.lit(None).cast(PROVENANCE)
    held = products.schema[column].dataType.elementType.names
    given = {c: (F.col(c) if c in additions.columns else F.lit(None)).cast(kind) for c, kind in (members | {"provenance": PROVENANCE}).items()}
    item = F.struct(*[c.alias(n) for n, c in given.items()])
    more = additions.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item")))).alias("_more"))
    old = F.transform(column, lambda x: F.struct(*[(x[n] if n in held else F.lit(None)).cast(kind).alias(n) for n, kind in members.items()], (x["provenance"].cast(PROVENANCE) if "provenance" in held else none).alias("provenance")))
    empty = F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in members.items())},provenance:{PROVENANCE}>>")
    out = products.join(more, products[key] == F.col("_k"), "left")
    return out.withColumn(column, F.concat(F.coalesce(old, empty), F.coalesce(F.transform("_more", lambda m: m["item"]), empty))).drop("_k", "_more")


def add_provenance(products: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Products whose fields got a source: ``records`` (key, field, provenance, pos) set field_provenance, and value_status to inferred; of one field, the last by pos counts."""
    last = records.groupBy(F.col(key).alias("_k"), "field").agg(F.max_by(F.col("provenance").cast(PROVENANCE), "pos").alias("p"))
    new = last.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("field", "p"))).alias("_new"))
    out = products.join(new, products[key] == F.col("_k"), "left")
    none = F.create_map().cast(f"map<string,{PROVENANCE}>")
    merged = F.map_zip_with(F.coalesce(F.col("field_provenance").cast(f"map<string,{PROVENANCE}>"), none), F.coalesce("_new", none), lambda k, a, b: F.coalesce(b, a))
    status = F.map_zip_with(F.coalesce("value_status", F.create_map().cast("map<string,string>")), F.coalesce("_new", none), lambda k, a, b: F.when(b.isNotNull(), "inferred").otherwise(a))
    return out.withColumns({"field_provenance": merged, "value_status": status}).drop("_k", "_new")


def derive_features(products: DataFrame, most: int = 50) -> DataFrame:
    """Adds features: attributes whose label names a feature, else the item_features description split at semicolons."""
    named = F.filter("attributes", lambda a: F.lower(a["label"]).contains("feature"))
    own = F.transform(F.slice(named, 1, most), lambda a: F.struct(a["label"].alias("name"), a["value"].alias("value")))
    parts = F.filter(F.split(F.try_element_at("descriptions", F.lit("item_features")), ";"), lambda p: F.trim(p) != "")
    text = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("Feature "), (i + 1).cast("string")).alias("name"), F.trim(p).alias("value")))
    return products.withColumn("features", F.when(F.size(own) > 0, own).otherwise(F.coalesce(text, F.array().cast("array<struct<name:string,value:string>>"))))


def normalize_assets(assets: DataFrame) -> DataFrame:
    """Assets (asset_type, url) with a URL, by canonical type; unknown types are reference URLs."""
    table = assets.sparkSession.createDataFrame(list(L.ASSET_TYPES.items()), "_low string, _type string")
    rows = assets.where(_present("url")).join(F.broadcast(table), F.lower("asset_type") == F.col("_low"), "left")
    return rows.withColumn("asset_type", F.coalesce("_type", F.lit("reference_url"))).drop("_low", "_type")


def clean_nested(products: DataFrame) -> DataFrame:
    """Trims members of features, attributes and assets; unnamed features are called Feature, assets without a type are reference URLs, confidence becomes a number."""
    feature = lambda f: F.struct(F.coalesce(F.nullif(F.trim(f["name"]), F.lit("")), F.lit("Feature")).alias("name"), F.trim(f["value"]).alias("value"))
    attribute = lambda a: F.struct(a["seq"].alias("seq"), F.trim(a["label"]).alias("label"), F.trim(a["value"]).alias("value"), F.trim(a["uom"]).alias("uom"))
    asset = lambda a: F.struct(a["sort_order"].alias("sort_order"), F.coalesce(F.nullif(F.trim(a["asset_type"]), F.lit("")), F.lit("reference_url")).alias("asset_type"), F.trim(a["url"]).alias("url"))
    out = products.withColumns({"features": F.transform("features", feature), "attributes": F.transform("attributes", attribute)})
    if "assets" in products.columns:
        out = out.withColumn("assets", F.transform("assets", asset))
    return out.withColumn("confidence_score", F.col("confidence_score").cast("string").try_cast("double")) if "confidence_score" in products.columns else out


def category_attributes(attributes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, seq, label, value, uom): the attributes that count for an item's category, under canonical labels.

    The category is the department, else the first part of the class path. The first attribute of
    a label hides later ones, even if it is dropped itself; in known categories only relevant
    labels stay; placeholders and empty values go.
    """
    spark = attributes.sparkSession
    synonyms = F.broadcast(spark.createDataFrame(list(L.SYNONYMS.items()), "_label string, _canonical string"))
    relevant = F.broadcast(spark.createDataFrame([(c, a) for c, names in L.RELEVANT.items() for a in names], "_category string, _relevant string"))
    category = F.coalesce(F.nullif("dept", F.lit("")), F.nullif(F.split("classpath", "/")[0], F.lit("")), F.lit("other"))
    rows = attributes.withColumn("_l", F.lower(F.trim("label"))).where(F.col("_l") != "")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "_l").orderBy("seq"))).where("_n = 1")
    rows = rows.join(items.select(F.col("id").alias("item_id"), category.alias("_c")), "item_id").join(synonyms, F.col("_l") == F.col("_label"), "left")
    rows = rows.withColumn("_canon", F.coalesce("_canonical", "_l"))
    known = F.col("_c").isin(list(L.RELEVANT))
    direct = rows.join(relevant, (F.col("_c") == F.col("_category")) & ((F.col("_l") == F.col("_relevant")) | (F.col("_canon") == F.col("_relevant"))), "left_semi").where(known)
    rows = direct.unionByName(rows.where(~known))
    fine = _present("value") & ~F.lower(F.trim("value")).rlike(L.FAKE_VALUE)
    return rows.where(fine).select("item_id", "seq", F.col("_canon").alias("label"), F.trim("value").alias("value"), F.trim("uom").alias("uom"))


def missing_fields(products: DataFrame) -> DataFrame:
    """Adds needed (in fixed order), skip, and rationale (a reason for each decision, in order) to assembled products; zero counts as missing."""
    absent = lambda f: ~F.coalesce(_present(F.col(f"specs.{f}")) & (F.col(f"specs.{f}").cast("string").try_cast("double").isNull() | (F.col(f"specs.{f}").cast("string").try_cast("double") != 0)), F.lit(False))
    has = set(products.schema["specs"].dataType.names)
    gone = lambda f: absent(f) if f in has else F.lit(True)
    mpn = F.col("mfg_part_num").isNull()
    anchors = (F.col("manufacturer_name").isNotNull() | F.col("brand_name").isNotNull()) & ((F.length("part_desc") > 20) | F.col("dept").isNotNull() | F.col("classpath").isNotNull())
    labelled = lambda p: F.exists("attributes", lambda a: F.lower(a["label"]).rlike(p))
    dims = reduce(lambda a, b: a & b, [gone(f) for f in ("length", "width", "height")])
    dept = F.coalesce(F.lower("dept"), F.lit(""))
    needed = [F.when(mpn & anchors, "mfg_part_num"), *[F.when(gone(f), f) for f in ("upc", "ean", "gtin", "weight", "warranty")], F.when(dims, "dimensions")]
    needed += [F.when((dept == "electronics") & ~labelled("voltage"), "voltage"), F.when((dept == "industrial") & ~labelled("horsepower|rpm"), "horsepower")]
    skip = [F.when(mpn & ~anchors, "mfg_part_num"), F.when(~gone("weight"), "weight"), F.when(~gone("warranty"), "warranty"), F.when(~dims, "dimensions")]
    why = L.RATIONALE
    reasons = [F.when(mpn, F.when(anchors, why["mpn_anchored"]).otherwise(why["mpn_alone"])), *[F.when(gone(f), f.upper() + why["code"]) for f in ("upc", "ean", "gtin")]]
    reasons += [F.when(test, why[f]).otherwise(f + why["present"]) for f, test in (("weight", gone("weight")), ("warranty", gone("warranty")), ("dimensions", dims))]
    reasons += [F.when((dept == "electronics") & ~labelled("voltage"), why["voltage"]), F.when((dept == "industrial") & ~labelled("horsepower|rpm"), why["horsepower"])]
    return products.withColumns({"needed": F.array_compact(F.array(*needed)), "skip": F.array_compact(F.array(*skip)), "rationale": F.array_compact(F.array(*reasons))})
