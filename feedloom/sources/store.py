"""Catalog tables as a store: text to products, answer keys, upserts, snapshots, resets. Every function returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X

#: Labels that an upload's text gives its fields, in any case.
PART_NUMBER = rf"(?i)Mfg(?:_|{X.SPACE})*Part(?:_|{X.SPACE})*Num(?::|{X.SPACE})+([A-Z0-9\-]+)"
LABELS = {"part_desc": ("Part", "Desc"), "e1_brand": ("E1", "Brand"), "unilog_brand": ("Unilog", "Brand"), "dib_brand": ("DIB", "Brand"), "part_manuf": ("Part", "Manuf")}
#: The shortest text with a part number: so many of them at most begin within a chunk.
_SHORTEST = len("MfgPartNum:x")


def extract_products_from_text(texts: DataFrame, key: str, text: str = "text", chunk: int = 2000) -> DataFrame:
    """(key, pos, mfg_part_num and five labelled fields) of every labelled part number in a text column.

    A product's fields are looked for in the ``chunk`` characters from its label on, also where other products
    begin in them; a field ends with its line. Fields without a value, or with a placeholder of uploads, are null.
    """
    whole = texts.select(key, F.regexp_extract_all(text, F.lit(PART_NUMBER), 0).alias("_marks"), F.split(text, PART_NUMBER, -1).alias("_between"))
    # marks and what follows each, in turn; a chunk is put together from as many as can begin within it
    flat = F.flatten(F.zip_with("_marks", F.slice("_between", F.lit(2), F.size("_marks")), lambda m, b: F.array(m, F.left(b, F.lit(chunk)))))
    rows = whole.where(F.size("_marks") > 0).withColumn("_flat", flat).select(key, "_flat", F.posexplode("_marks").alias("pos", "_mark"))
    rows = rows.select(key, "pos", "_mark", F.left(F.array_join(F.slice("_flat", 2 * F.col("pos") + 1, F.lit(2 * (chunk // _SHORTEST + 1))), ""), F.lit(chunk)).alias("_chunk"))

    def field(first: str, second: str) -> Column:
        value = X.trim(F.regexp_extract("_chunk", rf"(?i){first}(?:_|{X.SPACE})*{second}(?::|{X.SPACE})+([^\n]+)", 1))
        return F.when((value != "") & ~value.isin(L.UPLOAD_PLACEHOLDERS), value)

    return rows.select(key, "pos", F.regexp_extract("_mark", PART_NUMBER, 1).alias("mfg_part_num"), *[field(*v).alias(k) for k, v in LABELS.items()])


#: Columns of an answer file that hold descriptions, assets and specs.
ANSWER_DESCRIPTIONS = {"Part_Desc": "part_desc", **{h: h.lower() for h in ("INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION")}}
ANSWER_ASSETS = {"MFR URL": "mfr_url", **{f"Ref URL {i}": "ref_url" for i in range(1, 6)}}
ANSWER_SPECS = {h: h.lower().replace(" ", "_") for h in ["UPC", "EAN", "GTIN", "UNSPSC", "List Price", "LENGTH", "LENGTH_UOM", "WIDTH", "WIDTH_UOM", "HEIGHT", "HEIGHT_UOM", "WEIGHT", "WEIGHT_UOM", "Country Of Origin", "Warranty"]}


def melt_answer_key(wide: DataFrame, key: str, descriptions: dict[str, str] = ANSWER_DESCRIPTIONS, attributes: int = 50, specs: dict[str, str] = ANSWER_SPECS, assets: dict[str, str] = ANSWER_ASSETS) -> DataFrame:
    """(key, kind, seq, name, value, uom) of a wide answer file: descriptions, attributes (with a label or value), specs and assets that are not empty."""
    cell = lambda kind, seq, name, value, uom: F.struct(F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), name.cast("string").alias("name"), value.cast("string").alias("value"), uom.cast("string").alias("uom"))
    none = F.lit(None)
    cells = [cell("description", 0, F.lit(f), F.col(f"`{h}`"), none) for h, f in descriptions.items()]
    cells += [cell("attribute", i, F.col(f"`ATTRIBUTE_LABEL {i}`"), F.col(f"`ATTRIBUTE_VALUE {i}`"), F.col(f"`ATTRIBUTE_UOM {i}`")) for i in range(1, attributes + 1)]
    cells += [cell("spec", 0, F.lit(f), F.col(f"`{h}`"), none) for h, f in specs.items()]
    cells += [cell("asset", i, F.lit(f), F.col(f"`{h}`"), none) for i, (h, f) in enumerate(assets.items(), 1) if h in wide.columns]
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return wide.select(key, F.inline(F.array(*cells))).where(full(F.col("value")) | ((F.col("kind") == "attribute") & full(F.col("name"))))


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every non-null key."""
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def upsert_items(existing: DataFrame, incoming: DataFrame, key: str = "mfg_part_num", order: str = "row_idx", id_column: str = "id") -> DataFrame:
    """Existing rows overwritten or joined by the first incoming row of every key; known keys keep their id, new ones get the incoming order as text."""
    new = first_by(incoming, key, order)
    ids = existing.select(key, F.col(id_column).alias("_id"))
    taken = new.join(ids, key, "left").withColumn(id_column, F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("new-"), F.col(order).cast("string"))))
    kept = existing.join(new.select(key), key, "left_anti").withColumn(id_column, F.col(id_column).cast("string"))
    return kept.select(*existing.columns).unionByName(taken.select(*existing.columns))


def snapshot_answer_key(snapshot: DataFrame, items: DataFrame, children: DataFrame, keys: list[str], flag: str = "is_ground_truth") -> DataFrame:
    """A child table's snapshot after flagged items are copied again: keyed rows are overwritten, so repeats change nothing."""
    fresh = children.join(items.where(flag).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return snapshot.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def snapshot_all(snapshots: dict[str, DataFrame], items: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], flag: str = "is_ground_truth") -> dict[str, DataFrame]:
    """All snapshots after flagged items and their children ({table: (rows, keys)}) are copied again; ``items`` is a table of them, by id."""
    fresh = items.where(flag)
    out = {"items": snapshots["items"].join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*snapshots["items"].columns))}
    for name, (rows, keys) in children.items():
        out[name] = snapshot_answer_key(snapshots[name], items, rows.select(*snapshots[name].columns), keys, flag)
    return out


def reset_items(items: DataFrame, cleared: list[str], statuses: tuple[str, ...] = ("enriched", "review", "enriching")) -> DataFrame:
    """Items of the given states become raw and lose the cleared fields."""
    hit = F.col("status").isin(*statuses)
    return items.withColumns({c: F.when(~hit, F.col(c)) for c in cleared} | {"status": F.when(hit, "raw").otherwise(F.col("status"))})


def reset_children(children: DataFrame, items: DataFrame, statuses: tuple[str, ...] = ("enriched", "review", "enriching")) -> DataFrame:
    return children.join(items.where(F.col("status").isin(*statuses)).select(F.col("id").alias("item_id")), "item_id", "left_anti")


def replace_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """Children of items that have new ones are replaced; an item without new rows keeps its old ones."""
    return old.join(new.select("item_id").distinct(), "item_id", "left_anti").unionByName(new)


def merge_specs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One specs row per item; supplied values win over old ones."""
    columns = [c for c in old.columns if c != "item_id"]
    both = old.alias("o").join(new.alias("n"), "item_id", "full")
    return both.select("item_id", *[(F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c) for c in columns])
