"""Product identity: keys, the ladder of strengths, first-wins merging, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def identity_keys(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds manufacturer_key, brand_key, mpn_key and fingerprint to (manufacturer, brand, mpn, description)."""
    strong = X.strong_description(F.col("description"), ascii_only)
    return X.computed(
        rows,
        {
            "manufacturer_key": X.name_key(F.col("manufacturer"), ascii_only),
            "brand_key": X.name_key(F.col("brand"), ascii_only),
            "mpn_key": X.mpn_key(F.col("mpn"), ascii_only),
            "fingerprint": F.when(strong, F.nullif(X.description_fingerprint(F.col("description"), ascii_only), F.lit(""))),
        },
    )


def compute_identity(keyed: DataFrame) -> DataFrame:
    """Adds identity_key, strength and basis; descriptions alone never identify a product."""
    m, b, p, d = (F.col(c) for c in ("manufacturer_key", "brand_key", "mpn_key", "fingerprint"))
    steps = [
        (m.isNotNull() & p.isNotNull(), F.concat(F.lit("m:"), m, F.lit("|p:"), p), "strong", "manufacturer_mpn"),
        (m.isNotNull() & b.isNotNull() & d.isNotNull(), F.concat(F.lit("m:"), m, F.lit("|b:"), b, F.lit("|d:"), d), "medium", "manufacturer_brand_description"),
        (b.isNotNull() & d.isNotNull(), F.concat(F.lit("b:"), b, F.lit("|d:"), d), "medium", "brand_description"),
    ]
    key, strength, basis = F.lit(None).cast("string"), F.lit("none"), F.lit("insufficient")
    for test, k, s, w in reversed(steps):
        key, strength, basis = F.when(test, k).otherwise(key), F.when(test, s).otherwise(strength), F.when(test, w).otherwise(basis)
    return X.computed(keyed, {"identity_key": key, "strength": strength, "basis": basis})


def dedupe_identity(rows: DataFrame) -> DataFrame:
    """Adds primary_row: the first row_idx of the identity key; rows without a key stand for themselves.

    Rows without a key are never shuffled: they are many and never merge.
    """
    keyed = rows.where("identity_key is not null").withColumn("primary_row", F.min("row_idx").over(Window.partitionBy("identity_key")))
    return keyed.unionByName(rows.where("identity_key is null").withColumn("primary_row", F.col("row_idx")))


def evidence_cache_key(rows: DataFrame, step: str = "external_evidence", with_description: bool = True) -> DataFrame:
    """Adds cache_key. Medium identities include the fingerprint, unless ``with_description`` is off."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("manufacturer_key", "brand_key", "mpn_key", "basis")]
    if with_description:
        parts.append(F.when(F.col("strength") == "medium", F.coalesce("fingerprint", F.lit(""))).otherwise(F.lit("")))
    return rows.withColumn("cache_key", F.concat(F.lit(step + ":"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)))


def identity_audit(rows: DataFrame) -> DataFrame:
    """(kind, n): rows by identity strength, and rows that repeat an identity."""
    found = dedupe_identity(rows)
    by_strength = found.groupBy(F.concat(F.lit("strength_"), "strength").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by_strength.unionByName(found.where("primary_row <> row_idx").groupBy(F.lit("repeats").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def identity_issues(products: DataFrame, errors: DataFrame) -> DataFrame:
    """(row_idx, mpn, kind, detail): what an audit of finished products (row_idx, mpn, manufacturer, raw_manufacturer) finds.

    duplicate_mpn: the number was seen in an earlier row, which the detail names. manufacturer_derived_differs: the
    manufacturer is another than the raw one without its vendor code. error_<stage>: an error (row_idx, stage, message) of the evidence stages.
    """
    seen = products.where("mpn is not null").groupBy("mpn").agg(F.min("row_idx").alias("first"))
    again = products.join(seen, "mpn").where("row_idx > first").select("row_idx", "mpn", F.lit("duplicate_mpn").alias("kind"), F.concat(F.lit("MPN already seen at row "), F.col("first").cast("string")).alias("detail"))
    raw = X.strip_vendor_code(X.trim(F.col("raw_manufacturer")))
    other = products.where((F.coalesce("raw_manufacturer", F.lit("")) != "") & F.col("manufacturer").isNotNull() & (F.lower(raw) != F.lower("manufacturer")))
    other = other.select("row_idx", "mpn", F.lit("manufacturer_derived_differs").alias("kind"), F.concat(F.lit('input "'), raw, F.lit('" vs output "'), "manufacturer", F.lit('"')).alias("detail"))
    failed = errors.where(F.col("stage").isin("external_evidence", "apply_evidence")).join(products.select("row_idx", "mpn"), "row_idx", "left")
    failed = failed.select("row_idx", "mpn", F.concat(F.lit("error_"), "stage").alias("kind"), F.col("message").alias("detail"))
    return again.unionByName(other).unionByName(failed)


def duplicate_mpns(rows: DataFrame) -> DataFrame:
    """(mpn, n) of part numbers that stand in several rows."""
    return rows.where("mpn is not null").groupBy("mpn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
