"""Queries over the supplier feed: normalisation and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X
from ..operators import identity as I
from ..operators import normalize as N
from . import oracle as O
from .registry import query

#: Columns of the feed view in order; its text is ASCII, so no Python is planned for composition.
COLUMNS = "MPN MFR Brand_Name Trade_Name Part_Desc Category Dept UPC_Code EAN Weight Net_Weight Length Length_UOM List_Price MSRP Warranty Model Warehouse_Location".split()
_FIELD = {c: N.resolve_header(c) for c in COLUMNS}
_field = lambda c: "NULL" if _FIELD[c] in (None, "ambiguous") else f"'{_FIELD[c]}'"
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT row_idx, {i} AS pos, '{c}' AS col, {_field(c)} AS field, {c} AS raw, {O.clean(c)} AS value FROM {{feed}}" for i, c in enumerate(COLUMNS)) + ")"
_MEASURES = ", ".join(f"'{m}'" for m in L.MEASURES)
_SPLIT = f"""{_CELLS}, split AS (
  SELECT c.*, CASE WHEN c.field IN ({_MEASURES}) AND regexp_matches(c.value, '{O.MEASURE}') THEN regexp_extract(c.value, '{O.MEASURE}', 1) ELSE c.value END AS amount,
    CASE WHEN c.field IN ({_MEASURES}) THEN coalesce(CASE WHEN regexp_matches(c.value, '{O.MEASURE}') THEN regexp_extract(c.value, '{O.MEASURE}', 2) END, u.value) END AS uom
  FROM cells c LEFT JOIN cells u ON u.row_idx = c.row_idx AND u.field = c.field || '_uom')"""
_MERGED = f"""{_SPLIT}, used AS (
  SELECT row_idx, field, pos, col, uom, CASE WHEN field = 'manufacturer_name' THEN {O.vendor("amount")} ELSE amount END AS v FROM split WHERE field IS NOT NULL AND NOT field LIKE '%_uom'
), keyed AS (SELECT *, row_number() OVER (PARTITION BY row_idx, field, lower(trim(v)) ORDER BY pos) AS again FROM used
), d AS (SELECT row_idx, field, list(v ORDER BY pos) FILTER (v IS NOT NULL AND again = 1) AS vs, list(col ORDER BY pos) FILTER (v IS NOT NULL AND again = 1) AS cs,
    list({O.number("v")} ORDER BY pos) FILTER (v IS NOT NULL AND again = 1) AS ns, arg_min(uom, pos) FILTER (uom IS NOT NULL AND v IS NOT NULL AND again = 1) AS uom FROM keyed GROUP BY row_idx, field
), s AS (SELECT *, coalesce(len(vs), 0) AS n, vs[1] AS head, {O.digits("vs[1]")} AS dg, len([x for x in ns if x IS NULL]) AS bad, list_position([x IS NULL for x in ns], true) AS bad_at,
    field IN ({O.quoted(L.NUMERIC_FIELDS)}) AS numeric, field IN ({O.quoted(L.BARCODE_FIELDS)}) AS barcode FROM d
), st AS (SELECT *, CASE WHEN n = 0 THEN 'unresolved' WHEN numeric THEN CASE WHEN bad > 0 THEN 'invalid' WHEN len(list_distinct(ns)) > 1 THEN 'conflicting' ELSE 'verified' END
    WHEN barcode AND NOT {O.valid_gtin("dg")} THEN 'invalid' WHEN n > 1 THEN 'conflicting' ELSE 'verified' END AS status FROM s
), merged AS (SELECT row_idx, field, CASE WHEN n = 0 OR numeric THEN NULL WHEN barcode THEN dg ELSE head END AS value, CASE WHEN numeric AND status <> 'invalid' THEN ns[1] END AS number, uom, status,
    CASE WHEN status = 'conflicting' THEN 'conflicting ' || field || ' values from input columns' WHEN status = 'invalid' AND numeric THEN 'invalid numeric "' || vs[bad_at] || '" for ' || field || ' (column ' || cs[bad_at] || ')'
      WHEN status = 'invalid' THEN 'invalid ' || field || ' checksum/format "' || head || '"' END AS issue, n FROM st)"""


@query(f"WITH {_CELLS} SELECT pos, col AS \"column\", field, CASE WHEN field IS NULL THEN CASE WHEN col = 'Model' THEN 'ambiguous' ELSE 'unrecognized' END END AS reason, count(value) AS filled FROM cells GROUP BY ALL")
def resolve_headers(t):
    """The field of every header, with the number of filled cells of its column."""
    filled = N.long_cells(t.feed, True).groupBy("column").agg(F.count("value").alias("filled"))
    return N.resolve_headers(t.spark, COLUMNS).join(filled, "column").select("pos", "column", "field", "reason", "filled")


@query(f"WITH {_CELLS} SELECT row_idx, col AS \"column\", value FROM cells")
def clean_cells(t):
    """Every cell cleaned, placeholders as null."""
    return N.long_cells(t.feed, True).select("row_idx", "column", "value")


@query(f"WITH {_SPLIT} SELECT row_idx, col AS \"column\", amount, uom FROM split WHERE field IN ({_MEASURES})")
def split_measure(t):
    """Measures as amount and unit."""
    return N.contributions(t.feed, True).where(F.col("field").isin(L.MEASURES)).select("row_idx", "column", "amount", "uom")


@query(f"SELECT {O.vendor('MFR')} AS manufacturer, count(*) AS n, count(DISTINCT MFR) AS spellings FROM {{feed}} GROUP BY 1")
def strip_vendor_code(t):
    """Manufacturers without vendor codes, with rows and spellings folded into each."""
    return t.feed.groupBy(X.strip_vendor_code(F.col("MFR")).alias("manufacturer")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("MFR").alias("spellings"))


@query(f"WITH {_SPLIT} SELECT field, count(amount) AS filled, count({O.number('amount')}) AS valid, round(sum({O.number('amount')}), 4) AS total FROM split WHERE field IN ({O.quoted(L.NUMERIC_FIELDS)}) GROUP BY field")
def parse_numeric(t):
    """Filled and valid numbers of each numeric field."""
    cells = N.contributions(t.feed, True).where(F.col("field").isin(L.NUMERIC_FIELDS)).withColumn("n", X.parse_number(F.col("amount")))
    return cells.groupBy("field").agg(F.count("amount").alias("filled"), F.count("n").alias("valid"), F.round(F.sum("n"), 4).alias("total"))


@query(f"WITH {_CELLS} SELECT field, {O.valid_gtin(O.digits('value'))} AS valid, count(*) AS n FROM cells WHERE field IN ({O.quoted(L.BARCODE_FIELDS)}) AND value IS NOT NULL GROUP BY 1, 2")
def validate_barcodes(t):
    """Barcodes with right and wrong check digits by field."""
    cells = N.long_cells(t.feed, True).where(F.col("field").isin(L.BARCODE_FIELDS) & F.col("value").isNotNull())
    return cells.groupBy("field", X.valid_gtin(X.barcode_digits(F.col("value"))).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MERGED} SELECT * FROM merged")
def merge_contributions(t):
    """One resolved value per row and field, with status and issue."""
    rows = N.merge_contributions(t.feed, True)
    return rows.select("row_idx", "field", "value", "number", "uom", "status", "issue", F.size("contributions").alias("n"))


@query(f"SELECT row_idx, lag(row_idx) OVER (PARTITION BY {', '.join(O.clean(c) for c in COLUMNS)} ORDER BY row_idx) AS duplicate_of FROM (SELECT * FROM {{feed}} UNION ALL SELECT row_idx + 1000000, * EXCLUDE (row_idx) FROM {{feed}} WHERE row_idx % 3 = 0) z")
def exact_duplicates(t):
    """The nearest earlier row with the same cells, in the feed and a second delivery of every third row."""
    return N.exact_duplicates(t.feed.unionByName(t.feed.where("row_idx % 3 = 0").withColumn("row_idx", F.col("row_idx") + 1_000_000)), True)


@query(f"WITH {_CELLS} SELECT col AS \"column\", CASE WHEN col = 'Model' THEN 'ambiguous' ELSE 'unrecognized' END AS reason, count(value) AS filled FROM cells WHERE field IS NULL GROUP BY 1, 2")
def unmapped_columns(t):
    """Columns without a field, why, and how many cells they hold."""
    filled = N.long_cells(t.feed, True).groupBy("column").agg(F.count("value").alias("filled"))
    return N.resolve_headers(t.spark, COLUMNS).where("field is null").join(filled, "column").select("column", "reason", "filled")


@query(
    f"""WITH {_MERGED}, f AS (SELECT row_idx, max(value) FILTER (field = 'mfg_part_num') AS mpn, max(value) FILTER (field = 'part_desc') AS descr, max(value) FILTER (field = 'brand_name') AS brand,
      max(value) FILTER (field = 'trade_name') AS trade, count(issue) AS issues FROM merged GROUP BY row_idx),
    r AS (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY row_idx) AS k FROM f)
    SELECT count(*) AS rows_in, count(*) FILTER (mpn IS NULL) AS skipped, count(*) FILTER (mpn IS NOT NULL AND k > 1) AS duplicates, count(*) FILTER (issues > 0) AS issue_rows,
      count(descr) AS described, count(coalesce(brand, trade)) AS branded FROM r"""
)
def upload_summary(t):
    """One row of counts of an upload."""
    return N.upload_summary(t.feed, True)


@query(
    f"""SELECT count(*) AS rows, count(DISTINCT nullif(trim(MPN), '')) AS unique_mpns, count(nullif(trim(MPN), '')) - count(DISTINCT nullif(trim(MPN), '')) AS duplicate_mpns,
    count(*) FILTER (lower(trim(Brand_Name)) IN ('-- unbranded --', '-- no unilog brand --', '-- no dib brand --')) AS placeholder_brands, count(*) FILTER (coalesce(trim(Part_Desc), '') = '') AS empty_descriptions,
    round(count(*) FILTER (regexp_matches(MFR, '\\([A-Z0-9]{{{{1,6}}}}\\)\\s*$')) / count(*), 6) AS vendor_code_share FROM {{feed}}""".replace("{{1,6}}", "{1,6}")
)
def profile_feed(t):
    """One row of raw feed figures."""
    return N.profile(t.feed, "MPN", "Part_Desc", "Brand_Name", "MFR")


def _identity_rows(t):
    """Identity inputs: cleaned cells of the feed."""
    cell = lambda c: X.clean(F.col(c), True)
    rows = X.computed(t.feed.select("row_idx", "MFR", "Brand_Name", "MPN", "Part_Desc"), {"maker": cell("MFR"), "brand": cell("Brand_Name"), "mpn": cell("MPN"), "description": cell("Part_Desc")})
    return rows.select("row_idx", X.strip_vendor_code(F.col("maker")).alias("manufacturer"), "brand", "mpn", "description")


def identities(t):
    return I.compute_identity(I.identity_keys(_identity_rows(t), True))


_INPUT = f"input AS (SELECT row_idx, {O.vendor('m')} AS manufacturer, brand, mpn, description FROM (SELECT row_idx, {O.clean('MFR')} AS m, {O.clean('Brand_Name')} AS brand, {O.clean('MPN')} AS mpn, {O.clean('Part_Desc')} AS description FROM {{feed}}) z)"
IDENTITY_SQL = f"""{_INPUT}, keyed AS (SELECT *, {O.name_key('manufacturer')} AS mk, {O.name_key('brand')} AS bk, {O.mpn_key('mpn')} AS pk, CASE WHEN {O.strong('description')} THEN {O.fingerprint('description')} END AS fp FROM input),
  ident AS (SELECT *, CASE WHEN mk IS NOT NULL AND pk IS NOT NULL THEN 'm:' || mk || '|p:' || pk WHEN mk IS NOT NULL AND bk IS NOT NULL AND fp IS NOT NULL THEN 'm:' || mk || '|b:' || bk || '|d:' || fp
      WHEN bk IS NOT NULL AND fp IS NOT NULL THEN 'b:' || bk || '|d:' || fp END AS identity_key,
    CASE WHEN mk IS NOT NULL AND pk IS NOT NULL THEN 'strong' WHEN bk IS NOT NULL AND fp IS NOT NULL THEN 'medium' ELSE 'none' END AS strength,
    CASE WHEN mk IS NOT NULL AND pk IS NOT NULL THEN 'manufacturer_mpn' WHEN mk IS NOT NULL AND bk IS NOT NULL AND fp IS NOT NULL THEN 'manufacturer_brand_description' WHEN bk IS NOT NULL AND fp IS NOT NULL THEN 'brand_description' ELSE 'insufficient' END AS basis FROM keyed),
  merged_ids AS (SELECT *, CASE WHEN identity_key IS NULL THEN row_idx ELSE min(row_idx) OVER (PARTITION BY identity_key) END AS primary_row FROM ident)"""


def _folding(key, source):
    return lambda t: _identity_rows(t).groupBy(key(F.col(source), True).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("spellings"))


@query(f"WITH {_INPUT} SELECT {O.name_key('manufacturer')} AS key, count(*) AS n, count(DISTINCT manufacturer) AS spellings FROM input GROUP BY 1")
def name_key(t):
    """Manufacturer keys with rows and spellings folded into each."""
    return _folding(X.name_key, "manufacturer")(t)


@query(f"WITH {_INPUT} SELECT {O.mpn_key('mpn')} AS key, count(*) AS n, count(DISTINCT mpn) AS spellings FROM input GROUP BY 1")
def mpn_key(t):
    """Part number keys with rows and spellings folded into each."""
    return _folding(X.mpn_key, "mpn")(t)


@query(f"WITH {_INPUT} SELECT {O.strong('description')} AS strong, count(*) AS n, count(DISTINCT description) AS texts FROM input GROUP BY 1")
def strong_description(t):
    """Descriptions that can and cannot support an identity."""
    return _identity_rows(t).groupBy(X.strong_description(F.col("description"), True).alias("strong")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("description").alias("texts"))


@query(f"WITH {_INPUT} SELECT {O.fingerprint('description')} AS fingerprint, count(*) AS n FROM input GROUP BY 1")
def description_fingerprint(t):
    """Fingerprints with the rows of each."""
    return _identity_rows(t).groupBy(F.nullif(X.description_fingerprint(F.col("description"), True), F.lit("")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {IDENTITY_SQL} SELECT row_idx, identity_key, strength, basis FROM ident")
def compute_identity(t):
    """Identity of every row."""
    return identities(t).select("row_idx", "identity_key", "strength", "basis")


@query(f"WITH {IDENTITY_SQL} SELECT row_idx, primary_row FROM merged_ids")
def dedupe_identity(t):
    """The row that stands for each row's product."""
    return I.dedupe_identity(identities(t)).select("row_idx", "primary_row")


@query(f"""WITH {IDENTITY_SQL} SELECT row_idx, 'external_evidence:' || substr(sha256(concat_ws(chr(31), coalesce(mk, ''), coalesce(bk, ''), coalesce(pk, ''), basis, CASE WHEN strength = 'medium' THEN coalesce(fp, '') ELSE '' END)), 1, 32) AS cache_key FROM ident""")
def evidence_cache_key(t):
    """The key under which evidence of a product is kept."""
    return I.evidence_cache_key(identities(t)).select("row_idx", "cache_key")


@query(f"""WITH {IDENTITY_SQL}, f AS (SELECT mpn, min(row_idx) AS first FROM ident WHERE mpn IS NOT NULL GROUP BY mpn) SELECT 'strength_' || strength AS kind, count(*) AS n FROM ident GROUP BY 1 UNION ALL SELECT 'repeats', count(*) FROM merged_ids WHERE primary_row <> row_idx HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_mpn', count(*) FROM ident JOIN f USING (mpn) WHERE row_idx > first HAVING count(*) > 0 UNION ALL SELECT 'manufacturer_derived_differs', count(*) FROM ident WHERE manufacturer IS NOT NULL AND row_idx % 29 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'error_external_evidence', count(*) FROM ident WHERE row_idx % 17 = 3 HAVING count(*) > 0""")
def identity_audit(t):
    """Rows by identity strength, repeats, and findings by kind (every 29th manufacturer was derived otherwise, every 17th search failed)."""
    rows = identities(t)
    made = F.when(F.col("row_idx") % 29 == 0, F.concat("manufacturer", F.lit(" Group"))).otherwise(F.col("manufacturer"))
    products = rows.select("row_idx", "mpn", made.alias("manufacturer")).join(t.feed.select("row_idx", F.col("MFR").alias("raw_manufacturer")), "row_idx")
    errors = t.feed.where("row_idx % 17 = 3").select("row_idx", F.lit("external_evidence").alias("stage"), F.lit("timeout").alias("message"))
    found = I.identity_issues(products, errors).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return I.identity_audit(rows).unionByName(found)


@query(f"WITH {_INPUT} SELECT mpn, count(*) AS n FROM input WHERE mpn IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_mpns(t):
    """Part numbers of several rows."""
    return I.duplicate_mpns(_identity_rows(t))
