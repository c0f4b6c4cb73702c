"""Queries about the delivery layout, its audits, the catalog store, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import canonical as C
from ..operators import export as D
from ..operators import identity as I
from ..operators import normalize as N
from ..sources import files as R
from ..sources import store as W
from ..streaming import jobs as J
from . import oracle as O
from .catalog_queries import _FEATURES, FIELDS
from .feed_queries import _MERGED, COLUMNS, IDENTITY_SQL, identities
from .registry import query

_SHOWN = {"PART_NUMBER": "part_number", "Dept": "dept", "Class": "klass", "Part_Desc": "part_desc", "MANUFACTURER_NAME": "maker", "SHORT_DESC": "short_desc", "ITEM_FEATURES_1": "feature_1", "ITEM_FEATURES_2": "feature_2", "ATTRIBUTE_LABEL 1": "label_1", "ATTRIBUTE_VALUE 2": "value_2", "ATTRIBUTE_UOM 3": "uom_3", "UPC": "upc", "List Price": "price", "WEIGHT": "weight", "VOLUME": "volume", "Actual Image (Yes/No)": "image"}


def _digest(df, key="id"):
    """Some of the 252 columns, and how many of all are filled."""
    n = sum(((F.col(f"`{h}`") != "").cast("int") for h in D.HEADERS[1:]), (F.col(f"`{D.HEADERS[0]}`") != "").cast("int"))
    return df.select(key, *[F.col(f"`{h}`").alias(a) for h, a in _SHOWN.items()], n.cast("long").alias("filled"))


_NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN floor({c})::BIGINT::VARCHAR ELSE {c}::VARCHAR END"
_ATT = "att AS (SELECT item_id, max(label) FILTER (seq = 1) AS l1, max(value) FILTER (seq = 1) AS v1, max(value) FILTER (seq = 2) AS v2, max(uom) FILTER (seq = 3) AS u3, count(*) FILTER (label <> '') + count(*) FILTER (value <> '') + count(*) FILTER (uom <> '') AS filled, count(*) FILTER (seq <= 20 AND value <> '') AS feats FROM {attrs} GROUP BY 1)"
_DES = "des AS (SELECT item_id, max(value) FILTER (field_name = 'short_desc') AS short, count(*) FILTER (value <> '' AND field_name <> 'item_features') AS filled FROM {descs} GROUP BY 1)"
_E = lambda x: f"coalesce({x}, '')"


_IMAGE = "CASE WHEN EXISTS (SELECT 1 FROM {assets} z WHERE z.item_id = i.id AND z.asset_type = 'product_image' AND coalesce(z.url, '') <> '') THEN 'Yes' ELSE 'No' END"


def _layout_sql(f1: str, f2: str, feats: str, extra: str = "", joins: str = "", image: str = _IMAGE) -> str:
    base = "1 + 4 * (i.mfg_part_num <> '')::INTEGER + " + " + ".join(f"({_E(c)} <> '')::INTEGER" for c in ("i.dept", "i.class", "i.fine", "i.part_desc", "i.manufacturer_name", "i.brand_name", "i.classpath", "s.upc", "s.ean", "s.warranty", "s.list_price::VARCHAR", "s.length::VARCHAR", "s.weight::VARCHAR"))
    return f"""WITH {_ATT}, {_DES}{extra} SELECT i.id, i.mfg_part_num AS part_number, {_E('i.dept')} AS dept, {_E('i.class')} AS klass, i.part_desc, {_E('i.manufacturer_name')} AS maker, {_E('short')} AS short_desc, {f1} AS feature_1, {f2} AS feature_2, {_E('l1')} AS label_1, {_E('v2')} AS value_2, {_E('u3')} AS uom_3,
      {_E('s.upc')} AS upc, {_E(_NUM('s.list_price'))} AS price, {_E(_NUM('s.weight'))} AS weight, '' AS volume, {image} AS image, ({base} + coalesce(att.filled, 0) + coalesce(des.filled, 0) + {feats})::BIGINT AS filled
      FROM {{items}} i LEFT JOIN att ON att.item_id = i.id LEFT JOIN des ON des.item_id = i.id LEFT JOIN {{specs}} s ON s.item_id = i.id {joins}"""


@query(_layout_sql(_E("v1"), _E("v2"), "coalesce(att.feats, 0)"))
def delivery_from_tables(t):
    """The delivery of every item, from its tables."""
    return _digest(D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs, t.assets))


@query(_layout_sql(_E("f.vs[1]"), _E("f.vs[2]"), "coalesce(len([v for v in f.vs[1:20] if v <> '']), 0)", f", {_FEATURES}", "LEFT JOIN features f ON f.id = i.id"))
def delivery_from_canonical(t):
    """The delivery of every item, from its canonical product."""
    return _digest(D.delivery_from_canonical(C.derive_features(C.assemble(t.items, t.descs, t.attrs, t.specs, t.assets))))


@query(_layout_sql(_E("p.vs[1]"), _E("p.vs[2]"), "coalesce(len(p.vs[1:20]), 0)", ", p AS (SELECT item_id, [trim(x) for x in string_split(value, ';') if trim(x) <> ''] AS vs FROM {descs} WHERE field_name = 'item_features')", "LEFT JOIN p ON p.item_id = i.id", "'No'"))
def delivery_features_from_text(t):
    """The delivery with features from text."""
    text = t.descs.where("field_name = 'item_features'").select(F.col("item_id").alias("id"), F.col("value").alias("text"))
    return _digest(D.delivery_features_from_text(D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs), text))


@query("SELECT row_idx AS id, CASE WHEN starts_with(trim(Brand_Name), '--') THEN '' ELSE coalesce(Brand_Name, '') END AS brand, coalesce(Trade_Name, '') AS trade, coalesce(MFR, '') AS maker FROM {feed}")
def brand_passthrough(t):
    """Source columns of the delivery straight from the feed."""
    rows = D.brand_passthrough(D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs), t.feed, {"E1_Brand": "Brand_Name", "DIB_Brand": "Trade_Name", "Part_Manuf": "MFR"})
    return rows.select("id", F.col("E1_Brand").alias("brand"), F.col("DIB_Brand").alias("trade"), F.col("Part_Manuf").alias("maker"))


def _seeds(t):
    return C.seed_products(N.resolve_rows(t.feed, True), FIELDS)


_HEADS = {f: sum(1 for x in D.HEADER_FIELD.values() if x == f) for f in D.HEADER_FIELD.values()}
_VALUES = ", ".join(f"('{f}', {n})" for f, n in _HEADS.items())
_STATUS = f"""{_MERGED}, h AS (SELECT * FROM (VALUES {_VALUES}) v(field, headers)), p AS (SELECT DISTINCT row_idx FROM merged), c AS (
    SELECT h.field, coalesce(m.status, 'unresolved') AS status, headers AS cells FROM p CROSS JOIN h LEFT JOIN merged m ON m.row_idx = p.row_idx AND m.field = h.field AND m.field IN ({O.quoted(FIELDS)})
    UNION ALL SELECT '(none)', 'static_empty', {len(D.HEADERS) - len(D.HEADER_FIELD)} FROM p)"""


@query(f"WITH {_STATUS} SELECT status, sum(cells)::BIGINT AS cells FROM c GROUP BY 1")
def status_totals(t):
    """Delivery cells by status."""
    return D.status_totals(_seeds(t)).where("field is null").select("status", "cells")


@query(f"WITH {_STATUS} SELECT field, status, sum(cells)::BIGINT AS cells FROM c GROUP BY 1, 2")
def status_by_field(t):
    """Delivery cells by field and status."""
    return D.status_totals(_seeds(t)).where("field is not null")


@query("SELECT 'dept' AS field, count(*) AS n FROM {feed} WHERE row_idx % 9 = 0 AND " + f"({O.clean('Dept')}) IS NULL HAVING count(*) > 0")
def unprovenanced_values(t):
    """Values that someone set without saying where they are from (here, departments of every ninth row)."""
    rows = _seeds(t).withColumn("dept", F.when((F.col("row_idx") % 9 == 0) & F.col("dept").isNull(), "guessed").otherwise(F.col("dept")))
    return D.unprovenanced(rows, FIELDS)


_ABROAD = "field IN ('weight', 'warranty', 'upc')"


@query(f"WITH {_MERGED} SELECT field, count(*) AS n FROM merged WHERE status <> 'invalid' AND (value IS NOT NULL OR number IS NOT NULL) AND {_ABROAD} AND row_idx % 4 = 0 GROUP BY 1")
def external_fields(t):
    """Present fields from an external source: of every fourth product, three were confirmed by a page."""
    abroad = lambda k, p: F.when(k.isin("weight", "warranty", "upc") & (F.col("row_idx") % 4 == 0), p.withField("source_type", F.lit("external"))).otherwise(p)
    return D.external_fields(_seeds(t).withColumn("field_provenance", F.transform_values("field_provenance", abroad)))


@query(f"WITH {_MERGED} SELECT field, 'input' AS source_type, count(*) AS n FROM merged WHERE status <> 'invalid' AND (value IS NOT NULL OR number IS NOT NULL) AND field IN ({O.quoted(FIELDS)}) GROUP BY 1")
def fields_by_source(t):
    """Present fields by the source of their value."""
    return D.fields_by_source(_seeds(t))


def _outcomes(t):
    rows = I.dedupe_identity(identities(t))
    return D.run_outcomes(rows.select("row_idx", "primary_row"), rows.where("row_idx = primary_row and row_idx % 17 = 3").select("row_idx", F.lit("evidence").alias("stage"))), rows


_OUT = f"""{IDENTITY_SQL}, outs AS (SELECT row_idx, primary_row, strength, CASE WHEN primary_row % 17 = 3 THEN 'failed' WHEN row_idx <> primary_row THEN 'duplicate' ELSE 'processed' END AS outcome, CASE WHEN primary_row % 17 = 3 THEN 'evidence' END AS stage FROM merged_ids)"""


_EVIDENCE = "ev AS (SELECT product_id, count(*) FILTER (tier = 1) AS fields, count(*) % 3 AS needs, product_id % 4 = 0 AS cached FROM {candidates} GROUP BY product_id)"


@query(f"""WITH {_OUT}, {_EVIDENCE}, {_MERGED.replace('keyed', 'keyed_cells')}, o AS (SELECT outs.*, row_idx = primary_row AS work, row_idx = primary_row AND strength <> 'none' AS searched, coalesce(fields > 0, false) AS matched, fields, needs, coalesce(cached, false) AS cached, product_id IS NOT NULL AS retrieved FROM outs LEFT JOIN ev ON product_id = row_idx),
    totals AS (SELECT count(*) FILTER (status = 'conflicting') AS conflicts, count(*) FILTER (status = 'unresolved') AS unresolved_fields, count(*) FILTER (status = 'invalid') AS invalid_fields FROM merged JOIN outs USING (row_idx) WHERE row_idx = primary_row AND field IN ({O.quoted(FIELDS)}))
    SELECT count(*) AS rows_in, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (work AND strength = 'none') AS no_identity, count(*) FILTER (searched AND matched) AS with_evidence,
      count(*) FILTER (searched AND NOT cached) AS searches, count(*) FILTER (searched AND retrieved AND NOT cached) AS retrievals, coalesce(sum(fields) FILTER (searched AND matched), 0)::BIGINT AS deterministic_fields, count(*) FILTER (searched AND matched AND needs > 0) AS model_calls,
      count(*) FILTER (searched AND matched AND needs = 0) AS model_calls_avoided, count(*) FILTER (searched AND cached) AS cache_hits, count(*) FILTER (searched AND NOT cached) AS cache_misses, (SELECT conflicts FROM totals) AS conflicts, (SELECT unresolved_fields FROM totals) AS unresolved_fields, (SELECT invalid_fields FROM totals) AS invalid_fields FROM o""")
def run_metrics(t):
    """All totals of a run over the feed, in which every 17th product fails and every fourth is in the cache."""
    found = t.candidates.groupBy(F.col("product_id").alias("row_idx")).agg(F.count_if(F.col("tier") == 1).alias("fields"), (F.count(F.lit(1)) % 3).alias("needs"))
    found = found.select("row_idx", F.lit(True).alias("retrieved"), (F.col("fields") > 0).alias("matched"), "fields", "needs", ((F.col("fields") > 0) & (F.col("needs") > 0)).alias("asked"), (F.col("row_idx") % 4 == 0).alias("cached"))
    return D.run_metrics(*_outcomes(t), found, _seeds(t))


@query(f"WITH {_OUT} SELECT row_idx, outcome, primary_row, stage FROM outs")
def run_outcomes(t):
    """One outcome for every row of that run."""
    return _outcomes(t)[0]


# a tenth of the descriptions hold a line break, a quote and a comma
_BROKEN = "CASE WHEN row_idx % 10 = 3 THEN concat(coalesce(Part_Desc, ''), chr(10), '5\" x, ', chr(10), '\"q\"') ELSE coalesce(Part_Desc, '') END"


def _feed_files(t) -> str:
    path = R.scratch(t.spark)
    R.write_csv(t.feed.withColumn("Part_Desc", F.expr(_BROKEN.replace("chr(", "char("))).withColumnRenamed("row_idx", "idx"), path)
    return path


@query(f"SELECT row_idx AS idx, coalesce(MPN, '') AS mpn, coalesce(Brand_Name, '') AS brand, {_BROKEN} AS part_desc FROM {{feed}}")
def read_feed(t):
    """The feed, some cells with line breaks, written as CSV and read back as a supplier file by byte ranges."""
    rows = R.read_feed(t.spark, _feed_files(t))
    return rows.select(F.col("idx").cast("long").alias("idx"), F.col("MPN").alias("mpn"), F.col("Brand_Name").alias("brand"), F.col("Part_Desc").alias("part_desc"))


@query("SELECT count(*) AS rows, 0::BIGINT AS malformed_rows, 0::BIGINT AS ragged_rows, 0::BIGINT AS blank_lines FROM {feed}")
def feed_report(t):
    """Counts of the feed's records that are read, malformed, ragged and blank."""
    return R.feed_report(t.spark, _feed_files(t))


# three blocks after every text: one in full, one in another spelling, one without fields of its own that sees those of the next
_BLOCKS = """concat(coalesce(text, ''), chr(10), 'Mfg Part Num: P-', doc_id, ' rev', chr(10), 'Part_Manuf: ', coalesce(source, ''), chr(10), 'E1 Brand: -- Unbranded --', chr(10), 'Part Desc:  item ', doc_id, chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('mfg_part_num:', chr(10), 'q', doc_id, chr(10), 'unilog brand ', coalesce(lang, ''), chr(10), 'MfgPartNum z-9, ', repeat('.', 1990), chr(10), 'DIB_Brand: far') ELSE '' END)"""
_FIRST = "(?i)Mfg[_\\s]*Part[_\\s]*Num[:\\s]+([A-Z0-9\\-]+)"
_LABELLED = ", ".join(f"nullif(nullif(trim(regexp_extract(c, '(?i){a}[_\\s]*{b}[:\\s]+([^\\n]+)', 1)), ''), '-- Unbranded --') AS {n}" for n, a, b in [("part_desc", "Part", "Desc"), ("e1_brand", "E1", "Brand"), ("unilog_brand", "Unilog", "Brand"), ("dib_brand", "DIB", "Brand"), ("part_manuf", "Part", "Manuf")])


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, {_BLOCKS} AS x FROM {{documents}}),
    m AS (SELECT doc_id, -1 AS pos, 0::BIGINT AS start, x, x AS rest FROM t
      UNION ALL SELECT doc_id, pos + 1, start + instr(rest, regexp_extract(rest, '{_FIRST}', 0)), x, substr(rest, instr(rest, regexp_extract(rest, '{_FIRST}', 0)) + 1) FROM m WHERE regexp_matches(rest, '{_FIRST}'))
    SELECT doc_id, pos, regexp_extract(c, '{_FIRST}', 1) AS mfg_part_num, {_LABELLED} FROM (SELECT doc_id, pos, substr(x, start, 2000) AS c FROM m WHERE pos >= 0) z""")
def extract_products_from_text(t):
    """Labelled products in the text of every document, with some blocks added."""
    return W.extract_products_from_text(t.documents.select("doc_id", F.expr(_BLOCKS.replace("chr(", "char(")).alias("text")), "doc_id")


_MELTED = " UNION ALL ".join(f"SELECT item_id, {v} AS v FROM {{specs}}" for v in ("upc", "ean", "warranty", *map(_NUM, ("list_price", "length", "weight"))))


@query(f"""SELECT item_id AS id, 'attribute' AS kind, count(*) AS n, sum(length(value))::BIGINT AS chars FROM {{attrs}} WHERE trim(value) <> '' OR trim(label) <> '' GROUP BY 1
    UNION ALL SELECT item_id, 'description', count(*), sum(length(value))::BIGINT FROM (SELECT item_id, value FROM {{descs}} WHERE field_name IN ('mobile_desc', 'short_desc', 'invoice_desc', 'long_desc1') UNION ALL SELECT id, part_desc FROM {{items}}) d WHERE trim(value) <> '' GROUP BY 1
    UNION ALL SELECT item_id, 'spec', count(*), sum(length(v))::BIGINT FROM ({_MELTED}) z WHERE v IS NOT NULL GROUP BY 1 UNION ALL SELECT id, 'asset', count(*), sum(length(v))::BIGINT FROM (SELECT id, 'http://m/' || id::VARCHAR AS v FROM {{items}} WHERE id % 3 = 0 UNION ALL SELECT id, 'http://r' FROM {{items}} WHERE id % 2 = 0) z GROUP BY 1""")
def melt_answer_key(t):
    """The delivery with some URLs as an answer key in long form, counted by item and kind."""
    wide = D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs).withColumns({"MFR URL": F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://m/"), F.col("id").cast("string"))), "Ref URL 2": F.when(F.col("id") % 2 == 0, "http://r")})
    return W.melt_answer_key(wide, "id").groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value").cast("long")).alias("chars"))


@query(f"SELECT h AS header, count(*) AS cells FROM {{items}} z CROSS JOIN (SELECT unnest([{O.quoted(D.HEADERS)}]) AS h) v GROUP BY 1")
def write_delivery_csv(t):
    """The delivery written as CSV and read back: cells of each of the 252 columns (all of them survive)."""
    rows = D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs, t.assets).withColumns({"id": F.col("id").cast("string"), "Includes": F.lit('a "quoted", cell\nof two lines')})
    rows, path = R.kept(rows), R.scratch(t.spark)
    R.write_csv(rows, path)
    back = R.read_feed(t.spark, path).drop("row_idx")
    return R.export_parity(rows, back, "id").where("different + only_left + only_right = 0").select("header", "cells")


@query("SELECT unnest(['readable', 'header_count', 'header_order', 'missing_headers', 'extra_headers', 'reordered_headers', 'row_width', 'unicode', 'static_headers']) AS \"check\", count(*) > 0 AS ok FROM {items}")
def validate_delivery(t):
    """Nine checks of the whole delivery as a written file."""
    path = R.scratch(t.spark)
    R.write_csv(D.delivery_from_tables(t.items, t.descs, t.attrs, t.specs).drop("id"), path)
    return R.validate_delivery(t.spark, path).select("check", "ok")


@query(f"SELECT col AS header, count(*) AS cells, count(*) FILTER (col = 'Weight' AND row_idx % 7 = 0 AND row_idx % 50 <> 1) AS different, count(*) FILTER (row_idx % 50 = 1) AS only_left, 0::BIGINT AS only_right FROM {{feed}} CROSS JOIN (SELECT unnest([{O.quoted(COLUMNS)}]) AS col) c GROUP BY 1")
def export_parity(t):
    """The whole feed written as CSV and, with some cells changed and some rows left out, as Parquet, compared cell by cell."""
    rows = t.feed.select(F.col("row_idx").cast("string").alias("k"), *[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])
    one, two = R.scratch(t.spark), R.scratch(t.spark)
    R.write_csv(rows, one)
    number = F.col("k").cast("long")
    other = rows.where(number % 50 != 1).withColumn("Weight", F.when(number % 7 == 0, F.concat("Weight", F.lit("!"))).otherwise(F.col("Weight")))
    other.write.parquet(two)
    return R.export_parity(R.read_feed(t.spark, one).drop("row_idx"), t.spark.read.parquet(two), "k")


_INCOMING = f"inc AS (SELECT * FROM (SELECT row_idx, {O.clean('MPN')} AS mfg_part_num, {O.clean('Part_Desc')} AS part_desc, row_number() OVER (PARTITION BY {O.clean('MPN')} ORDER BY row_idx) AS n FROM {{feed}}) z WHERE n = 1 AND mfg_part_num IS NOT NULL)"


@query(f"WITH {_INCOMING} SELECT id::VARCHAR AS id, mfg_part_num, part_desc FROM {{items}} WHERE id % 2 = 0 AND mfg_part_num NOT IN (SELECT mfg_part_num FROM inc) UNION ALL SELECT coalesce(i.id::VARCHAR, 'new-' || inc.row_idx::VARCHAR), inc.mfg_part_num, inc.part_desc FROM inc LEFT JOIN {{items}} i ON i.mfg_part_num = inc.mfg_part_num AND i.id % 2 = 0")
def upsert_items(t):
    """Every second item, after the feed is uploaded."""
    feed = t.feed.select("row_idx", X.clean(F.col("MPN"), True).alias("mfg_part_num"), X.clean(F.col("Part_Desc"), True).alias("part_desc"))
    return W.upsert_items(t.items.where("id % 2 = 0").select("id", "mfg_part_num", "part_desc"), feed)


@query("""SELECT 'items' AS copy, id AS item_id, count(*) AS n, max(mfg_part_num) AS top FROM {items} WHERE id % 10 = 3 GROUP BY id UNION ALL SELECT 'items', item_id, count(*), max(mfg_part_num) FROM {answers} GROUP BY item_id
    UNION ALL SELECT 'descriptions', item_id, count(*), max(value) FROM (SELECT item_id, value FROM {descs} WHERE item_id % 10 = 3 UNION ALL SELECT item_id, value FROM {answer_descs} WHERE item_id % 10 <> 3) z GROUP BY item_id
    UNION ALL SELECT 'attributes', item_id, count(*), max(label) FROM (SELECT item_id, label FROM {attrs} WHERE item_id % 10 = 3 UNION ALL SELECT item_id, label FROM {answer_attrs} WHERE item_id % 10 <> 3) z GROUP BY item_id
    UNION ALL SELECT 'specs', item_id, count(*), max(upc) FROM (SELECT item_id, upc FROM {specs} WHERE item_id % 10 = 3 UNION ALL SELECT item_id, upc FROM {answer_specs} WHERE item_id % 10 <> 3) z GROUP BY item_id
    UNION ALL SELECT 'assets', item_id, count(*), max(CASE WHEN item_id % 10 = 3 THEN url ELSE 'old' END) FROM {assets} GROUP BY item_id""")
def snapshot_answer_key(t):
    """All five answer tables after the flagged items are copied over them; rows of each item and its last value."""
    before = {"items": t.answers.select(F.col("item_id").alias("id"), "mfg_part_num"), "descriptions": t.answer_descs.select("item_id", "field_name", "value"), "attributes": t.answer_attrs, "specs": t.answer_specs.select("item_id", "upc"), "assets": t.assets.withColumn("url", F.lit("old"))}
    children = {"descriptions": (t.descs, ["item_id", "field_name"]), "attributes": (t.attrs, ["item_id", "seq"]), "specs": (t.specs, ["item_id"]), "assets": (t.assets, ["item_id", "asset_type", "sort_order"])}
    after = W.snapshot_all(before, t.items, children)
    shown = {"items": ("id", "mfg_part_num"), "descriptions": ("item_id", "value"), "attributes": ("item_id", "label"), "specs": ("item_id", "upc"), "assets": ("item_id", "url")}
    parts = [after[k].groupBy(F.lit(k).alias("copy"), F.col(i).alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.max(v).alias("top")) for k, (i, v) in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query("SELECT id, CASE WHEN status IN ('enriched', 'review', 'enriching') THEN 'raw' ELSE status END AS status, CASE WHEN status IN ('enriched', 'review', 'enriching') THEN NULL ELSE dept END AS dept, (SELECT count(*) FROM {attrs} a WHERE a.item_id = i.id AND i.status NOT IN ('enriched', 'review', 'enriching')) AS attributes FROM {items} i")
def reset_items(t):
    """Items and their attributes after a reset."""
    left = W.reset_children(t.attrs, t.items).groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("attributes"))
    return W.reset_items(t.items, ["dept", "class", "fine", "classpath"]).join(left, "id", "left").select("id", "status", "dept", F.coalesce("attributes", F.lit(0)).alias("attributes"))


@query("SELECT item_id, count(*) AS n, min(label) AS first_label FROM (SELECT item_id, label FROM {answer_attrs} WHERE item_id % 2 = 0 UNION ALL SELECT item_id, label FROM {attrs} WHERE item_id NOT IN (SELECT item_id FROM {answer_attrs} WHERE item_id % 2 = 0)) z GROUP BY 1")
def replace_children(t):
    """Attributes after even items get those of their answers."""
    rows = W.replace_children(t.attrs, t.answer_attrs.where("item_id % 2 = 0"))
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"))


@query("SELECT coalesce(s.item_id, a.item_id) AS item_id, coalesce(a.upc, s.upc) AS upc, coalesce(a.list_price, s.list_price) AS list_price, s.length, s.warranty FROM {specs} s FULL JOIN {answer_specs} a ON a.item_id = s.item_id")
def merge_specs(t):
    """One row of specs an item, in which supplied codes and prices win."""
    return W.merge_specs(t.specs, t.answer_specs.select("item_id", "upc", "list_price")).select("item_id", "upc", "list_price", "length", "warranty")


@query("SELECT user_id, event_id AS first_event, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) z WHERE n = 1")
def stream_ingest(t):
    """A stream of events as feed files: the first of every user stays."""
    stream = J.read_files(t.spark, f"{t.folder}/events.parquet").select("user_id", "event_id", "event_type")
    last = J.ingest(stream, R.scratch(t.spark), "user_id", "event_id")
    return t.spark.read.parquet(last).select("user_id", F.col("event_id").alias("first_event"), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS errors FROM {events} GROUP BY 1")
def stream_daily_usage(t):
    """Attempts and errors of every day, from a stream."""
    return J.daily_usage(J.read_files(t.spark, f"{t.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM {events}), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events, arg_max(event_type, row(ts, event_id)) AS last_type FROM s GROUP BY user_id, k HAVING last_type <> 'purchase'""")
def stream_stale_items(t):
    """Users left without a purchase, ten minutes after their last event, from a stream."""
    return J.stale_items(J.read_files(t.spark, f"{t.folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
