"""Views over the driver tables in the shapes the operators work on; the SQL runs on Spark and DuckDB alike.

``feed`` is a supplier feed made from part, supplier and lineitem: part numbers in several
spellings, vendor codes, placeholders, measures with units, barcodes with right and wrong check
digits, conflicting columns, and every 25th row a repeat of the row before. The other views are
the catalog tables, answer keys, evidence and logs that belong to it.
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_UPC = "lpad(cast((row_idx * 7919 + 10007) % 99999999999 as string), 11, '0')"
_ODD = " + ".join(f"cast(substr(u, {i}, 1) as int)" for i in (1, 3, 5, 7, 9, 11))
_EVEN = " + ".join(f"cast(substr(u, {i}, 1) as int)" for i in (2, 4, 6, 8, 10))

VIEWS: dict[str, str] = {}
VIEWS["source_rows"] = f"""
    SELECT row_idx, k, p_name, p_brand, p_type, p_size, p_retailprice, s_name, s_suppkey, {_UPC} AS u
    FROM (SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 25 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS k FROM {{part}}) r
    JOIN {{part}} p ON p.p_partkey = r.k
    LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM {{lineitem}} GROUP BY l_partkey) f ON f.l_partkey = r.k
    LEFT JOIN {{supplier}} s ON s.s_suppkey = f.sk
"""
VIEWS["feed"] = f"""
    SELECT row_idx,
      CASE WHEN row_idx % 10 = 1 THEN 'p-' || lpad(cast(k as string), 6, '0') WHEN row_idx % 10 = 2 THEN ' P ' || lpad(cast(k as string), 6, '0')
           WHEN row_idx % 10 = 3 THEN 'P' || lpad(cast(k as string), 6, '0') WHEN row_idx % 20 = 4 THEN '' WHEN row_idx % 20 = 7 THEN 'N/A'
           ELSE 'P-' || lpad(cast(k as string), 6, '0') END AS MPN,
      CASE WHEN row_idx % 13 = 5 THEN NULL WHEN row_idx % 3 = 0 THEN s_name || ' Inc (' || cast(1000 + s_suppkey as string) || ')'
           WHEN row_idx % 3 = 1 THEN s_name || ', Co.' ELSE upper(s_name) END AS MFR,
      CASE WHEN k % 6 = 0 THEN '-- Unbranded --' WHEN k % 6 = 1 THEN ' ' || p_brand || ' ' ELSE p_brand END AS Brand_Name,
      CASE WHEN k % 4 = 0 THEN p_brand WHEN k % 4 = 1 THEN p_brand || ' Pro' ELSE NULL END AS Trade_Name,
      CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN p_name ELSE p_name || ' ' || lower(p_type) || ' size ' || cast(p_size as string) END AS Part_Desc,
      CASE WHEN k % 4 = 0 THEN 'tools/' || lower(p_type) ELSE lower(p_type) END AS Category,
      CASE WHEN k % 5 = 0 THEN 'electronics' WHEN k % 5 = 1 THEN 'industrial' WHEN k % 5 = 2 THEN 'tools' ELSE NULL END AS Dept,
      CASE WHEN row_idx % 5 = 0 THEN u || cast((11 - (3 * ({_ODD}) + ({_EVEN})) % 10) % 10 as string)
           WHEN row_idx % 7 = 0 THEN substr(u, 1, 4) || '-' || substr(u, 5, 7) || '-' || cast((10 - (3 * ({_ODD}) + ({_EVEN})) % 10) % 10 as string)
           WHEN row_idx % 11 = 0 THEN NULL ELSE u || cast((10 - (3 * ({_ODD}) + ({_EVEN})) % 10) % 10 as string) END AS UPC_Code,
      CASE WHEN row_idx % 3 = 0 THEN '0' || u || cast((10 - (3 * ({_ODD}) + ({_EVEN})) % 10) % 10 as string) WHEN row_idx % 3 = 1 THEN '12345' ELSE NULL END AS EAN,
      CASE WHEN row_idx % 5 = 0 THEN cast(p_size as string) || '.5 kg' WHEN row_idx % 5 = 1 THEN cast(p_size as string) || ' lb' WHEN row_idx % 5 = 2 THEN '1,' || lpad(cast(p_size as string), 3, '0')
           WHEN row_idx % 5 = 3 THEN 'heavy-ish' ELSE NULL END AS Weight,
      CASE WHEN row_idx % 4 = 0 THEN cast(p_size as string) WHEN row_idx % 4 = 1 THEN cast(p_size as string) || ' lb' ELSE NULL END AS Net_Weight,
      CASE WHEN row_idx % 6 = 0 THEN NULL ELSE cast(p_size * 10 as string) END AS Length,
      CASE WHEN row_idx % 2 = 0 THEN 'mm' ELSE '-' END AS Length_UOM,
      CASE WHEN row_idx % 17 = 0 THEN 'call' ELSE cast(cast(p_retailprice as decimal(12,2)) as string) END AS List_Price,
      CASE WHEN row_idx % 9 = 0 THEN cast(cast(p_retailprice + 1 as decimal(12,2)) as string) WHEN row_idx % 2 = 0 THEN cast(cast(p_retailprice as decimal(12,2)) as string) ELSE NULL END AS MSRP,
      CASE WHEN row_idx % 8 = 0 THEN '2 years limited' WHEN row_idx % 8 = 1 THEN 'TBD' ELSE NULL END AS Warranty,
      'M' || cast(k % 7 as string) AS Model, 'A' || cast(row_idx % 3 as string) AS Warehouse_Location
    FROM {{source_rows}} t
"""
#: The catalog: one item per feed row, with the state of an enrichment run.
VIEWS["items"] = """
    SELECT row_idx AS id, 'P-' || lpad(cast(row_idx as string), 6, '0') AS mfg_part_num, p_name || ' ' || lower(p_type) AS part_desc,
      CASE WHEN row_idx % 13 = 5 THEN NULL ELSE s_name END AS manufacturer_name, CASE WHEN row_idx % 6 = 0 THEN NULL ELSE p_brand END AS brand_name,
      CASE WHEN row_idx % 5 = 0 THEN 'electronics' WHEN row_idx % 5 = 1 THEN 'industrial' WHEN row_idx % 5 = 2 THEN 'tools' ELSE NULL END AS dept,
      CASE WHEN row_idx % 7 = 0 THEN NULL ELSE lower(p_type) END AS class, CASE WHEN row_idx % 8 = 0 THEN NULL ELSE 'fine ' || cast(p_size as string) END AS fine,
      CASE WHEN row_idx % 9 = 0 THEN NULL ELSE lower(p_type) || '/' || cast(p_size as string) END AS classpath,
      CASE WHEN row_idx % 6 = 1 THEN 'raw' WHEN row_idx % 6 = 2 THEN 'enriching' WHEN row_idx % 6 = 3 THEN 'review' WHEN row_idx % 6 = 4 THEN 'failed' WHEN row_idx % 66 = 5 THEN 'odd' ELSE 'enriched' END AS status,
      cast(row_idx % 101 as double) AS confidence_score, row_idx % 10 = 3 AS is_ground_truth, row_idx % 4 AS batch_id,
      1704067200 + (row_idx * 7) % 4000 * 60 AS updated_at
    FROM {source_rows} t
"""
VIEWS["descs"] = """
    SELECT id AS item_id, field_name, value, cast(length(value) as int) AS char_count FROM (
      SELECT id, 'invoice_desc' AS field_name, upper(part_desc) AS value FROM {items} i WHERE id % 10 <> 1
      UNION ALL SELECT id, 'mobile_desc', part_desc || ' by ' || coalesce(manufacturer_name, 'n/a') || ' for general and professional use in all trades' FROM {items} i WHERE id % 4 <> 1
      UNION ALL SELECT id, 'short_desc', part_desc || ' ' || coalesce(brand_name, '') FROM {items} i WHERE id % 3 <> 1
      UNION ALL SELECT id, 'long_desc1', CASE WHEN id % 5 = 0 THEN repeat(part_desc || '; ', 40) ELSE part_desc END FROM {items} i WHERE id % 7 <> 0
      UNION ALL SELECT id, 'item_features', part_desc || ' ; strong;; light ' FROM {items} i WHERE id % 2 = 0) d
"""
VIEWS["attrs"] = """
    SELECT item_id, seq, label, value, uom FROM (
      SELECT l_partkey AS item_id, cast(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey) as int) AS seq,
        CASE l_linenumber WHEN 1 THEN 'Voltage' WHEN 2 THEN 'Voltage Rating' WHEN 3 THEN 'Color' WHEN 4 THEN 'Horsepower' WHEN 5 THEN ' Material ' WHEN 6 THEN 'Feature Grip' ELSE 'Status' END AS label,
        CASE WHEN l_orderkey % 9 = 0 THEN 'TBD' WHEN l_orderkey % 9 = 1 THEN '' ELSE cast(cast(l_quantity as int) as string) END AS value,
        CASE l_returnflag WHEN 'A' THEN 'V' WHEN 'N' THEN 'mm' ELSE NULL END AS uom
      FROM {lineitem} l) a WHERE seq <= 50
"""
VIEWS["specs"] = """
    SELECT row_idx AS item_id, CASE WHEN row_idx % 5 = 0 THEN NULL ELSE u || '0' END AS upc, CASE WHEN row_idx % 3 = 0 THEN '0' || u || '1' ELSE NULL END AS ean,
      CASE WHEN row_idx % 17 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS list_price, CASE WHEN row_idx % 4 = 0 THEN NULL ELSE cast(p_size * 10 as double) END AS length,
      CASE WHEN row_idx % 4 = 1 THEN cast(0 as double) ELSE cast(p_size as double) END AS weight, CASE WHEN row_idx % 8 = 0 THEN '2 years limited' ELSE NULL END AS warranty
    FROM {source_rows} t
"""
VIEWS["assets"] = """
    SELECT id AS item_id, CASE WHEN id % 3 = 0 THEN 'product_image' WHEN id % 3 = 1 THEN 'spec_sheet' ELSE 'brochure' END AS asset_type,
      CASE WHEN id % 12 = 0 THEN '' WHEN id % 10 = 7 THEN NULL ELSE 'http://files.example/' || cast(id as string) END AS url, cast(1 as int) AS sort_order FROM {items} i WHERE id % 5 <> 4
    UNION ALL SELECT id, 'Manual', ' http://files.example/m' || cast(id as string) || ' ', cast(2 as int) FROM {items} i WHERE id % 2 = 0
"""
#: The answer key of every item that is not itself part of it, with deterministic edits.
VIEWS["answers"] = """
    SELECT id AS item_id, 100000000 + id AS answer_id, mfg_part_num, CASE WHEN id % 7 = 0 THEN manufacturer_name || 'x' WHEN id % 7 = 1 THEN 'Other Works' ELSE upper(manufacturer_name) END AS manufacturer_name,
      CASE WHEN id % 5 = 0 THEN NULL ELSE brand_name END AS brand_name, dept, CASE WHEN id % 3 = 0 THEN 'built-in ' || class ELSE class END AS class, CASE WHEN id % 4 = 0 THEN 'fine' ELSE fine END AS fine,
      CASE WHEN id % 6 = 0 THEN 'elsewhere' ELSE classpath END AS classpath
    FROM {items} i WHERE id % 10 <> 3
"""
VIEWS["answer_descs"] = "SELECT item_id, field_name, CASE WHEN item_id % 3 = 0 THEN value || '.' WHEN item_id % 3 = 1 THEN 'entirely different words' ELSE value END AS value FROM {descs} d WHERE item_id % 10 <> 3 AND field_name <> 'item_features' AND item_id % 11 <> 0"
VIEWS["answer_attrs"] = "SELECT item_id, seq, CASE WHEN seq % 6 = 0 THEN label || ' X' ELSE upper(label) END AS label, CASE WHEN seq % 4 = 0 THEN value || '0' ELSE value END AS value, CASE WHEN seq % 5 = 0 THEN 'kg' ELSE uom END AS uom FROM {attrs} a WHERE item_id % 10 <> 3"
VIEWS["answer_specs"] = "SELECT item_id, upc, CASE WHEN item_id % 2 = 0 THEN ean ELSE NULL END AS ean, CASE WHEN item_id % 3 = 0 THEN list_price * cast(1.04 as double) WHEN item_id % 3 = 1 THEN list_price * 2 ELSE list_price END AS list_price, length, weight + item_id % 2 AS weight, warranty FROM {specs} s WHERE item_id % 10 <> 3"
#: Step logs from events: item = user, step by event, errors from event_type.
VIEWS["logs"] = """
    SELECT event_id AS log_id, user_id AS item_id, CASE event_id % 6 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'classify' WHEN 2 THEN 'external_evidence' WHEN 3 THEN 'attributes' WHEN 4 THEN 'descriptions' ELSE 'specs' END AS step,
      CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 7 = 0 THEN 'request failed: status 418 now' WHEN event_id % 7 = 1 THEN 'got 429' WHEN event_id % 7 = 2 THEN 'network down' WHEN event_id % 7 = 3 THEN 'timeout hit'
           WHEN event_id % 7 = 4 THEN 'JSON parse error at 3' WHEN event_id % 7 = 5 THEN 'upstream 503' ELSE 'odd failure' END AS error,
      'h' || cast(event_id % 4 as string) AS input_hash, CASE WHEN event_type = 'view' THEN NULL ELSE round(value / 100, 4) END AS confidence,
      event_type = 'purchase' AS matched, event_id % 3 AS needs, cast(event_id % 4 + 1 as int) AS attempts, ts AS created_at
    FROM {events} e
"""
#: Sources found for a product: suppliers of its part, with page text that may name another part.
VIEWS["candidates"] = """
    SELECT product_id, rnk, tier, url, manufacturer, mpn, brand, page_text FROM (
      SELECT l_partkey AS product_id, cast(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as int) AS rnk,
        CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 2 END AS tier,
        CASE l_linenumber WHEN 1 THEN 'https://www.3m.com/p/' WHEN 2 THEN 'http://grainger.com/x/' WHEN 3 THEN 'https://notgrainger.com/' WHEN 4 THEN 'ftp://ul.com/' WHEN 5 THEN 'http://10.0.0.8/' WHEN 6 THEN 'https://docs.iso.org/' ELSE 'http://localhost/' END || cast(l_orderkey as string) AS url,
        s_name AS manufacturer, 'P-' || lpad(cast(l_partkey as string), 6, '0') AS mpn, p_brand AS brand,
        CASE WHEN l_orderkey % 5 = 0 THEN 'Product page. MPN: X' || cast(l_orderkey as string) || 'Z by ' || s_name || '.'
             WHEN l_orderkey % 5 = 1 THEN s_name || ' ' || p_brand || ' quality ' || p_name || ' Weight: ' || cast(p_size as string) || '.5 lbs. Length: ' || cast(p_size * 10 as string) || ' mm Width: 2 in'
             WHEN l_orderkey % 5 = 2 THEN 'MPN: P-' || lpad(cast(l_partkey as string), 6, '0') || ' from an unnamed maker. Pack of 10 screws. Warranty: 2 years limited.'
             WHEN l_orderkey % 5 = 3 THEN ''
             ELSE 'Part Number: P-' || lpad(cast(l_partkey as string), 6, '0') || ' ' || s_name || ' UPC: ' || lpad(cast(l_partkey as string), 12, '1') || ' Voltage Rating: 24 V Current: 2 A Power: 48 W Weight: ' || cast(p_size as string) || ' kg Temperature: 86 F' END AS page_text
      FROM {lineitem} l JOIN {part} p ON p_partkey = l_partkey JOIN {supplier} s ON s_suppkey = l_suppkey) c
"""
#: Candidate values of product fields by source, for conflict resolution.
VIEWS["field_values"] = """
    SELECT l_partkey AS product_id, CASE l_linenumber % 3 WHEN 0 THEN 'weight' WHEN 1 THEN 'brand' ELSE 'upc' END AS field,
      l_orderkey * 10 + l_linenumber AS pos,
      CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN cast(l_partkey % 3 as string) || CASE WHEN l_orderkey % 2 = 0 THEN '.40' ELSE '.4' END
           WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'Acme Corp' ELSE ' acme  corp ' END ELSE 'u' || cast(l_orderkey % 4 as string) END AS value,
      CASE l_returnflag WHEN 'A' THEN 'external' WHEN 'N' THEN 'input' ELSE 'inferred' END AS authority, round(l_discount * 10, 2) AS confidence
    FROM {lineitem} l
"""

_USED = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"
_PLACE = "cast(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as int) AS rnk"
_JOINED = "{lineitem} l JOIN {part} p ON p_partkey = l_partkey JOIN {supplier} s ON s_suppkey = l_suppkey"
#: The same rows in another form for Spark, which carries all that stands beside a window function through its shuffle: texts are put together after it.
PLANNED = {"candidates": VIEWS["candidates"].replace(_PLACE, "rnk").replace(_JOINED, f"(SELECT l_partkey, {_USED}, s_name, p_name, p_brand, p_size, {_PLACE} FROM {_JOINED})")}
