"""Queries about canonical products, model answers and the life of catalog items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import answers as A
from ..operators import canonical as C
from ..operators import lifecycle as Q
from ..operators import normalize as N
from ..sources.files import scratch
from . import oracle as O
from .feed_queries import _MERGED
from .registry import query

FIELDS = "mfg_part_num manufacturer_name brand_name trade_name part_desc classpath dept upc ean weight length list_price warranty".split()
#: The moment that stands for now, in seconds.
NOW = 1704067200 + 200_000


@query(f"""WITH {_MERGED}, p AS (SELECT row_idx, field, status, uom, CASE WHEN status <> 'invalid' THEN value END AS v, CASE WHEN status <> 'invalid' THEN number END AS num FROM merged)
    SELECT row_idx, max(v) FILTER (field = 'mfg_part_num') AS mpn, max(v) FILTER (field = 'manufacturer_name') AS maker, max(v) FILTER (field = 'upc') AS upc, max(num) FILTER (field = 'weight') AS weight, max(uom) FILTER (field = 'weight') AS weight_uom,
      count(*) FILTER (status = 'verified') AS verified, 13 - count(*) FILTER (status <> 'unresolved') AS unresolved, round(sum(CASE WHEN v IS NOT NULL OR num IS NOT NULL THEN CASE WHEN status = 'verified' THEN 0.99 ELSE 0.5 END END), 4)::DOUBLE AS confidence FROM p GROUP BY row_idx""")
def seed_products(t):
    """The product that each feed row starts as."""
    seeds = C.seed_products(N.resolve_rows(t.feed, True), FIELDS)
    count = lambda s: F.size(F.map_filter("value_status", lambda k, v: v == s)).cast("long")
    total = F.aggregate(F.map_values("field_provenance"), F.lit(0.0), lambda a, x: a + x["confidence"])
    return seeds.select("row_idx", F.col("mfg_part_num").alias("mpn"), F.col("manufacturer_name").alias("maker"), "upc", F.col("weight").cast("double").alias("weight"), "weight_uom", count("verified").alias("verified"), count("unresolved").alias("unresolved"), F.round(total, 4).alias("confidence"))


def _products(t):
    return C.assemble(t.items, t.descs, t.attrs, t.specs, t.assets)


_A = "a AS (SELECT item_id, count(*) AS n, string_agg(label || '=' || value, ',' ORDER BY seq) AS text FROM {attrs} GROUP BY item_id)"


_KNOWN = " + ".join(f"(coalesce(trim({c}), '') <> '')::INTEGER" for c in ("i.mfg_part_num", "i.manufacturer_name", "i.brand_name", "i.dept", "i.class", "i.fine", "i.classpath"))
_GUESSED = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in ("s.upc", "s.ean", "s.list_price", "s.length", "s.weight", "s.warranty"))
_ASSETS = "x AS (SELECT item_id, string_agg(CASE asset_type WHEN 'product_image' THEN 'product_image' WHEN 'spec_sheet' THEN 'specification_sheet' WHEN 'Manual' THEN 'instruction_manual' ELSE 'reference_url' END || '=' || trim(url), ',' ORDER BY sort_order) AS text FROM {assets} WHERE trim(url) <> '' GROUP BY item_id), dn AS (SELECT item_id, count(*) AS n FROM {descs} WHERE trim(value) <> '' AND field_name <> 'item_features' GROUP BY item_id)"


@query(f"WITH {_A}, {_ASSETS} SELECT i.id, coalesce(a.n, 0) AS n_attributes, a.text AS attributes, d.value AS short_desc, s.list_price, s.warranty, x.text AS assets, ({_KNOWN})::BIGINT AS verified, ({_GUESSED} + coalesce(dn.n, 0))::BIGINT AS inferred FROM {{items}} i LEFT JOIN x ON x.item_id = i.id LEFT JOIN dn ON dn.item_id = i.id LEFT JOIN a ON a.item_id = i.id LEFT JOIN {{descs}} d ON d.item_id = i.id AND d.field_name = 'short_desc' LEFT JOIN {{specs}} s ON s.item_id = i.id")
def assemble_canonical(t):
    """Every item with its descriptions, attributes, specs and assets, and how many fields are verified and inferred."""
    count = lambda s: F.size(F.map_filter("value_status", lambda k, v: v == s)).cast("long").alias(s)
    assets = F.nullif(F.array_join(F.transform("assets", lambda a: F.concat(a["asset_type"], F.lit("="), a["url"])), ","), F.lit(""))
    text = F.array_join(F.transform("attributes", lambda a: F.concat(a["label"], F.lit("="), a["value"])), ",")
    return _products(t).select("id", F.size("attributes").cast("long").alias("n_attributes"), F.nullif(text, F.lit("")).alias("attributes"), F.try_element_at("descriptions", F.lit("short_desc")).alias("short_desc"), "specs.list_price", "specs.warranty", assets.alias("assets"), count("verified"), count("inferred"))


@query("""SELECT field, status, count(*) AS n FROM (SELECT unnest(['manufacturer_name', 'brand_name', 'dept']) AS field, unnest([CASE WHEN id % 4 = 0 THEN 'verified' WHEN manufacturer_name IS NULL THEN 'unresolved' ELSE 'inferred' END,
    CASE WHEN brand_name IS NULL THEN 'unresolved' ELSE 'inferred' END, CASE WHEN dept IS NULL THEN 'unresolved' ELSE 'inferred' END]) AS status FROM {items}) z GROUP BY 1, 2""")
def default_status(t):
    """Statuses of three fields after completion; every fourth item has a verified manufacturer."""
    explicit = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("manufacturer_name"), F.lit("verified")))
    rows = C.default_status(t.items.withColumn("value_status", explicit), ["manufacturer_name", "brand_name", "dept"])
    return rows.select(F.explode("value_status").alias("field", "status")).groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, count(seq) + (id % 3)::BIGINT AS n, CASE WHEN id % 3 = 0 THEN NULL ELSE 'added ' || (id % 3)::VARCHAR END AS last_value, CASE WHEN id % 3 = 0 THEN NULL ELSE 'http://s/' || id::VARCHAR END AS last_url, CASE WHEN id % 3 = 0 THEN 'none' ELSE 'inferred' END AS class_status
    FROM {items} i LEFT JOIN {attrs} a ON a.item_id = i.id GROUP BY id""")
def append_nested(t):
    """Attributes appended to two items in three, with where they come from, and a source for their class."""
    some = t.items.where("id % 3 > 0").select("id", F.expr("explode(sequence(1, int(id % 3)))").alias("pos"))
    source = F.struct(F.lit("external").alias("source_type"), F.concat(F.lit("http://s/"), F.col("id").cast("string")).alias("source_url"), F.lit(None).cast("string").alias("source_title"), F.lit("text").alias("evidence"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("retrieved_at"))
    more = some.select("id", "pos", F.lit("Added").alias("label"), F.concat(F.lit("added "), F.col("pos").cast("string")).alias("value"), source.alias("provenance"))
    rows = C.append_nested(_products(t), "attributes", more, "pos").withColumns({"field_provenance": F.create_map().cast(f"map<string,{C.PROVENANCE}>"), "value_status": F.create_map().cast("map<string,string>")})
    rows = C.add_provenance(rows, more.select("id", "pos", F.lit("class").alias("field"), "provenance"))
    last = F.try_element_at("attributes", F.lit(-1))
    added = lambda c: F.when(last["provenance"].isNotNull(), c)
    return rows.select("id", F.size("attributes").cast("long").alias("n"), added(last["value"]).alias("last_value"), added(last["provenance"]["source_url"]).alias("last_url"), F.coalesce(F.try_element_at("value_status", F.lit("class")), F.lit("none")).alias("class_status"))


_FEATURES = """named AS (SELECT item_id, list(value ORDER BY seq)[1:50] AS vs, list(label ORDER BY seq)[1:50] AS ns FROM {attrs} WHERE contains(lower(label), 'feature') GROUP BY item_id),
  parts AS (SELECT item_id, [trim(x) for x in string_split(value, ';') if trim(x) <> ''] AS vs FROM {descs} WHERE field_name = 'item_features'),
  features AS (SELECT i.id, CASE WHEN named.vs IS NOT NULL THEN named.ns ELSE ['Feature ' || x::VARCHAR for x in range(1, len(parts.vs) + 1)] END AS names, coalesce(named.vs, parts.vs) AS vs FROM {items} i LEFT JOIN named ON named.item_id = i.id LEFT JOIN parts ON parts.item_id = i.id)"""


@query(f"WITH {_FEATURES} SELECT id, coalesce(len(vs), 0) AS n, names[1] AS first_name, array_to_string(vs, '|') AS text FROM features")
def derive_features(t):
    """Features of every item, from attributes or from text."""
    rows = C.derive_features(_products(t))
    return rows.select("id", F.size("features").cast("long").alias("n"), F.get("features", F.lit(0))["name"].alias("first_name"), F.when(F.size("features") > 0, F.array_join(F.transform("features", lambda f: f["value"]), "|")).alias("text"))


_ASSET = ["product_image", "Spec_Sheet", "MANUAL", "brochure", "image_3", "mtr", None]
_MAPPED = ["product_image", "specification_sheet", "instruction_manual", "reference_url", "alternate_image", "MTR", "reference_url"]


@query("SELECT asset_type, count(*) AS n FROM (SELECT ([" + O.quoted(_MAPPED) + "])[(page_id % 7 + 1)::BIGINT] AS asset_type, page_id FROM {pages}) z WHERE page_id % 11 <> 0 GROUP BY 1")
def normalize_assets(t):
    """Page URLs as assets by canonical type."""
    names = F.array(*[F.lit(x) for x in _ASSET])
    assets = t.pages.select(F.get(names, (F.col("page_id") % 7).cast("int")).alias("asset_type"), F.when(F.col("page_id") % 11 == 0, F.lit(" ")).otherwise(F.col("url")).alias("url"))
    return C.normalize_assets(assets).groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"))


_SYN = "CASE l " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SYNONYMS.items()) + " ELSE l END"
_REL = " OR ".join(f"(cat = '{c}' AND (l IN ({O.quoted(names)}) OR canon IN ({O.quoted(names)})))" for c, names in L.RELEVANT.items())


@query(f"""WITH r AS (SELECT *, lower(trim(label)) AS l, row_number() OVER (PARTITION BY item_id, lower(trim(label)) ORDER BY seq) AS n FROM {{attrs}}),
    c AS (SELECT r.*, {_SYN} AS canon, coalesce(dept, split_part(classpath, '/', 1), 'other') AS cat FROM r JOIN {{items}} i ON i.id = item_id WHERE n = 1)
    SELECT item_id, seq, canon AS label, trim(value) AS value, trim(uom) AS uom FROM c WHERE (cat NOT IN ({O.quoted(L.RELEVANT)}) OR {_REL}) AND trim(value) <> '' AND NOT regexp_matches(lower(trim(value)), '{L.FAKE_VALUE}')""")
def category_attributes(t):
    """Attributes that count for each item's category."""
    return C.category_attributes(t.attrs, t.items)


@query("""WITH v AS (SELECT DISTINCT item_id FROM {attrs} WHERE contains(lower(label), 'voltage')), h AS (SELECT DISTINCT item_id FROM {attrs} WHERE contains(lower(label), 'horsepower') OR contains(lower(label), 'rpm'))
    SELECT i.id, array_to_string([x for x in [CASE WHEN upc IS NULL THEN 'upc' END, CASE WHEN ean IS NULL THEN 'ean' END, 'gtin', CASE WHEN coalesce(weight, 0) = 0 THEN 'weight' END, CASE WHEN warranty IS NULL THEN 'warranty' END, CASE WHEN coalesce(length, 0) = 0 THEN 'dimensions' END,
      CASE WHEN dept = 'electronics' AND v.item_id IS NULL THEN 'voltage' END, CASE WHEN dept = 'industrial' AND h.item_id IS NULL THEN 'horsepower' END] if x IS NOT NULL], ',') AS needed,
      array_to_string([x for x in [CASE WHEN coalesce(weight, 0) <> 0 THEN 'weight' END, CASE WHEN warranty IS NOT NULL THEN 'warranty' END, CASE WHEN coalesce(length, 0) <> 0 THEN 'dimensions' END] if x IS NOT NULL], ',') AS skip,
      array_to_string([x for x in [CASE WHEN upc IS NULL THEN 'UPC missing - will attempt external retrieval if evidence available' END, CASE WHEN ean IS NULL THEN 'EAN missing - will attempt external retrieval if evidence available' END, 'GTIN missing - will attempt external retrieval if evidence available',
        CASE WHEN coalesce(weight, 0) = 0 THEN 'weight missing - common field, worth external lookup' ELSE 'weight already present' END, CASE WHEN warranty IS NULL THEN 'warranty missing - critical field, always prioritize' ELSE 'warranty already present' END,
        CASE WHEN coalesce(length, 0) = 0 THEN 'dimensions missing - common for products' ELSE 'dimensions already present' END, CASE WHEN dept = 'electronics' AND v.item_id IS NULL THEN 'Voltage Rating - electronics category' END,
        CASE WHEN dept = 'industrial' AND h.item_id IS NULL THEN 'Horsepower/RPM - industrial category' END] if x IS NOT NULL], '; ') AS rationale
    FROM {items} i JOIN {specs} s ON s.item_id = i.id LEFT JOIN v ON v.item_id = i.id LEFT JOIN h ON h.item_id = i.id""")
def missing_fields(t):
    """What every item lacks, in order."""
    return C.missing_fields(_products(t)).select("id", F.array_join("needed", ",").alias("needed"), F.array_join("skip", ",").alias("skip"), F.array_join("rationale", "; ").alias("rationale"))


@query(f"WITH {_FEATURES}, y AS (SELECT item_id, string_agg(trim(label) || '=' || trim(value), ',' ORDER BY seq) AS text FROM {{attrs}} GROUP BY item_id), {_ASSETS} SELECT f.id, array_to_string([trim(v) for v in vs], '|') AS features, y.text AS attributes, x.text AS assets, CASE WHEN f.id % 7 <> 0 THEN i.confidence_score END AS confidence_score FROM features f JOIN {{items}} i ON i.id = f.id LEFT JOIN y ON y.item_id = f.id LEFT JOIN x ON x.item_id = f.id")
def clean_nested(t):
    """Trimmed features and attributes of every item."""
    rows = C.clean_nested(C.derive_features(_products(t)).withColumn("confidence_score", F.concat(F.col("confidence_score").cast("string"), F.when(F.col("id") % 7 == 0, "x").otherwise(""))))
    joined = lambda c, g, s: F.when(F.size(c) > 0, F.array_join(F.transform(c, g), s))
    return rows.select("id", joined("features", lambda f: f["value"], "|").alias("features"), joined("attributes", lambda a: F.concat(a["label"], F.lit("="), a["value"]), ",").alias("attributes"), joined("assets", lambda a: F.concat(a["asset_type"], F.lit("="), a["url"]), ",").alias("assets"), "confidence_score")


@query("""WITH e AS (SELECT product_id, substr(string_agg('source: ' || page_text, '; ' ORDER BY rnk), 1, 2000) AS evidence FROM {candidates} GROUP BY 1)
    SELECT i.id AS product_id, array_to_string([x for x in [CASE WHEN brand_name IS NULL THEN 'brand' END, CASE WHEN fine IS NULL THEN 'fine' END] if x IS NOT NULL], ', ') AS fields, evidence FROM {items} i JOIN e ON e.product_id = i.id WHERE brand_name IS NULL OR fine IS NULL""")
def build_requests(t):
    """What a model would be asked about every item with open needs."""
    needs = F.array_compact(F.array(F.when(F.col("brand_name").isNull(), "brand"), F.when(F.col("fine").isNull(), "fine")))
    lines = t.candidates.select("product_id", F.col("rnk").alias("pos"), F.lit("source").alias("field"), F.col("page_text").alias("text"))
    return A.build_requests(t.items.select(F.col("id").alias("product_id"), needs.alias("needs")), lines)


@query("""SELECT count(*) FILTER (brand_name IS NULL OR fine IS NULL) AS requests, count(*) FILTER (brand_name IS NOT NULL AND fine IS NOT NULL) AS avoided FROM {items} WHERE id IN (SELECT product_id FROM {candidates})""")
def build_requests_totals(t):
    """How many matched items a model is asked about, and how many need none."""
    needs = F.array_compact(F.array(F.when(F.col("brand_name").isNull(), "brand"), F.when(F.col("fine").isNull(), "fine")))
    return A.request_totals(t.items.select(F.col("id").alias("product_id"), needs.alias("needs")), t.candidates)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 0.8::DOUBLE END AS confidence, event_id % 5 = 4 AS failed FROM {events}""")
def parse_responses(t):
    """Event properties as model responses: bare, fenced, and broken JSON."""
    n = F.col("event_id") % 5
    text = F.when(n == 4, F.concat("props", F.lit("]"))).when(n == 3, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    rows = A.parse_responses(t.events.select("event_id", text.alias("response")), "k long, confidence double")
    return rows.select("event_id", "parsed.k", "parsed.confidence", F.col("parse_error").isNotNull().alias("failed"))


@query("""SELECT id AS product_id, 'brand' AS field, trim('3,5 of ' || class) AS value, 3.5::DOUBLE AS number, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, 'inferred' AS status FROM {items} WHERE brand_name IS NULL AND class IS NOT NULL
    UNION ALL SELECT id, 'fine', 'about ' || class, NULL, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE, 'inferred' FROM {items} WHERE fine IS NULL AND class IS NOT NULL""")
def apply_responses(t):
    """Answers that were asked for, with leading numbers read."""
    needs = t.items.select(F.col("id").alias("product_id"), F.array_compact(F.array(F.when(F.col("brand_name").isNull(), "brand"), F.when(F.col("fine").isNull(), "fine"))).alias("needs"))
    values = F.create_map(F.lit("brand"), F.concat(F.lit(" 3,5 of "), "class"), F.lit("fine"), F.concat(F.lit("about "), "class"), F.lit("dept"), F.lit("not asked"))
    return A.apply_responses(t.items.select(F.col("id").alias("product_id"), values.alias("values"), F.when(F.col("id") % 2 == 0, 0.9).alias("confidence")), needs)


_CODE = """CASE WHEN regexp_matches(error, 'status [0-9]{3}') THEN regexp_extract(error, 'status ([0-9]{3})', 1) WHEN contains(error, '429') THEN '429' WHEN contains(error, '503') THEN '503' WHEN contains(error, 'network') THEN 'NETWORK'
    WHEN contains(error, 'timeout') THEN 'TIMEOUT' WHEN contains(error, 'JSON parse error') THEN 'JSON_PARSE' ELSE 'UNKNOWN' END"""


def _mock_model(prompt: str) -> str:
    """Stands for a user's model: fails for every seventh product, and answers in capitals."""
    if int(prompt.split(" ", 1)[0]) % 7 == 0:
        raise RuntimeError("got 429 from the model")
    return prompt.upper()


@query("SELECT id AS product_id, CASE WHEN id % 7 = 0 THEN NULL ELSE upper(id::VARCHAR || ' ' || part_desc) END AS response, CASE WHEN id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN id % 7 = 0 THEN '429' END AS code, CASE WHEN id % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM {items} WHERE part_desc IS NOT NULL")
def ask_model(t):
    """The hook for a user's model, with a quota that is enough: a made-up model asked about every item; its failures as error codes."""
    path = scratch(t.spark)
    t.items.where("part_desc is not null").select(F.col("id").alias("product_id"), F.concat(F.col("id").cast("string"), F.lit(" "), "part_desc").alias("prompt")).write.parquet(path)
    requests = t.spark.read.parquet(path)
    return A.classify_errors(A.ask_model(requests, _mock_model, quota=3 * requests.count())).select("product_id", "response", "status", "code", "attempts")


@query(f"""SELECT code, safe_message, count(*) AS n, min('[' || code || '] Error after ' || attempts::VARCHAR || ' attempt(s): ' || error) AS first_message FROM (SELECT *, {_CODE} AS code, CASE WHEN contains(error, '429') THEN 'AI service rate limit reached.'
    WHEN contains(error, 'timeout') OR contains(error, 'network') THEN 'AI service network timeout.' ELSE 'Step failed.' END AS safe_message FROM {{logs}} WHERE status = 'error') z GROUP BY 1, 2""")
def classify_errors(t):
    """Failed steps by error code."""
    return A.classify_errors(t.logs).where("code is not null").groupBy("code", "safe_message").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("first_message"))


@query("SELECT item_id, step, input_hash, log_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, step, input_hash ORDER BY created_at DESC, log_id DESC) AS n FROM {logs} WHERE status = 'success') z WHERE n = 1")
def step_cache(t):
    """The latest success of every item, step and input."""
    return A.step_cache(t.logs).select("item_id", "step", "input_hash", "log_id")


@query("""SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY seq)::INTEGER AS seq, label, CASE WHEN regexp_full_match(value || ' ' || uom, '[0-9.]+ \\w+') THEN regexp_extract(value || ' ' || uom, '^([0-9.]+)\\s*(\\w+)$', 1) ELSE value END AS value, uom FROM {attrs} WHERE value <> ''""")
def attributes_from_responses(t):
    """Attributes of every item as a model would list them, numbered and split again."""
    lists = t.attrs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("seq", "label", "value", "uom"))).alias("attributes"))
    return A.attributes_from_responses(lists)


_MAX = "CASE field_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.MAX_LENGTHS.items()) + f" ELSE {L.DEFAULT_LENGTH} END"


@query(f"SELECT field_name, count(*) AS n, count(*) FILTER (length(value) > {_MAX}) AS cut, sum(least(length(value), {_MAX}))::BIGINT AS chars, max(CASE WHEN length(value) > {_MAX} THEN substr(value, 1, {_MAX} - 3) || '...' ELSE value END) AS last_value FROM {{descs}} GROUP BY field_name")
def enforce_lengths(t):
    """Descriptions cut to their limits, by field."""
    rows = A.enforce_lengths(t.descs.withColumn("before", F.length("value")))
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") > F.col("char_count")).alias("cut"), F.sum("char_count").alias("chars"), F.max("value").alias("last_value"))


@query("""SELECT row_idx, 'bolt ' || (p_size + (p_size % 3 + 1) / 4.0::DOUBLE)::VARCHAR || ' x ' || CASE WHEN p_size % 2 = 0 THEN '0.5' ELSE '0.25' END || ' in' AS text FROM {source_rows} t WHERE p_size % 3 + 1 < 4 AND p_size % 3 <> 3""")
def fractions_to_decimals(t):
    """Sizes written as fractions, as decimals."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("bolt "), size, F.lit("-"), (F.col("p_size") % 3 + 1).cast("string"), F.lit("/4 x "), F.when(F.col("p_size") % 2 == 0, "1/2").otherwise("1/4"), F.lit(" in"))
    return t.source_rows.select("row_idx", A.fractions_to_decimals(text).alias("text"))


@query("SELECT item_id, string_agg(label || ': ' || value || coalesce(' ' || uom, ''), '; ' ORDER BY seq) AS text FROM {attrs} GROUP BY item_id")
def attribute_text(t):
    """Attributes of every item as one line."""
    return A.attribute_text(t.attrs)


_SET = lambda c: f"coalesce(({c}::VARCHAR <> '' AND coalesce(TRY_CAST({c}::VARCHAR AS DOUBLE), 1) <> 0)::INTEGER, 0)"
_COMPLETE = f"""d AS (SELECT item_id, count(DISTINCT field_name) AS d FROM {{descs}} WHERE field_name IN ({O.quoted(Q.DESCRIPTION_SLOTS)}) AND value <> '' GROUP BY 1), a AS (SELECT item_id, least(count(*), 5) AS a FROM {{attrs}} GROUP BY 1),
  c AS (SELECT i.*, {' + '.join(_SET(f'i."{x}"') for x in Q.ITEM_SLOTS)} + coalesce(d, 0) + coalesce(a, 0) + {' + '.join(_SET(f's.{x}') for x in ('upc', 'length', 'weight', 'warranty'))} AS filled,
    {' AND '.join(_SET(f'i.{x}') + ' = 1' for x in L.CRITICAL_FIELDS)} AS critical FROM {{items}} i LEFT JOIN d ON d.item_id = i.id LEFT JOIN a ON a.item_id = i.id LEFT JOIN {{specs}} s ON s.item_id = i.id)"""


@query(f"WITH {_COMPLETE} SELECT id, filled::BIGINT AS filled, floor(filled * 100 / 21 + 0.5)::BIGINT AS score, CASE WHEN critical AND floor(filled * 100 / 21 + 0.5) >= 60 THEN 'enriched' ELSE 'review' END AS new_status FROM c")
def completeness(t):
    """Q01: how complete every item is."""
    return Q.completeness(t.items, t.descs, t.attrs, t.specs)


@query("SELECT i.id, coalesce(m, 0) / 100 AS field_confidence FROM {items} i LEFT JOIN (SELECT item_id, floor(avg(confidence) * 100 + 0.5) AS m FROM {logs} GROUP BY 1) l ON l.item_id = i.id")
def field_confidence(t):
    """Q02: mean confidence of every item's steps."""
    return Q.field_confidence(t.items, t.logs)


_ORD = "CASE step " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(L.STEPS)) + " END"


@query(f"SELECT item_id, step AS failed_step, error FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_ORD}, created_at, log_id) AS n FROM {{logs}} WHERE status = 'error') z WHERE n = 1")
def first_failure(t):
    """Q03: the step at which every failed item stopped."""
    return Q.first_failure(t.logs)


@query("""SELECT batch_id, count(*) FILTER (status IN ('enriched', 'review', 'failed')) AS processed, count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'review') AS needs_review, count(*) FILTER (status NOT IN ('enriched', 'review', 'failed')) AS skipped,
    round(avg(confidence_score) FILTER (status IN ('enriched', 'review', 'failed')), 4) AS avg_confidence FROM {items} GROUP BY 1""")
def batch_summary(t):
    """Q04: figures of every batch."""
    return Q.batch_summary(t.items)


@query("SELECT id FROM {items} WHERE status = 'raw' ORDER BY id LIMIT 14")
def quota_admission(t):
    """Q05: the raw items that a limit of 18 units a day, 3 of them used, admits."""
    return Q.quota_admission(t.items.where("status = 'raw'").select("id"), used=3, limit=18)


@query("SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(attempts)::BIGINT AS used, greatest(1000 - sum(attempts), 0)::BIGINT AS remaining, greatest(1000 - sum(attempts), 0) <= 100 AS near_limit, count(*) FILTER (matched AND needs = 0) AS avoided FROM {logs} GROUP BY 1")
def usage_summary(t):
    """Q06: attempts of every day against a limit of 1000."""
    return Q.usage_summary(t.logs, 1000)


_DONE = "[x for x in [" + O.quoted(L.STEPS) + "] if NOT coalesce(list_contains(done, x), false)][1]"


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, log_id DESC) AS n FROM {{logs}}), s AS (SELECT item_id, arg_min(status, n) AS ls, arg_min(step, n) AS lp, list(DISTINCT step) FILTER (status = 'success') AS done FROM n WHERE n <= 20 GROUP BY 1), {_COMPLETE},
    k AS (SELECT c.id, c.status, ls, lp, done, CASE WHEN c.status = 'review' THEN 'VALID_REVIEW' WHEN c.status = 'enriched' THEN CASE WHEN critical THEN 'VALID_ENRICHED' ELSE 'INVALID' END WHEN updated_at < {NOW - 600} THEN 'STALE' ELSE 'ACTIVE' END AS class FROM c LEFT JOIN s ON s.item_id = c.id WHERE c.status IN ('enriching', 'enriched', 'review'))
    SELECT id, class, CASE class WHEN 'STALE' THEN 'failed' WHEN 'INVALID' THEN 'review' ELSE status END AS new_status, CASE WHEN class = 'STALE' THEN CASE WHEN ls IS NULL THEN 'unknown' WHEN ls = 'error' THEN lp ELSE coalesce({_DONE}, 'finalize') END END AS failed_step FROM k""")
def reconcile_states(t):
    """Q07: what became of every item that is or was being enriched."""
    return Q.reconcile_states(t.items, t.logs, NOW)


@query("SELECT id, mfg_part_num, status, updated_at, (SELECT count(*) FROM {items} WHERE contains(lower(part_desc), 'bolt')) AS total, (SELECT ceil(count(*) / 20.0) FROM {items} WHERE contains(lower(part_desc), 'bolt'))::BIGINT AS total_pages FROM {items} WHERE contains(lower(part_desc), 'bolt') ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")
def list_items(t):
    """Q08: the second page of items that speak of bolts."""
    return Q.list_page(t.items, search="Bolt", page=2, size=20).select("id", "mfg_part_num", "status", "updated_at", "total", "total_pages")


@query(f"SELECT s.status, upper(s.status[1]) || s.status[2:] AS label, count(i.id) AS n FROM (SELECT unnest([{O.quoted([*L.STATUSES, 'unknown'])}]) AS status) s LEFT JOIN {{items}} i ON s.status = CASE WHEN i.status IN ({O.quoted(L.STATUSES)}) THEN i.status ELSE 'unknown' END GROUP BY 1, 2")
def status_counts(t):
    """Q09: items of every status."""
    return Q.status_counts(t.items)
