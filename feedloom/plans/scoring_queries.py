"""Queries that score items against the answer key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from . import oracle as O
from .registry import query


def _text(e: str, a: str) -> str:
    e, a = f"lower(trim(coalesce({e}::VARCHAR, '')))", f"lower(trim(coalesce({a}::VARCHAR, '')))"
    return f"CASE WHEN {e} = {a} THEN 'exact_match' WHEN {e} = '' THEN 'extra_in_output' WHEN {a} = '' THEN 'missing_in_output' WHEN 1 - levenshtein({e}, {a}) / greatest(length({e}), length({a})) >= 0.85 THEN 'close_match' ELSE 'mismatch' END"


def _num(e: str, a: str) -> str:
    return f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN 'exact_match' WHEN {e} IS NULL THEN 'extra_in_output' WHEN {a} IS NULL THEN 'missing_in_output' WHEN {e} = {a} THEN 'exact_match' WHEN abs({e} - {a}) / greatest(abs({e}), abs({a})) <= 0.05::DOUBLE THEN 'close_match' ELSE 'mismatch' END"


_PAIRS = "pairs AS MATERIALIZED (SELECT i.id AS item_id, a.answer_id FROM {items} i JOIN {answers} a ON a.mfg_part_num = i.mfg_part_num WHERE i.status IN ('enriched', 'review') AND i.id <> a.answer_id)"
_ATTR = f"""att AS MATERIALIZED (SELECT coalesce(e.item_id, a.item_id) AS item_id, 'attribute:' || coalesce(e.k, a.k) AS field_name,
  CASE WHEN a.k IS NULL THEN 'missing_in_output' WHEN e.k IS NULL THEN 'extra_in_output' WHEN (coalesce(e.uom, '') <> '' OR coalesce(a.uom, '') <> '') AND {_text('e.uom', 'a.uom')} <> 'exact_match' THEN {_text('e.uom', 'a.uom')} ELSE {_text('e.value', 'a.value')} END AS match_type
  FROM (SELECT item_id, lower(trim(label)) AS k, value, uom FROM {{answer_attrs}} WHERE item_id IN (SELECT item_id FROM pairs)) e
  FULL JOIN (SELECT item_id, k, value, uom FROM (SELECT item_id, lower(trim(label)) AS k, value, uom, row_number() OVER (PARTITION BY item_id, lower(trim(label)) ORDER BY seq DESC) AS n FROM {{attrs}} WHERE item_id IN (SELECT item_id FROM pairs)) z WHERE n = 1) a ON a.item_id = e.item_id AND a.k = e.k)"""
_PARTS = [f"SELECT p.item_id, '{c}' AS field_name, {_text(f'a."{c}"', f'i."{c}"')} AS match_type FROM pairs p JOIN {{items}} i ON i.id = p.item_id JOIN {{answers}} a ON a.item_id = p.item_id" for c in S.ITEM_FIELDS]
_PARTS += [f"SELECT p.item_id, 'description:{c}', {_text('e.value', 'd.value')} FROM pairs p LEFT JOIN {{answer_descs}} e ON e.item_id = p.item_id AND e.field_name = '{c}' LEFT JOIN {{descs}} d ON d.item_id = p.item_id AND d.field_name = '{c}'" for c in S.DESCRIPTION_FIELDS]
_PARTS += [f"SELECT p.item_id, 'spec:{c}', {(_num if c in S.NUMBER_SPECS else _text)(f'e.{c}', f's.{c}')} FROM pairs p JOIN {{answer_specs}} e ON e.item_id = p.item_id JOIN {{specs}} s ON s.item_id = p.item_id" for c in ("upc", "ean", "list_price", "length", "weight", "warranty")]
_SCORES = f"{_PAIRS}, {_ATTR}, scores AS MATERIALIZED ({' UNION ALL '.join(_PARTS)} UNION ALL SELECT * FROM att)"
_OK = "count(*) FILTER (match_type IN ('exact_match', 'close_match'))"
_GROUP = "CASE WHEN field_name IN ('manufacturer_name', 'brand_name') THEN 'identity' WHEN field_name IN ('dept', 'class', 'fine', 'classpath') THEN 'taxonomy' WHEN field_name LIKE 'description:%' THEN 'descriptions' WHEN field_name LIKE 'attribute:%' THEN 'attributes' ELSE 'specs' END"
_PCT = lambda a, b, z: f"CASE WHEN {b} > 0 THEN floor(100 * {a} / {b} + 0.5) ELSE {z} END::BIGINT"
_OVERALL = f"{_SCORES}, overall AS (SELECT item_id, {_OK} AS matched, count(*) AS total, {_PCT(_OK, 'count(*)', 0)} AS accuracy_pct FROM scores GROUP BY item_id)"


def scores(t):
    return S.field_scores(S.pair_items(t.items, t.answers), t.items, t.answers, t.descs, t.answer_descs, t.attrs, t.answer_attrs, t.specs, t.answer_specs)


def overall(t):
    return S.overall_score(scores(t), t.items)


@query(f"SELECT field_name, {_text('e.value', 'd.value')} AS match_type, count(*) AS n FROM {{descs}} d JOIN {{answer_descs}} e ON e.item_id = d.item_id AND e.field_name = d.field_name GROUP BY ALL".replace("SELECT field_name", "SELECT d.field_name"))
def compare_strings(t):
    """Descriptions against the answers, by field and kind of match."""
    both = t.descs.join(t.answer_descs.withColumnRenamed("value", "expected"), ["item_id", "field_name"])
    return both.groupBy("field_name", S.compare_strings(F.col("expected"), F.col("value")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field_name, {_num(f'e.{c}', f's.{c}')} AS match_type, count(*) AS n FROM {{specs}} s JOIN {{answer_specs}} e ON e.item_id = s.item_id GROUP BY 2" for c in ("list_price", "length", "weight")))
def compare_numbers(t):
    """Numbers against the answers, by field and kind of match."""
    names = ["list_price", "length", "weight"]
    both = t.specs.join(t.answer_specs.select("item_id", *[F.col(c).alias(f"e_{c}") for c in names]), "item_id")
    rows = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), S.compare_numbers(F.col(f"e_{c}"), F.col(c)).alias("match_type")) for c in names])))
    return rows.groupBy("field_name", "match_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS}, {_ATTR} SELECT field_name, match_type, count(*) AS n FROM att GROUP BY 1, 2")
def compare_attributes(t):
    """Attributes of paired items against the answers, by label and kind of match."""
    ids = S.pair_items(t.items, t.answers).select("item_id")
    rows = S.compare_attributes(t.answer_attrs.join(ids, "item_id", "left_semi"), t.attrs.join(ids, "item_id", "left_semi"))
    return rows.groupBy("field_name", "match_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORES} SELECT * FROM scores")
def field_scores(t):
    """Every field of every paired item."""
    return scores(t)


@query(f"WITH {_SCORES}, g AS (SELECT item_id, {_GROUP} AS g, {_OK} AS m, count(*) AS n FROM scores GROUP BY 1, 2) SELECT i.item_id, i.g AS \"group\", coalesce(m, 0) AS matched, coalesce(n, 0) AS total, {_PCT('coalesce(m, 0)', 'coalesce(n, 0)', 100)} AS accuracy_pct FROM (SELECT DISTINCT item_id, unnest([{O.quoted(S.GROUPS)}]) AS g FROM scores) i LEFT JOIN g ON g.item_id = i.item_id AND g.g = i.g")
def group_scores(t):
    """Five groups of fields of every paired item."""
    return S.group_scores(scores(t))


@query(f"""WITH {_SCORES}, g AS (SELECT item_id, {_GROUP} AS g, {_OK} AS m, count(*) AS n, count(*) FILTER (match_type = 'missing_in_output') AS missing, count(*) FILTER (match_type = 'mismatch') AS mismatch FROM scores GROUP BY 1, 2)
    SELECT g.item_id, g AS "group", CASE g WHEN 'identity' THEN CASE WHEN missing >= 2 THEN 'input_too_sparse' ELSE 'requires_external_source' END
      WHEN 'taxonomy' THEN CASE WHEN coalesce(a.fine <> i.fine AND (contains(a.fine, i.fine) OR contains(i.fine, a.fine)), false) OR mismatch > 0 THEN 'taxonomy_granularity_mismatch' ELSE 'input_too_sparse' END
      WHEN 'descriptions' THEN CASE WHEN missing > 0 OR mismatch > 0 THEN 'input_too_sparse' ELSE 'requires_external_source' END WHEN 'attributes' THEN CASE WHEN missing >= n * 0.7 THEN 'requires_external_source' ELSE 'input_too_sparse' END ELSE 'requires_external_source' END AS reason
    FROM g JOIN {{items}} i ON i.id = g.item_id JOIN {{answers}} a ON a.item_id = g.item_id WHERE floor(100 * m / n + 0.5) < 50""")
def reason_tags(t):
    """Why groups of fields score below half."""
    return S.reason_tags(scores(t), t.items, t.answers)


@query(f"""WITH {_OVERALL} SELECT o.*, CASE WHEN confidence_score < 60 AND accuracy_pct < 50 THEN 'low and inaccurate' WHEN confidence_score >= 80 AND accuracy_pct >= 80 THEN 'high and accurate' WHEN confidence_score < 60 AND accuracy_pct >= 70 THEN 'conservative'
    WHEN confidence_score >= 80 AND accuracy_pct < 50 THEN 'overconfident' ELSE 'moderate' END AS note FROM overall o JOIN {{items}} i ON i.id = o.item_id""")
def overall_score(t):
    """Accuracy of every paired item."""
    return overall(t)


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_items(t):
    """Enriched items and their answers."""
    return S.pair_items(t.items, t.answers)


@query(f"WITH {_SCORES} SELECT field_name, {_PCT(_OK, 'count(*)', 0)} AS accuracy_pct, count(*) AS n FROM scores GROUP BY 1")
def field_accuracy(t):
    """Accuracy of every field."""
    return S.field_accuracy(scores(t))


_LIMIT = ", ".join(f"('{k}', {v})" for k, v in S.LIMITS.items())


@query(f"SELECT l.f AS field_name, CASE WHEN count(d.item_id) > 0 THEN floor(100 * count(*) FILTER (char_count <= most) / count(d.item_id) + 0.5) ELSE 100 END::BIGINT AS compliant_pct FROM (VALUES {_LIMIT}) l(f, most) LEFT JOIN {{descs}} d ON d.field_name = l.f GROUP BY 1")
def length_compliance(t):
    """Share of descriptions within their limits."""
    return S.length_compliance(t.descs)


@query(f"""WITH {_PAIRS}, l AS (SELECT item_id, label, arg_max(value, seq) AS v FROM {{answer_attrs}} GROUP BY 1, 2), h AS (SELECT count(*) AS total, count(*) FILTER (l.v = a.value AND l.v <> '') AS matched FROM {{attrs}} a LEFT JOIN l ON l.item_id = a.item_id AND l.label = a.label WHERE a.item_id IN (SELECT item_id FROM pairs))
    SELECT total, matched, {_PCT('matched', 'total', 100)} AS compliance_pct FROM h""")
def value_compliance(t):
    """Attributes whose label and value are those of the answer."""
    ids = S.pair_items(t.items, t.answers).select("item_id")
    return S.value_compliance(t.attrs.join(ids, "item_id", "left_semi"), t.answer_attrs)


@query(f"""WITH {_OVERALL}, b AS (SELECT CASE WHEN accuracy_pct <= 20 THEN '0-20' WHEN accuracy_pct <= 40 THEN '21-40' WHEN accuracy_pct <= 60 THEN '41-60' WHEN accuracy_pct <= 80 THEN '61-80' ELSE '81-100' END AS bin, count(*) AS n, count(*) FILTER (accuracy_pct >= 80) AS ok FROM overall GROUP BY 1)
    SELECT v.bin, coalesce(n, 0) AS n, {_PCT('coalesce(ok, 0)', 'coalesce(n, 0)', 0)} AS correct_pct FROM (SELECT unnest([{O.quoted(S.BINS)}]) AS bin) v LEFT JOIN b ON b.bin = v.bin""")
def calibration(t):
    """Items by accuracy."""
    return S.calibration(S.accuracy(scores(t)))


@query(f"""WITH {_OVERALL}, fa AS (SELECT field_name, {_PCT(_OK, 'count(*)', 0)} AS p FROM scores GROUP BY 1),
    lc AS (SELECT l.f, CASE WHEN count(d.item_id) > 0 THEN floor(100 * count(*) FILTER (char_count <= most) / count(d.item_id) + 0.5) ELSE 100 END::BIGINT AS p FROM (VALUES {_LIMIT}) l(f, most) LEFT JOIN (SELECT * FROM {{descs}} WHERE item_id IN (SELECT item_id FROM pairs)) d ON d.field_name = l.f GROUP BY 1),
    la AS (SELECT item_id, label, arg_max(value, seq) AS v FROM {{answer_attrs}} GROUP BY 1, 2), h AS (SELECT count(*) AS total, count(*) FILTER (la.v = a.value AND la.v <> '') AS matched FROM {{attrs}} a LEFT JOIN la ON la.item_id = a.item_id AND la.label = a.label WHERE a.item_id IN (SELECT item_id FROM pairs)),
    b AS (SELECT CASE WHEN accuracy_pct <= 20 THEN '0-20' WHEN accuracy_pct <= 40 THEN '21-40' WHEN accuracy_pct <= 60 THEN '41-60' WHEN accuracy_pct <= 80 THEN '61-80' ELSE '81-100' END AS bin, count(*) AS n, count(*) FILTER (accuracy_pct >= 80) AS ok FROM overall GROUP BY 1),
    c AS (SELECT v.bin, coalesce(n, 0) AS n, {_PCT('coalesce(ok, 0)', 'coalesce(n, 0)', 0)} AS p FROM (SELECT unnest(['0-20', '21-40', '41-60', '61-80', '81-100']) AS bin) v LEFT JOIN b ON b.bin = v.bin)
    SELECT (SELECT count(*) FROM overall) AS items_scored, (SELECT coalesce(floor(avg(accuracy_pct) + 0.5), 0)::BIGINT FROM overall) AS avg_accuracy_pct, (SELECT string_agg(field_name || '=' || p::VARCHAR, ',' ORDER BY field_name) FROM fa) AS field_accuracy,
      (SELECT string_agg(f || '=' || p::VARCHAR, ',' ORDER BY f) FROM lc) AS length_compliance, (SELECT {_PCT('matched', 'total', 100)} FROM h) AS value_compliance_pct, (SELECT string_agg(bin || ':' || n::VARCHAR || ':' || p::VARCHAR, ',' ORDER BY bin) FROM c) AS calibration""")
def batch_score(t):
    """One row for the batch, with all its parts."""
    ids = S.pair_items(t.items, t.answers).select("item_id")
    row = S.batch_score(scores(t), t.items, t.descs.join(ids, "item_id", "left_semi"), t.attrs.join(ids, "item_id", "left_semi"), t.answer_attrs)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(m)
    bins = F.array_join(F.transform("calibration", lambda b: F.concat(b["bin"], F.lit(":"), b["n"].cast("string"), F.lit(":"), b["correct_pct"].cast("string"))), ",")
    return row.select("items_scored", "avg_accuracy_pct", text("field_accuracy"), text("length_compliance"), "value_compliance_pct", bins.alias("calibration"))
