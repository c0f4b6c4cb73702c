"""Evidence: which sources to ask, which pages to trust, and the facts in their text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X
from ..functions.html import sanitize as sanitize
from ..sources.files import scratch


def evidence_requests(products: DataFrame) -> DataFrame:
    """(product_id, tier, query): up to three searches per product, in order; none where identity is too weak."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    one = F.when(have("manufacturer") & have("mpn"), F.concat("manufacturer", F.lit(" "), "mpn", F.lit(" product specifications")))
    two = F.when(have("brand") & have("mpn"), F.concat("brand", F.lit(" "), "mpn", F.lit(" datasheet")))
    three = F.when(have("manufacturer") & (F.length(F.trim("description")) > 30), F.concat("manufacturer", F.lit(" "), F.substring("description", 1, 80)))
    return products.select("product_id", F.posexplode(F.array_compact(F.array(one, two, three))).alias("tier", "query"))


def select_candidates(found: DataFrame, most: int = 3) -> DataFrame:
    """(product_id, tier, rnk, url) → the first ``most`` results of the first tier with any, by authority; adds attempt (from 1)."""
    by_product = Window.partitionBy("product_id")
    first = found.withColumn("_t", F.min("tier").over(by_product)).where("tier = _t").withColumn("_n", F.row_number().over(by_product.orderBy("rnk")))
    first = classify_sources(first.where(F.col("_n") <= most).drop("_t", "_n"))
    return first.withColumn("attempt", F.row_number().over(by_product.orderBy("authority_tier", "rnk")))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and brackets; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit(""))


def classify_sources(pages: DataFrame, domains: dict[str, list[str]] = L.SOURCE_DOMAINS) -> DataFrame:
    """Adds source_type and authority_tier by the host of url: a known domain or a subdomain of one, by equality of host endings."""
    spark = pages.sparkSession
    known = spark.createDataFrame([(d, k, L.SOURCE_TIERS[k]) for k, ds in domains.items() for d in ds], "_domain string, _type string, _tier int")
    host = F.regexp_replace(host_of(F.col("url")), r"\.$", "")
    hosts = pages.select("url").distinct().withColumn("_host", host).withColumn("_parts", F.split("_host", r"\."))
    ends = hosts.select("url", F.explode(F.expr("transform(sequence(1, size(_parts)), i -> array_join(slice(_parts, i, size(_parts)), '.'))")).alias("_domain"))
    best = ends.join(F.broadcast(known), "_domain").groupBy("url").agg(F.min(F.struct("_tier", "_type")).alias("_b"))
    out = pages.join(best, "url", "left")
    return out.withColumns({"source_type": F.coalesce("_b._type", F.lit("unknown")), "authority_tier": F.coalesce("_b._tier", F.lit(4))}).drop("_b")


def safe_urls(pages: DataFrame) -> DataFrame:
    """Adds ok and reason: only http(s) to hosts that are neither local, private nor metadata services."""
    scheme = F.coalesce(F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
    rows = X.computed(pages, {"_scheme": scheme, "_host": F.regexp_replace(F.coalesce(host_of(F.col("url")), F.lit("")), "%.*$", "")})
    scheme, host = F.col("_scheme"), F.col("_host")
    local6 = host.contains(":") & host.rlike(r"^(::1?$|f[cd]|fe[89ab])")
    blocked = (host == "") | host.isin(L.BLOCKED_HOSTS) | (host.rlike(L.BLOCKED_IP) & host.rlike(r"^[0-9.]+$")) | host.rlike(r"^(10|192\.168|172\.(1[6-9]|2[0-9]|3[0-1])|169\.254|0|100\.100\.100)\.") | local6
    reason = F.when(~scheme.isin("http", "https"), F.concat(F.lit("Scheme not allowed: "), scheme)).when(blocked, F.concat(F.lit("Blocked host: "), host)).otherwise("")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason") == "").drop("_scheme", "_host")


def product_sentences(text: Column, most: int = 6000) -> Column:
    """Sentences with a product word, until ``most`` characters are gathered; the start of the text if there is none."""
    text = F.coalesce(text, F.lit(""))
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    relevant = F.filter(parts, lambda s: (s != "") & F.lower(s).rlike("|".join(L.PRODUCT_WORDS)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    step = lambda a, s: F.when(a["n"] < most, F.struct(F.concat(a["kept"], F.array(s)).alias("kept"), (a["n"] + F.length(s)).alias("n"))).otherwise(a)
    joined = F.array_join(F.aggregate(relevant, start, step)["kept"], " ")
    return F.substring(F.coalesce(F.nullif(joined, F.lit("")), text), 1, most)


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")



def verify_identity(pages: DataFrame) -> DataFrame:
    """Adds identity_match, identity_confidence, reject_reason to (manufacturer, mpn, brand, page_text).

    The exact part number is strongest; another part number on the page rejects it; a missing
    manufacturer rejects or lowers; manufacturer and brand together still match weakly.
    """
    squash = lambda c: F.upper(F.regexp_replace(c, r"[\s\-_/.]", ""))
    text = F.coalesce(F.col("page_text"), F.lit(""))
    rows = pages.withColumns(
        {
            "_t": squash(F.coalesce("mpn", F.lit(""))),
            "_named": F.transform(F.regexp_extract_all(F.lower(text), F.lit(L.NAMED_MPN), 1), squash),
            "_loose": F.upper(F.regexp_replace(text, r"[\s\-_/\\.]+", " ")),
            "_page": _fold(text),
        }
    )
    # a number of ASCII letters and digits stands alone exactly if it is one of the page's tokens; only other numbers need a pattern of their own
    token = F.contains(F.concat(F.lit(" "), F.regexp_replace("_loose", "[^A-Za-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("_t"), F.lit(" ")))
    odd = F.col("_t").rlike("[^A-Za-z0-9]")
    alone = F.when(~odd, token).otherwise(F.expr(r"_loose rlike concat('(?<![A-Za-z0-9])\\Q', if(_t rlike '[^A-Za-z0-9]', _t, ''), '\\E(?![A-Za-z0-9])')"))
    hit = (F.col("_t") != "") & (F.array_contains("_named", F.col("_t")) | (F.contains("_loose", F.col("_t")) & alone))
    has_maker = F.coalesce(F.col("manufacturer"), F.lit("")) != ""
    maker = (_fold(F.col("manufacturer")) != "") & F.contains(F.col("_page"), _fold(F.col("manufacturer")))
    brand = (F.coalesce(F.col("brand"), F.lit("")) != "") & F.contains(F.col("_page"), _fold(F.col("brand")))
    rows = rows.withColumns({"_hit": hit, "_maker": maker, "_has": has_maker, "_brand": brand})
    rows = rows.withColumn("_wrong", (F.col("_t") != "") & ~F.col("_hit") & (F.size("_named") > 0))
    lost = F.expr("_has and not _maker and not _hit")
    reason = F.when(text == "", "empty page text").when(F.col("_wrong"), F.concat(F.lit("different MPN on page (expected "), "_t", F.lit(")"))).when(lost, "manufacturer not found on page")
    rows = rows.withColumn("reject_reason", reason)
    match = F.col("reject_reason").isNull() & (F.col("_hit") | (F.col("_has") & F.col("_brand")))
    confidence = F.when(F.col("reject_reason").isNotNull(), 0.0).when(F.col("_hit"), F.when(F.expr("_has and not _maker"), 0.6).otherwise(0.99)).when(F.expr("_has and _brand"), 0.65).when(F.col("_brand"), 0.55).otherwise(0.0)
    return rows.withColumns({"identity_match": match, "identity_confidence": confidence}).drop("_t", "_named", "_loose", "_page", "_hit", "_wrong", "_maker", "_has", "_brand")


def _units() -> Column:
    return F.create_map(*[F.lit(x) for kv in L.UNITS.items() for x in kv])


def extract_fields(pages: DataFrame, keys: list[str], text: str = "page_text") -> DataFrame:
    """Long table (keys, field, value, number, uom, evidence, confidence) of the first match of every pattern."""
    rows = X.computed(pages.where(F.length(text) > 0).select(*keys, F.col(text).alias("_text")), {"_low": F.lower("_text")})
    found = []
    for field, (pattern, has_unit, confidence) in L.EVIDENCE_PATTERNS.items():
        get = lambda i, p=pattern: F.regexp_extract("_text", "(?i)" + p, i)
        named = reduce(or_, [F.contains("_low", F.lit(w)) for w in L.EVIDENCE_WORDS[field]])  # most pages lack most words, and a search for a word is cheap
        one = F.struct(F.lit(field).alias("field"), get(0).alias("_all"), get(1).alias("_one"), (get(2) if has_unit else F.lit("")).alias("_unit"), F.lit(confidence).alias("confidence"))
        found.append(F.when(named & F.col("_text").rlike("(?i)" + pattern), one))
    rows = rows.select(*keys, F.inline(F.array_compact(F.array(*found))))
    of, one = F.col("field"), F.col("_one")
    value = F.when(of == "warranty", F.regexp_replace(F.trim(one), "[.,;]+$", "")).when(of.isin("upc", "ean", "gtin"), one)
    number = F.when(~of.isin("upc", "ean", "gtin", "warranty"), F.replace(one, F.lit(","), F.lit("")).try_cast("double"))
    unit = F.coalesce(F.try_element_at(_units(), F.lower(F.trim("_unit"))), F.col("_unit"))
    rows = rows.select(*keys, "field", value.alias("value"), number.alias("number"), unit.alias("uom"), F.trim("_all").alias("evidence"), "confidence")
    return rows.where((F.col("field") != "warranty") | ((F.length("value") <= 60) & F.col("value").rlike("[0-9]")))


def normalize_units(fields: DataFrame) -> DataFrame:
    """Weights in kg, lengths in mm, temperatures in °C; (field, number, uom) are replaced, unknown units give null."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    kg, mm = F.try_element_at(table(L.TO_KG), F.lower("uom")), F.try_element_at(table(L.TO_MM), F.lower("uom"))
    degree = F.upper(F.replace("uom", F.lit("°"), F.lit("")))
    length = F.col("field").isin("length", "width", "height", "depth")
    number = F.when(F.col("field") == "weight", F.round(F.col("number") * kg, 6)).when(length, F.round(F.col("number") * mm, 4))
    number = number.when((F.col("field") == "temperature") & (degree == "F"), F.round((F.col("number") - 32) * 5 / 9, 2)).otherwise(F.col("number"))
    uom = F.when(F.col("field") == "weight", F.when(kg.isNotNull(), "kg").otherwise("")).when(length, F.when(mm.isNotNull(), "mm").otherwise(""))
    uom = uom.when((F.col("field") == "temperature") & degree.isin("F", "C"), "C").otherwise(F.col("uom"))
    return fields.withColumns({"number": number, "uom": uom})


def pick_evidence(attempts: DataFrame) -> DataFrame:
    """One row per product of verified attempts (product_id, attempt, url, identity_*, reject_reason).

    The first attempt that matches wins. Otherwise the source follows the latest of the strongest
    rejections, and the reason the latest one that gave a reason while no stronger one came before.
    Attempts are combined by confidence, of which there are few values, before they are shuffled;
    only where a stronger rejection gave no reason are the weaker ones looked through again. What the first pass
    finds is written, so that attempts are not verified anew unless there are such products, and then only for these.
    """
    one = F.struct("attempt", "url", "identity_match", F.col("identity_confidence").alias("confidence"), "reject_reason")
    rated = F.col("identity_confidence") >= 0
    levels = attempts.groupBy("product_id", "identity_confidence").agg(
        F.min(F.when(F.col("identity_match"), one)).alias("won"), F.min(one).alias("first"), F.max(F.when(rated, one)).alias("last"), F.max(F.when(rated & F.col("reject_reason").isNotNull(), one)).alias("why"), F.count(F.lit(1)).alias("n")
    )
    by_level = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.confidence").alias("confidence"), F.col(c).alias("x"))))["x"]
    level = F.struct(F.col("identity_confidence").alias("confidence"), "first")
    rows = levels.groupBy("product_id").agg(F.min("won").alias("won"), by_level("last").alias("lost"), by_level("why").alias("why"), F.sum("n").alias("n"), F.collect_list(level).alias("levels"))
    path = scratch(attempts.sparkSession)
    rows.write.parquet(path)
    rows = attempts.sparkSession.read.parquet(path)
    weaker = rows.where("won is null and why.confidence < lost.confidence").select("product_id", "levels")
    again = attempts.limit(0) if weaker.isEmpty() else attempts.join(weaker.select("product_id"), "product_id", "left_semi")
    given = again.where(rated & F.col("reject_reason").isNotNull()).select("product_id", one.alias("x")).join(weaker, "product_id")
    stronger = F.exists("levels", lambda v: F.coalesce(v["confidence"] > F.col("x.confidence"), F.lit(False)) & (v["first"] < F.col("x")))
    given = given.where(~stronger).groupBy("product_id").agg(F.max("x").alias("given"))
    reason = F.when(F.expr("why.confidence < lost.confidence"), F.col("given.reject_reason")).otherwise(F.col("why.reject_reason"))
    no_reason = F.concat(F.lit("no candidate matched after "), F.col("n").cast("string"), F.lit(" retrieval(s)"))
    return rows.join(given, "product_id", "left").select(
        "product_id",
        F.col("won").isNotNull().alias("matched"),
        F.coalesce("won.url", "lost.url").alias("url"),
        F.coalesce("won.confidence", "lost.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("won").isNull(), F.coalesce(reason, no_reason)).alias("reason"),
    )


def split_needs(products: DataFrame) -> DataFrame:
    """Adds needs_model and unresolved to (needed array, found array, has_evidence): what extraction left open."""
    sizes = F.array(*[F.lit(x) for x in ("length", "width", "height", "depth")])
    left = F.filter("needed", lambda f: ~(F.array_contains("found", F.lower(f)) | ((F.lower(f) == "dimensions") & F.arrays_overlap("found", sizes))))
    none = F.array().cast("array<string>")
    return products.withColumns({"needs_model": F.when(F.col("has_evidence"), left).otherwise(none), "unresolved": F.when(F.col("has_evidence"), none).otherwise(left)})


def comparable(value: Column) -> Column:
    """Values state the same fact exactly if these agree: text without case and extra space, plain numbers by value."""
    s = F.lower(F.trim(F.regexp_replace(value, rf"{X.SPACE}+", " ")))
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.concat(F.lit("n:"), s.cast("double").cast("string"))).otherwise(F.concat(F.lit("s:"), s))


#: What a candidate value says of itself; columns that a table lacks are null.
CANDIDATE = {"value": "string", "authority": "string", "source_type": "string", "source_url": "string", "evidence": "string", "confidence": "double"}


def _with_order(candidates: DataFrame) -> DataFrame:
    """Candidates with all columns of ``CANDIDATE`` and _r, less for more authority."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.AUTHORITY.items() for x in kv]), "authority"), F.lit(0))
    typed = {c: (F.col(c) if c in candidates.columns else F.lit(None)).cast(kind) for c, kind in CANDIDATE.items()}
    return candidates.withColumns(typed).withColumn("_r", -rank)


def conflict_state(candidates: DataFrame, keys: tuple[str, ...] = ("product_id", "field"), *more: Column) -> DataFrame:
    """(keys, winner, low, high, candidates, more aggregates): all that has to be kept of candidates (keys, pos and ``CANDIDATE``) to resolve them with later ones.

    The winner is the candidate of the most authority, the first of equals; low and high are the least and greatest comparable form of a value.
    Each is a minimum, a maximum or a count, so states merge in any order, and a field with any number of candidates is combined before it is shuffled.
    """
    rows = X.computed(_with_order(candidates), {"_form": comparable(F.col("value"))})
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("_r", "pos", *CANDIDATE)))
    return rows.groupBy(*keys).agg(best.alias("winner"), F.min("_form").alias("low"), F.max("_form").alias("high"), F.count("value").alias("candidates"), *more)


def merge_states(states: list[DataFrame], keys: tuple[str, ...] = ("product_id", "field")) -> DataFrame:
    """The state of all candidates of some states; the candidates themselves are not read again."""
    rows = states[0]
    for other in states[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*keys).agg(F.min("winner").alias("winner"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("candidates").alias("candidates"))


def resolved_state(states: DataFrame, keys: tuple[str, ...] = ("product_id", "field")) -> DataFrame:
    """(keys, value, authority, source_type, source_url, evidence, confidence, status, candidates): what a state comes to.

    All values agree: verified; else conflicting; no value: unresolved.
    """
    status = F.when(F.col("candidates") == 0, "unresolved").when(F.col("low") == F.col("high"), "verified").otherwise("conflicting")
    return states.select(*keys, *[F.col(f"winner.{c}").alias(c) for c in CANDIDATE], status.alias("status"), "candidates")


def resolve_conflicts(candidates: DataFrame, keys: tuple[str, ...] = ("product_id", "field")) -> DataFrame:
    """One row per product and field of candidates (keys, pos, value, authority, ...): the value shown, its source, status, and the number of candidates."""
    return resolved_state(conflict_state(candidates, keys), keys)


def kept_candidates(candidates: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("product_id", "field")) -> DataFrame:
    """Every candidate with a value of the conflicting fields, with its place (from 1: the most authority first, then by pos)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_r", "pos", *CANDIDATE))
    rows = _with_order(candidates).where("value is not null").join(states.where("low <> high").select(*keys), list(keys), "left_semi")
    return rows.withColumn("place", place).drop("_r")


def merge_candidate(state: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("product_id", "field")) -> DataFrame:
    """The state after candidates arrive: the same as that of all at once, from the stored state and the new candidates alone."""
    return merge_states([state, conflict_state(incoming, keys)], keys)


def outcome_status(rows: DataFrame) -> DataFrame:
    """Adds status to (has_value, invalid_format, conflicted, semantic, from_evidence); missing values never become inferred."""
    status = F.when(~F.col("has_value"), "unresolved").when(F.col("invalid_format"), "invalid").when(F.col("conflicted"), "conflicting").when(F.col("semantic"), "inferred").when(F.col("from_evidence"), "verified")
    return rows.withColumn("status", status.otherwise("unresolved"))


def cache_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds cache (hit, negative or none) and output of the latest entry to requests (key); entries: key, output, created_at, log_id."""
    latest = entries.groupBy("key").agg(F.max_by(F.struct("output"), F.struct("created_at", "log_id")).alias("e"))
    found = requests.join(latest, "key", "left")
    state = F.when(F.col("e").isNull(), "none").when(F.col("e.output").isNull(), "negative").otherwise("hit")
    return found.withColumns({"cache": state, "output": F.col("e.output")}).drop("e")


SPEC_EVIDENCE = ["upc", "ean", "gtin", "length", "width", "height", "weight", "warranty"]


def apply_evidence(inputs: DataFrame, facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(product_id, kind, field, value, uom, status, source_type, source_url, evidence, confidence): what products hold after facts from their pages are applied.

    ``inputs`` has product_id, field, value, uom; ``facts`` product_id, pos, field, value, uom, source_url, evidence, confidence;
    ``attributes`` item_id, label. Spec fields, and the unit of the weight as a field weight_uom, go through conflict resolution with the input,
    pages first; the winner gives the provenance. Other facts become verified attributes, with the unit and provenance of the first page that states them, if the
    product has no such label yet.
    """
    place = lambda source: [F.lit(source).alias("authority"), F.lit(source).alias("source_type")]
    known = inputs.select("product_id", "field", F.lit(0).cast("long").alias("pos"), "value", "uom", *place("input"))
    found = facts.select("product_id", "field", F.col("pos").cast("long").alias("pos"), "value", "uom", *place("external"), "source_url", "evidence", "confidence")
    both = known.unionByName(found, allowMissingColumns=True)
    # the unit is a row of its own beside its weight, so that pages are read once
    stated = (F.col("field") == "weight") & (F.col("value").isNotNull() | (F.col("authority") == "input")) & (F.coalesce("uom", F.lit("")) != "")
    entry = lambda field, value: F.struct(field.alias("field"), value.alias("value"))
    both = both.select("product_id", "pos", "uom", "authority", "source_type", "source_url", "evidence", "confidence", F.inline(F.when(stated, F.array(entry(F.col("field"), F.col("value")), entry(F.lit("weight_uom"), F.col("uom")))).otherwise(F.array(entry(F.col("field"), F.col("value"))))))
    shown = ["source_type", "source_url", "evidence", "confidence"]
    spec = F.col("field").isin(*SPEC_EVIDENCE, "weight_uom")
    first = F.min(F.when(~spec & (F.col("authority") == "external") & F.col("value").isNotNull(), F.struct("pos", "value", "uom", *shown))).alias("f")
    states = conflict_state(both, ("product_id", "field"), first)
    labels = attributes.select(F.col("item_id").alias("product_id"), F.lower("label").alias("field"), F.lit(True).alias("_known")).distinct()
    rows = states.join(labels, ["product_id", "field"], "left").where(spec | (F.col("f").isNotNull() & F.col("_known").isNull()))
    status = F.when(F.col("candidates") == 0, "unresolved").when(F.col("low") == F.col("high"), "verified").otherwise("conflicting")
    either = lambda c: F.when(spec, F.col(f"winner.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    return rows.select(
        "product_id", F.when(spec, "spec").otherwise("attribute").alias("kind"), "field", either("value"), F.when(~spec, F.nullif("f.uom", F.lit(""))).alias("uom"),
        F.when(spec, status).otherwise("verified").alias("status"), *[either(c) for c in shown],
    )
