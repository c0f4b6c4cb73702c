"""Feed normalisation: cells of a row become contributions to fields, and these one resolved value a field, within the row."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X

_FIELD_OF = {a: f for f, aliases in L.HEADER_ALIASES.items() for a in aliases}


def header_key(header: str) -> str:
    s = re.sub("[​-‏﻿]", "", unicodedata.normalize("NFKC", header)).strip().lower()
    return re.sub("[^a-z0-9]", "", s)


def resolve_header(header: str) -> str | None:
    """The input field of a header, ``ambiguous``, or None. Headers are metadata, so this runs on the driver."""
    key = header_key(header)
    if key in L.AMBIGUOUS_HEADERS:
        return "ambiguous"
    if (m := re.match(r"(.*)(uom|unit)$", key)) and m[1] in L.MEASURES:
        return f"{m[1]}_uom"
    return _FIELD_OF.get(key)


def resolve_headers(spark: SparkSession, columns: list[str]) -> DataFrame:
    """(pos, column, field, reason) of a feed's headers; reason says why a header has no field."""
    rows = []
    for i, c in enumerate(columns):
        found = resolve_header(c)
        reason = "empty" if not header_key(c) else "ambiguous" if found == "ambiguous" else "unrecognized" if found is None else None
        rows.append((i, c, None if reason else found, reason))
    return spark.createDataFrame(rows, "pos int, column string, field string, reason string")


def long_cells(feed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(row_idx, pos, column, field, raw, value) of every cell; field is null for unmapped columns, value is cleaned."""
    columns = [c for c in feed.columns if c != "row_idx"]
    if not columns:
        return feed.sparkSession.createDataFrame([], "row_idx long, pos int, column string, field string, raw string, value string")
    cell = lambda i, c: F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.lit(None if (f := resolve_header(c)) == "ambiguous" else f).cast("string").alias("field"), F.col(f"`{c}`").cast("string").alias("raw"))
    rows = feed.select("row_idx", F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))
    return X.computed(rows, {"value": X.clean(F.col("raw"), ascii_only)})


def _cleaned(feed: DataFrame, ascii_only: bool) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """The feed with raw and cleaned cells of every mapped column as r<pos> and v<pos>, and (pos, column, field) of these columns."""
    mapped = [(i, c, f) for i, c in enumerate(c for c in feed.columns if c != "row_idx") if (f := resolve_header(c)) not in (None, "ambiguous")]
    raw = feed.select("row_idx", *[F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c, _ in mapped])
    return (X.computed(raw, {f"v{i}": X.clean(F.col(f"r{i}"), ascii_only) for i, _, _ in mapped}) if mapped else raw), mapped


def _contribution(pos: int, column: str, field: str, mapped: list[tuple[int, str, str]]) -> Column:
    """(pos, value, uom, column, raw) of one cell: a measure's unit stands behind the number or in the row's ``<field>_uom`` columns; vendor codes go."""
    value, uom = F.col(f"v{pos}"), F.lit(None).cast("string")
    if field in L.MEASURES:
        own = F.when(value.rlike(X.MEASURE), F.regexp_extract(value, X.MEASURE, 2))
        uom = F.coalesce(own, *[F.col(f"v{i}") for i, _, f in mapped if f == f"{field}_uom"])
        value = F.when(own.isNotNull(), F.regexp_extract(value, X.MEASURE, 1)).otherwise(value)
    elif field == "manufacturer_name":
        value = X.strip_vendor_code(value)
    return F.struct(F.lit(pos).alias("pos"), value.alias("value"), uom.alias("uom"), F.lit(column).alias("column"), F.col(f"r{pos}").alias("raw"))


def contributions(feed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(row_idx, pos, column, field, raw, amount, uom) of every cell that contributes to a field."""
    rows, mapped = _cleaned(feed, ascii_only)
    cells = [F.struct(F.lit(f).alias("field"), _contribution(i, c, f, mapped).alias("c")) for i, c, f in mapped if not f.endswith("_uom")]
    if not cells:
        return feed.sparkSession.createDataFrame([], "row_idx long, pos int, column string, field string, raw string, amount string, uom string")
    return rows.select("row_idx", F.inline(F.array(*cells))).select("row_idx", "c.pos", "c.column", "field", "c.raw", F.col("c.value").alias("amount"), "c.uom")


_RESOLVED = "array<struct<field:string,value:string,number:double,uom:string,status:string,issue:string,contributions:array<struct<pos:int,value:string,uom:string,column:string,raw:string>>>>"


def resolve_rows(feed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(row_idx, fields): per feed row one entry (field, value, number, uom, status, issue, contributions) for each field that has a column.

    Values equal up to case and outer space count once, in column order. Numbers: invalid if any is
    not a number, conflicting if they differ. Barcodes: the first is checked; several different
    ones conflict. Others: several different ones conflict. No value: unresolved. All of it is
    local to the row: nothing is shuffled.
    """
    rows, mapped = _cleaned(feed, ascii_only)
    columns: dict[str, list[Column]] = {}
    for i, c, f in mapped:
        if not f.endswith("_uom"):
            columns.setdefault(f, []).append(_contribution(i, c, f, mapped))
    if not columns:
        return feed.select("row_idx", F.array().cast(_RESOLVED).alias("fields"))
    kind = lambda f: "number" if f in L.NUMERIC_FIELDS else "barcode" if f in L.BARCODE_FIELDS else "text"
    present = lambda cells: F.filter(F.array(*cells), lambda x: x["value"].isNotNull())
    given = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kind(f)).alias("kind"), present(cells).alias("all")) for f, cells in columns.items()])
    same = lambda x, y: F.lower(F.trim(x["value"])) == F.lower(F.trim(y["value"]))
    once = lambda cells: F.filter(cells, lambda x, i: (i == 0) | ~F.exists(F.slice(cells, F.lit(1), i), lambda y: same(x, y)))
    step = lambda expr: X.computed(rows, {"fields": expr})
    rows = step(given).select("row_idx", "fields")
    rows = step(F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind"), once(f["all"]).alias("c"))))
    head = lambda f: F.get(f["c"], F.lit(0))["value"]
    numbers = lambda f: F.when(f["kind"] == "number", F.transform(f["c"], lambda x: X.parse_number(x["value"])))
    digits = lambda f: F.when(f["kind"] == "barcode", X.barcode_digits(head(f)))
    keep = lambda f, *names: [f[n].alias(n) for n in names]
    rows = step(F.transform("fields", lambda f: F.struct(*keep(f, "field", "kind", "c"), head(f).alias("head"), numbers(f).alias("numbers"), digits(f).alias("digits"))))

    def status(f: Column) -> Column:
        differ = F.exists(f["numbers"], lambda x: x != F.get(f["numbers"], F.lit(0)))
        bad = F.exists(f["numbers"], lambda x: x.isNull())
        found = F.when(F.size(f["c"]) == 0, "unresolved").when(f["kind"] == "number", F.when(bad, "invalid").when(differ, "conflicting").otherwise("verified"))
        return found.when((f["kind"] == "barcode") & ~X.valid_gtin(f["digits"]), "invalid").when(F.size(f["c"]) > 1, "conflicting").otherwise("verified")

    bad_cell = lambda f: F.get(F.filter(f["c"], lambda x, i: F.get(f["numbers"], i).isNull()), F.lit(0))
    rows = step(F.transform("fields", lambda f: F.struct(*keep(f, "field", "kind", "c", "head", "numbers", "digits"), status(f).alias("status"), F.when(f["kind"] == "number", bad_cell(f)).alias("bad"))))

    def resolved(f: Column) -> Column:
        numeric = f["kind"] == "number"
        issue = F.when(f["status"] == "conflicting", F.concat(F.lit("conflicting "), f["field"], F.lit(" values from input columns")))
        issue = issue.when((f["status"] == "invalid") & numeric, F.concat(F.lit('invalid numeric "'), f["bad"]["value"], F.lit('" for '), f["field"], F.lit(" (column "), f["bad"]["column"], F.lit(")")))
        issue = issue.when(f["status"] == "invalid", F.concat(F.lit("invalid "), f["field"], F.lit(' checksum/format "'), f["head"], F.lit('"')))
        return F.struct(
            f["field"].alias("field"),
            F.when(numeric, F.lit(None).cast("string")).when(f["kind"] == "barcode", f["digits"]).otherwise(f["head"]).alias("value"),
            F.when(numeric & (f["status"] != "invalid"), F.get(f["numbers"], F.lit(0))).alias("number"),
            F.get(F.filter(f["c"], lambda x: x["uom"].isNotNull()), F.lit(0))["uom"].alias("uom"),
            f["status"].alias("status"),
            issue.alias("issue"),
            f["c"].alias("contributions"),
        )

    return step(F.transform("fields", resolved))


def merge_contributions(feed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``resolve_rows`` in long form: one row per (row_idx, field) with value, number, uom, status, issue, contributions."""
    return resolve_rows(feed, ascii_only).select("row_idx", F.inline("fields"))


def field_value(field: str, member: str = "value") -> Column:
    """A member of one field of ``resolve_rows``; null where no column has the field."""
    return F.get(F.filter("fields", lambda f: f["field"] == field), F.lit(0))[member]


def upload_summary(feed: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One row of counts of an upload: rows_in, skipped (no part number), duplicates, issue_rows, described, branded.

    A description is the first of part, invoice and short description; a brand may be a trade name.
    A feed with exactly the columns of ``EXACT_COLUMNS`` takes them as they are, cleaned only.
    """
    if set(EXACT_COLUMNS) == {c for c in feed.columns if c != "row_idx"}:
        cell = lambda c: X.clean(F.col(c), ascii_only)
        rows = feed.select(cell("Mfg_Part_Num").alias("mpn"), cell("Part_Desc").alias("description"), F.coalesce(*map(cell, ("E1_Brand", "Unilog_Brand", "DIB_Brand"))).alias("brand"), F.lit(False).alias("issue"))
    else:
        first = lambda *names: F.coalesce(*map(field_value, names))
        rows = resolve_rows(feed, ascii_only).select(
            field_value("mfg_part_num").alias("mpn"), first("part_desc", "invoice_desc", "short_desc").alias("description"), first("brand_name", "trade_name").alias("brand"), F.exists("fields", lambda f: f["issue"].isNotNull()).alias("issue")
        )
    return rows.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("mpn").isNull()).alias("skipped"), (F.count("mpn") - F.countDistinct("mpn")).alias("duplicates"), F.count_if("issue").alias("issue_rows"), F.count("description").alias("described"), F.count("brand").alias("branded")
    )


#: The feed layout that is read without mapping.
EXACT_COLUMNS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]


def exact_duplicates(feed: DataFrame, ascii_only: bool = False, span: int = 1_000_000) -> DataFrame:
    """(row_idx, duplicate_of): the nearest earlier row with the same cleaned cells, or null.

    Rows are compared within runs of ``span`` row numbers, so equal rows, however many, are spread over
    tasks; the first of a run then takes the last of the nearest earlier run, of which there is one row each.
    """
    columns = sorted(c for c in feed.columns if c != "row_idx")
    cells = F.array(*[F.concat(F.lit(c + "="), F.coalesce(F.concat(F.lit("v"), X.clean(F.col(f"`{c}`"), ascii_only)), F.lit("n"))) for c in columns])
    rows = X.computed(feed, {"fp": F.sha2(F.to_json(cells), 256)}).select("row_idx", "fp", F.floor(F.col("row_idx") / span).alias("run"))
    inside = Window.partitionBy("fp", "run").orderBy("row_idx")
    rows = rows.withColumns({"before": F.lag("row_idx").over(inside), "last": F.max("row_idx").over(Window.partitionBy("fp", "run"))})
    borders = rows.where("before is null").select("fp", "run", F.lag("last").over(Window.partitionBy("fp").orderBy("run")).alias("earlier")).where("earlier is not null")
    out = rows.join(borders, ["fp", "run"], "left")
    return out.select("row_idx", F.coalesce("before", F.when(F.col("before").isNull(), F.col("earlier"))).alias("duplicate_of"))


def profile(feed: DataFrame, mpn: str, description: str, brand: str, manufacturer: str) -> DataFrame:
    """One row: rows, distinct part numbers, repeats, placeholder brands, empty descriptions, share with a vendor code."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    named = F.when(~empty(mpn), F.trim(F.col(mpn)))
    return feed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(named).alias("unique_mpns"),
        (F.count(named) - F.countDistinct(named)).alias("duplicate_mpns"),
        F.count_if(F.lower(F.trim(F.col(brand))).isin(L.PLACEHOLDER_BRANDS)).alias("placeholder_brands"),
        F.count_if(empty(description)).alias("empty_descriptions"),
        F.round(F.count_if(F.coalesce(F.col(manufacturer).rlike(r"\([A-Z0-9]{1,6}\)\s*$"), F.lit(False))) / F.count(F.lit(1)), 6).alias("vendor_code_share"),
    )
