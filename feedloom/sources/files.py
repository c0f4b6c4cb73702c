"""Feed and delivery files: reading any CSV, writing and checking the delivery, comparing exports."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.export import HEADER_FIELD, HEADERS


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/files-{uuid.uuid4().hex}"


#: Splits whose states are broadcast at most.
_MANY_SPLITS = 100_000
_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}


def _quoted_after(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of a line that begins outside (or inside) one.

    A quote opens a cell only where one begins; within it, two quotes stand for one. The line is folded over its
    parts between quotes, with the part before each quote and whether the quote before that closed a cell.
    """
    parts = F.split(line, '"', -1)
    state = F.struct(F.lit(inside).alias("open"), F.lit(False).alias("closed"), F.get(parts, F.lit(0)).alias("before"), F.lit(True).alias("first"))

    def step(s: Column, part: Column) -> Column:
        begins = s["before"].endswith(",") | ((s["before"] == "") & (s["first"] | s["closed"]))
        return F.struct((~s["open"] & begins).alias("open"), s["open"].alias("closed"), part.alias("before"), F.lit(False).alias("first"))

    return F.when(F.contains(line, F.lit('"')), F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), state, step)["open"]).otherwise(F.lit(inside))


def _composed(rows: DataFrame, ends: str, by) -> DataFrame:
    """Adds ``put`` and ``turned``, the composed effect on a state of all rows of a window: what it is set to (or null), and whether it is then turned round.

    ``ends`` names a struct of what a row makes of outside and of inside (out, in): equal ends set the state, swapped ones turn it round.
    """
    out, into = F.col(f"{ends}.out"), F.col(f"{ends}.in")
    rows = rows.withColumn("_t", F.sum((out & ~into).cast("int")).over(by))
    rows = rows.withColumn("_l", F.last(F.when(out == into, F.struct(out.alias("put"), F.coalesce("_t", F.lit(0)).alias("t"))), True).over(by))
    return rows.withColumns({"put": F.col("_l.put"), "turned": F.coalesce((F.col("_t") - F.coalesce("_l.t", F.lit(0))) % 2 == 1, F.lit(False))}).drop("_t", "_l")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, as a table in the shared folder."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, first, record, whole) of CSV files, read by many tasks whatever their quoted cells hold.

    A line break within a quoted cell does not end a record. Whether a line begins within one depends on all lines before
    it, so the effect of each line on that state is composed (a prefix scan): within each byte range, over the
    ranges of a file, and back into the lines. Where no line leaves a cell open, lines are records and no row
    moves; else only lines that can change the state take part in the first scan. Only records of several lines are grouped.

    row_idx rises in file order (files by path); ``first`` marks the first record of a file. A quoted cell that is never closed
    would take up the rest of its file: its lines are returned one by one, with ``whole`` false.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    lines = lines.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^\uFEFF", "")).otherwise(F.col("line")))
    ends = F.struct(_quoted_after(F.col("line"), False).alias("out"), _quoted_after(F.col("line"), True).alias("in"))
    ranges = Window.partitionBy("file", "block").orderBy("id")
    upto, over = ranges.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    split = lines.groupBy("file", "block").agg(F.min("id").alias("low"), F.max(_quoted_after(F.col("line"), False)).alias("opens"))
    split = kept(split.withColumn("number", F.row_number().over(Window.orderBy("file", "block")) - 1))
    n, moved = split.agg(F.count(F.lit(1)), F.max("opens")).first()
    if moved:
        moves = _composed(lines.select("file", "block", "id", ends.alias("ends")).where("ends.out or not ends.in"), "ends", upto)
        effects = moves.groupBy("file", "block").agg(F.max_by(F.struct("put", "turned"), "id").alias("e"))
        after = lambda state: F.coalesce("e.put", state) != F.coalesce("e.turned", F.lit(False))
        split = split.join(effects, ["file", "block"], "left").withColumn("ends", F.struct(after(F.lit(False)).alias("out"), after(F.lit(True)).alias("in")))
        split = _composed(split, "ends", over).withColumn("starts", F.coalesce("put", F.lit(False)) != F.col("turned"))
        unclosed = F.last(after(F.col("starts"))).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        split = kept(split.select("file", "block", "low", "number", "starts", unclosed.alias("unclosed")))

    placed = lines.join(F.broadcast(split) if n <= _MANY_SPLITS else split, ["file", "block"])
    placed = placed.withColumns({"row_idx": F.shiftleft(F.col("number").cast("long"), 33) + F.col("id") - F.col("low"), "first": (F.col("block") == 0) & (F.col("id") == F.col("low"))})
    bare = lambda c: F.regexp_replace(c, "\r$", "")
    if not moved:
        return placed.select("row_idx", "first", bare("line").alias("record"), F.lit(True).alias("whole"))
    placed = _composed(placed.withColumn("ends", ends), "ends", upto)
    placed = placed.withColumn("after", F.coalesce("put", "starts") != F.col("turned")).withColumn("before", F.coalesce(F.lag("after").over(ranges), F.col("starts")))
    single = placed.where("not before and not after").select("row_idx", "first", bare("line").alias("record"), F.lit(True).alias("whole"))
    parts = placed.where("before or after").withColumn("begin", F.last(F.when(~F.col("before"), F.col("row_idx")), True).over(upto))
    # a range that begins within a record goes on with the last one begun before it
    begun = parts.groupBy("file", "block").agg(F.max("begin").alias("_last"))
    begun = begun.select("file", "block", F.last("_last", True).over(over).alias("_carry"), F.max("_last").over(Window.partitionBy("file")).alias("_final"))
    parts = parts.join(begun, ["file", "block"]).withColumn("begin", F.coalesce("begin", "_carry"))
    parts = parts.withColumn("whole", ~(F.col("unclosed") & (F.col("begin") == F.col("_final"))))
    key = F.when(F.col("whole"), F.col("begin")).otherwise(F.col("row_idx"))
    joined = parts.groupBy(key.alias("begin")).agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("g"), F.min("whole").alias("whole"))
    return single.unionByName(joined.select(F.col("begin").alias("row_idx"), "first", bare(F.array_join("g.line", "\n")).alias("record"), "whole"))


def _unclosed(record: str) -> bool:
    try:
        list(csv.reader(io.StringIO(record, newline=""), strict=True))
    except csv.Error as e:
        return "unexpected end" in str(e)
    return False


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Cells of the first record of the first file (by path) that is not empty."""
    for file in sorted(spark.read.text(path).inputFiles()):
        lines, n = spark.read.option("lineSep", "\n").text(file), 1
        while True:
            head = [r[0] for r in lines.head(n)]
            records = ["\n".join(head[:k]).removeprefix("\ufeff").removesuffix("\r") for k in range(1, len(head) + 1)]
            record = next((r for r in records if not _unclosed(r)), None)
            if record is not None or len(head) < n:
                break
            n *= 2
        if record:
            return next(csv.reader(io.StringIO(record, newline="")))
    return []


def _parsed(records: DataFrame, width: int) -> DataFrame:
    """Adds the cells c0, c1, ... of each record, null where it is too short, and _bad, the record where it has another number of them."""
    schema = ", ".join(f"c{i} string" for i in range(width)) + ", _bad string"
    return records.withColumn("_c", F.from_csv("record", F.lit(schema), _CSV)).select("*", "_c.*").drop("_c")


def read_feed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A supplier CSV as text columns with row_idx: quoted line breaks, ragged rows and empty cells are kept, blank lines skipped.

    Files are read by byte ranges (``read_records``). Columns are named by the first record of the first file, or by ``columns``;
    an empty name becomes its position, and one that is repeated in any case gets it. Missing cells are empty, further cells are left out. Records
    that can't be read (``feed_report`` counts them) are left out. row_idx is increasing in file order, not gapless.
    """
    names = columns or header_of(spark, path)
    folded = [n.lower() for n in names]
    names = [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]
    rows = _parsed(read_records(spark, path).where("whole and not first and record <> ''"), len(names))
    return rows.select("row_idx", *[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)])


def feed_report(spark: SparkSession, path: str) -> DataFrame:
    """One row on a feed's files: rows, malformed_rows (lines of quoted cells that are never closed), ragged_rows (with too few or too many cells), blank_lines."""
    rows = _parsed(read_records(spark, path).where("not first"), len(header_of(spark, path)))
    read = F.col("whole") & (F.col("record") != "")
    return rows.agg(F.count_if(read).alias("rows"), F.count_if(~F.col("whole")).alias("malformed_rows"), F.count_if(read & F.col("_bad").isNotNull()).alias("ragged_rows"), F.count_if(F.col("whole") & (F.col("record") == "")).alias("blank_lines"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows; only cells with a comma, quote or line break are quoted; nulls and empty texts are empty cells."""
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def validate_delivery(spark: SparkSession, path: str) -> DataFrame:
    """(check, ok, detail) of a written delivery file: nine checks on headers, widths and characters, in one reading."""
    found = header_of(spark, path)
    missing, extra = [h for h in HEADERS if h not in found], [h for h in found if h not in HEADERS]
    body = _parsed(read_records(spark, path).where("not first and record <> ''"), len(HEADERS))
    static = [f"c{i}" for i, h in enumerate(HEADERS) if h not in HEADER_FIELD]
    row = body.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_bad").isNotNull() | ~F.col("whole")).alias("bad"), F.count_if(F.col("record").contains("\ufffd")).alias("lost"), F.count_if(F.concat_ws("", *static) != "").alias("static")).first()
    checks = [
        ("readable", row["rows"] > 0, str(row["rows"] > 0)), ("header_count", len(found) == len(HEADERS), str(len(found))), ("header_order", found == HEADERS, ""), ("missing_headers", not missing, ",".join(missing)),
        ("extra_headers", not extra, ",".join(extra)), ("reordered_headers", [h for h in found if h in HEADERS] == [h for h in HEADERS if h in found], ""), ("row_width", row["bad"] == 0, str(row["bad"])),
        ("unicode", row["lost"] == 0, str(row["lost"])), ("static_headers", row["static"] == 0, str(row["static"])),
    ]
    return spark.createDataFrame(checks, "check string, ok boolean, detail string")


#: Columns whose cells one digest stands for.
_GROUP = 16


def export_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(header, cells, different, only_left, only_right) of two exports, cell by cell over the whole table.

    Keys are unique on either side. Each row is shuffled as its key and digests of 128 bits, one for each group of columns; equal digests settle their
    cells. Only cells of groups that differ are looked at, so two equal exports move a few numbers a row and are read once. Cells are compared as text, null as empty.
    """
    columns = [c for c in left.columns if c != key]
    groups = [columns[i : i + _GROUP] for i in range(0, len(columns), _GROUP)]
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    digest = lambda g: F.struct(*[F.xxhash64(F.lit(i), *[cell(c) for c in g]).alias(f"h{i}") for i in range(2)])
    digests = lambda d, n: d.select(F.col(key).alias("_k"), F.array(*[digest(g) for g in groups]).alias(n))
    both = digests(left, "l").join(digests(right, "r"), "_k", "full")
    rows = kept(both.select("_k", F.col("r").isNull().alias("only_left"), F.col("l").isNull().alias("only_right"), F.filter(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda i: F.get("l", i) != F.get("r", i)).alias("groups")))
    total = rows.agg(F.count(F.lit(1)).alias("cells"), F.count_if("only_left").alias("only_left"), F.count_if("only_right").alias("only_right"))
    open_ = rows.where("not only_left and not only_right and size(groups) > 0").select("_k", F.explode("groups").alias("g"))
    names = left.sparkSession.createDataFrame(list(enumerate(columns)), "n int, header string")
    if open_.isEmpty():
        return names.crossJoin(F.broadcast(total)).select("header", "cells", F.lit(0).cast("long").alias("different"), "only_left", "only_right")

    def cells(d: DataFrame, n: str) -> DataFrame:
        some = d.join(open_.select("_k").distinct(), d[key] == F.col("_k"), "left_semi")
        return some.select(F.col(key).alias("_k"), F.posexplode(F.array(*[F.array(*[cell(c) for c in g]) for g in groups])).alias("g", n)).join(open_, ["_k", "g"], "left_semi")

    pairs = cells(left, "l").join(cells(right, "r"), ["_k", "g"]).select("g", F.posexplode(F.zip_with("l", "r", lambda a, b: a != b)).alias("i", "d"))
    different = pairs.where("d").groupBy((F.col("g") * _GROUP + F.col("i")).cast("int").alias("n")).agg(F.count(F.lit(1)).alias("different"))
    return names.join(different, "n", "left").crossJoin(F.broadcast(total)).select("header", "cells", F.coalesce("different", F.lit(0)).alias("different"), "only_left", "only_right")
