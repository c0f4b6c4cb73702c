"""Pages, upload texts and files on odd input, with values worked out from how the formats are defined."""

import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from feedloom.functions.html import page_text
from feedloom.operators import evidence
from feedloom.sources import files, store


@pytest.mark.parametrize(
    "page,text",
    [
        ("<nav>a<nav>b</nav>c</nav><p>d</p>", "d"), ("<header>h<p>d", ""), ('<p title="a>b">c', "c"), ("<p title='a>b'>c", "c"), ("<a href=x?a=1&b=2>c</a>", "c"), ("&eacute; &#8211; &amp;lt; &copy &#x41;", "é – &lt; © A"),
        ("a<!-- <nav> -->b", "a b"), ("a<!-- never closed <p>b", "a"), ("a<!-->b", "a b"), ("a < b <3", "a < b <3"), ("a <> b", "a <> b"), ("<script>if(a<b){'</p>'}</script>x", "x"), ("<SCRIPT>a</Script >b", "b"), ("<script>never", ""),
        ("<style>p{}</style>x", "x"), ("<script src=a />x</script>y", "x y"), ("<nav/>x<svg />y", "x y"), ("<nav><div>a</nav>b</div>c</nav>d", "d"), ("<div><nav>a</div>b", "b"), ("<nav><b>a</nav>b</b>c", "b c"), ("<table><tr><td><nav>a</td>b</table>c", "b c"),
        ("<p it's>text</p>", "text"), ("<p a='x", ""), ("<form>a<form>b</form>c", "c"), ("<form><div><form>b</form>c</div></form>d", "d"), ("<!DOCTYPE html><html><head><title>T</title></head><body>x<br>y</body></html>z", "T x y z"),
        ("<?php a ?>b", "b"), ("</ x>b", "b"), ("<td>a</td></table>b", "a b"), ("a</nav>b", "a b"), ("<template>q</template>r", "r"), ("<ruby>k<rt>z</rt></ruby>", "k"), ("a<b>b</b>c", "a b c"), ("x &nbsp; \n\ty", "x y"),
        ("<noscript>a</noscript><iframe>b</iframe><svg><text>c</text></svg><aside>d</aside><footer>e</footer>f", "f"), ("<header><img src=x><input></header>a", "a"), ("<br/>a<hr>b", "a b"), ("<navy>a</navy>b", "a b"), ("<nav-bar>a</nav-bar>", "a"), ("<p\nclass='x'\n>a</p\n>b", "a b"),
        ("<p a=\"1\"b='2'>c", "c"), ("<p a= '>'>c", "c"), ("&unknown; &amp", "&unknown; &"), ("<title>a</title><textarea>b</textarea>", "a b"), ("<aside>a<!-- </aside> -->b</aside>c", "c"), ("<footer>a<script></footer></script>b</footer>c", "c"), ("<nav></nav></nav>a", "a"), ("", ""), (None, ""), (" \n ", ""),
    ],
)
def test_page_text(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize("page", ["<nav>" * 200_000, "<p a='" * 150_000, "<!--" * 250_000, "<" * 1_000_000, "<nav>" + "</nav><div>" * 90_000, "<nav><div>" + "<b>" * 100_000 + "</nav>" * 100_000, "<a =" * 250_000, "<style>" * 140_000, "<nav>" * 90_000 + "</nav>" * 90_000, "&" * 1_000_000])
def test_page_text_is_linear(page):
    began = time.process_time()
    page_text(page)
    assert time.process_time() - began < 20


def test_sanitize_column(spark):
    rows = spark.createDataFrame([(1, "<nav>x</nav>a &mdash; b"), (2, None)], "page_id int, html string")
    assert [r[0] for r in rows.orderBy("page_id").select(evidence.sanitize(F.col("html"))).collect()] == ["a — b", ""]


# --- R02


def test_products_from_text(spark):
    texts = [
        (1, "Mfg Part Num: AB-1 rev\nPart_Desc: x\nE1 brand:-- Unbranded --\nUnilog_Brand: -- unbranded --\nPart Manuf \n next line"),
        (2, "see mfg_part_num: cd-2, MFGPARTNUM::: e\tDIBBrand far"),
        (3, "Mfg Part Num: A1 " + "." * 1971 + "\nPart Desc: late\nMfg Part Num: A2"),
        (4, "Mfg Part Num: \nMfg Part Num: !"), (5, None), (6, ""), (7, "Mfg Part Num: B " * 300 + "Part Desc: end"),
    ]
    got = store.extract_products_from_text(spark.createDataFrame(texts, "k int, text string"), "k").orderBy("k", "pos").collect()
    of = lambda k: [tuple(r)[2:] for r in got if r["k"] == k]
    assert of(1) == [("AB-1", "x", None, "-- unbranded --", None, "next line")]
    assert of(2) == [("cd-2", None, None, None, "far", None), ("e", None, None, None, "far", None)]
    assert of(3) == [("A1", None, None, None, None, None), ("A2", None, None, None, None, None)]
    assert of(4) == [("Mfg", None, None, None, None, None)] and not of(5) and not of(6)
    assert [r["pos"] for r in got if r["k"] == 7] == list(range(300))
    text = texts[6][1]
    assert [r["part_desc"] for r in got if r["k"] == 7] == ["end" if len(text) - i * 16 <= 2000 else None for i in range(300)]


# --- R01, R05, R06


@pytest.fixture(params=["128m", "300"])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_feed_of_odd_cells_in_many_ranges(spark, tmp_path, split_size):
    rng = random.Random(int(split_size[:3]))

    def cell():
        kind = rng.random()
        if kind < 0.25:
            return "".join(rng.choice('ab,"\n\r x') for _ in range(rng.randrange(12)))
        return "x" * rng.randrange(1, 200) + "\n" + '"' * rng.randrange(4) if kind < 0.3 else '5" pipe' if kind < 0.35 else "é%d" % rng.randrange(99)

    rows = [[str(i), *[cell() for _ in range(4)]] for i in range(250)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["id", "a", "b,\nc", "MPN", "mpn"], *rows])
    (tmp_path / "f.csv").write_bytes(("﻿" + out.getvalue().replace('"5"" pipe"', '5" pipe')).encode())
    got = files.read_feed(spark, str(tmp_path / "f.csv")).orderBy("row_idx")
    assert got.columns == ["row_idx", "id", "a", "b,\nc", "MPN3", "mpn4"]
    assert [list(r)[1:] for r in got.collect()] == rows


def test_feed_of_several_files_with_bad_records(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_bytes(b'id,n\r\n1,"x\r\ny"\r\n\r\n2\r\n3,z,more\r\n,\r\n4,"never closed\r\n5,lost\r\n6,lost too\r\n')
    (tmp_path / "b.csv").write_bytes(b"id,n\n7,plain\n8,last")
    (tmp_path / "c.csv").write_bytes(b"")
    rows = files.read_feed(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r["id"], r["n"]) for r in rows] == [("1", "x\r\ny"), ("2", ""), ("3", "z"), ("", ""), ("7", "plain"), ("8", "last")]
    assert files.feed_report(spark, str(tmp_path)).first().asDict() == {"rows": 6, "malformed_rows": 3, "ragged_rows": 2, "blank_lines": 1}
    assert [r["x"] for r in files.read_feed(spark, str(tmp_path / "b.csv"), ["x", "y"]).orderBy("row_idx").collect()] == ["7", "8"]


def test_plain_feed_moves_no_row(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,n\n1,"a, b"\n2,c\n')
    plan = files.read_feed(spark, str(tmp_path / "f.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffleExchange" not in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_validate_delivery_finds_faults(spark, tmp_path):
    from feedloom.operators.export import HEADERS

    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([HEADERS, ["x"] * 250, ["�", *[""] * 251]])
    (tmp_path / "d.csv").write_text(out.getvalue())
    got = {r["check"]: r["ok"] for r in files.validate_delivery(spark, str(tmp_path / "d.csv")).collect()}
    assert {k for k, ok in got.items() if not ok} == {"row_width", "unicode", "static_headers"}


def test_export_parity_by_digests(spark):
    columns = [f"c{i}" for i in range(40)]
    left = [(str(k), *[f"v{k}.{i}" if i % 3 else None for i in range(40)]) for k in range(30)]
    right = [(k, *[v if not (int(k) % 7 == 0 and i in (2, 39)) else "!" if i == 2 else None for i, v in enumerate(row)]) for k, *row in left if k != "5"] + [("99", *[""] * 40)]
    schema = "k string, " + ", ".join(f"{c} string" for c in columns)
    found = files.export_parity(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).select("k", *columns[::-1]), "k")
    for r in found.collect():
        i = int(r["header"][1:])
        assert (r["cells"], r["only_left"], r["only_right"]) == (31, 1, 1)
        assert r["different"] == (5 if i == 2 else 0 if i != 39 or 39 % 3 == 0 else 5), i
    shifted = files.export_parity(spark.createDataFrame([("1", "ab", "c")], "k string, a string, b string"), spark.createDataFrame([("1", "a", "bc")], "k string, a string, b string"), "k")
    assert [r["different"] for r in shifted.collect()] == [1, 1]


# --- R06


def test_equal_exports_are_read_once(spark, tmp_path):
    """Cells are looked up again only where digests differ; cells that move between columns, and empty ones, count."""
    names = [f"c{i}" for i in range(40)]
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names])
    rows.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    same = files.export_parity(one, one, "k")
    assert not [f for f in same.inputFiles() if str(tmp_path) in f]
    assert {tuple(r) for r in same.collect()} == {(n, 200, 0, 0, 0) for n in names}
    moved = one.withColumns({"c0": F.when(F.col("k") == "7", "").otherwise(F.col("c0")), "c1": F.when(F.col("k") == "7", F.concat("c0", "c1")).otherwise(F.col("c1")), "c39": F.when(F.col("k") == "9", None).otherwise(F.col("c39"))})
    assert {r["header"]: r["different"] for r in files.export_parity(one, moved, "k").collect() if r["different"]} == {"c0": 1, "c1": 1, "c39": 1}
    assert files.export_parity(one, moved, "k").schema.simpleString() == same.schema.simpleString()
