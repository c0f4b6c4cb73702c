"""Every registered catalog query against its DuckDB SQL on the smallest tables."""

import pytest

from feedloom import plans
from feedloom.plans import evidence_queries
from tests.compare import TABLES, duckdb_on, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, con, name):
    ours, theirs = same(plans.queries()[name](spark, FOLDER), con, plans.oracles()[name])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1]) > 0
    assert ours[1] == theirs[1]


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The smallest tables with part keys of six and of seven digits, which part numbers cut to six: items share theirs with up to ten others."""
    folder = tmp_path_factory.mktemp("long_keys")
    con = duckdb_on(FOLDER)
    for t in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        moved = f"* REPLACE (CASE WHEN {key} < 20 THEN {key} + 123440 ELSE {key} + 1234400 END AS {key})" if key else "*"
        con.sql(f"COPY (SELECT {moved} FROM {t}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["field_scores", "group_scores", "reason_tags", "overall_score", "field_accuracy", "calibration", "batch_score", "pair_items", "compare_attributes", "value_compliance"])
def test_items_with_several_answers(spark, long_keys, name):
    ours, theirs = same(plans.queries()[name](spark, long_keys), duckdb_on(long_keys), plans.oracles()[name])
    assert len(theirs[1]) > 0
    assert ours == theirs


@pytest.fixture(scope="module")
def shared_keys(tmp_path_factory):
    """The smallest tables twice, with keys of the copy moved on by the largest: the last supplier and the first of the copy share theirs, so that items stand twice."""
    folder = tmp_path_factory.mktemp("shared_keys")
    con = duckdb_on(FOLDER)
    most = lambda t, key: con.sql(f"SELECT max({key}) FROM {t}").fetchall()[0][0]
    part, order, supplier = most("part", "p_partkey"), most("lineitem", "l_orderkey"), most("supplier", "s_suppkey")
    for t in TABLES:
        moved = {"part": f"p_partkey + c * {part} AS p_partkey", "lineitem": f"l_partkey + c * {part} AS l_partkey, l_orderkey + c * {order} AS l_orderkey, l_suppkey + c * {supplier} AS l_suppkey", "supplier": f"s_suppkey + c * {supplier} AS s_suppkey"}.get(t)
        rows = f"SELECT * EXCLUDE (c) REPLACE ({moved}) FROM {t} CROSS JOIN range(2) r(c)" if moved else f"SELECT * FROM {t}"
        con.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["calibration", "field_accuracy", "group_scores"])
def test_items_of_one_key(spark, shared_keys, name):
    ours, theirs = same(plans.queries()[name](spark, shared_keys), duckdb_on(shared_keys), plans.oracles()[name])
    assert len(theirs[1]) > 0
    assert ours == theirs


def test_unclosed_references(spark):
    """A title that is cut inside a reference keeps what is left of it."""
    import duckdb

    html = ["<h1>a&amp;&amp b</h1>", "x &amp", "&amp;amp &lt;&copy; &copy &quot", "&#39;&nbsp;&amplify; &notit;", "a & b &", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT unnest($1::VARCHAR[]) AS html, unnest(range(6)) AS page_id", [html])
    theirs = sorted(con.sql(plans.oracles()["sanitize_pages"]).fetchall())
    pages = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    tables = type("T", (), {"pages": pages})()
    ours = evidence_queries.sanitize_pages(tables).collect()
    assert sorted((r["page_id"], r["text"]) for r in ours) == theirs


@pytest.mark.parametrize("name,pattern,times", [("pick_evidence", "docs.iso.org", 0), ("apply_evidence", "docs.iso.org", 1), ("safe_urls", "://(?:", 2)])
def test_pages_are_read_once(spark, name, pattern, times):
    """Candidates, known by a host in their URLs, stand in a plan once at most; each of the two inputs of safe_urls finds hosts once."""
    plan = plans.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) <= times


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
