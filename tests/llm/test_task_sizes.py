"""How much single tasks read, taken from the event log of a session of their own."""

import glob
import json
import subprocess
import sys
import textwrap
from collections import defaultdict

import pytest


def stages_of(tmp_path, body, conf=()):
    """(records read by each task) of every stage of a job, by running ``body`` (with spark and folder) in a new session."""
    code = f"""
    import sys; sys.path.insert(0, {str(sys.path[0])!r}); sys.path.insert(0, ".")
    from pyspark.sql import SparkSession, functions as F
    folder = {str(tmp_path)!r}
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
    b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + folder + "/log").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
    b = b.config("spark.checkpoint.dir", "file://" + folder + "/shared").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.autoBroadcastJoinThreshold", "100k")
    for k, v in {list(conf)!r}:
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    """
    (tmp_path / "log").mkdir()
    subprocess.run([sys.executable, "-c", textwrap.dedent(code) + textwrap.dedent(body) + "\nspark.stop()"], check=True, timeout=600, capture_output=True)
    read = defaultdict(list)
    for name in glob.glob(f"{tmp_path}/log/*"):
        for line in open(name):
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                read[event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    return read


@pytest.mark.parametrize("documents", [60_000])
def test_no_task_of_near_dedup_reads_all_documents(tmp_path, documents):
    read = stages_of(
        tmp_path,
        f"""
    from feedloom.llm import common, near_dedup
    from feedloom.llm.near_dedup import grouped
    near_dedup.TASK_BYTES, common.ROWS_A_PART = 1 << 17, 1000  # what tasks may hold, small as the corpus is
    docs = spark.range({documents}).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 7), i -> hex(xxhash64(id, i)))) as text")
    same = spark.range(3000).selectExpr("id + 1000000 as doc_id", "concat_ws(' ', transform(sequence(0, 60), i -> if(i = id % 50, hex(xxhash64(id)), 'w' || i))) as text")
    assert grouped(docs.union(same), 5, 80).count() == {documents} + 3000
    """,
    )
    large = {k: v for k, v in read.items() if sum(v) > 20_000}
    assert large
    for k, v in large.items():
        assert max(v) <= 3 * sum(v) / 8, (k, v)  # tasks are dealt by hash


def test_near_dedup_broadcasts_few_rows(tmp_path):
    stages_of(
        tmp_path,
        """
    from feedloom.llm.near_dedup import near_duplicates
    pairs = "concat_ws(' ', transform(sequence(0, 11), i -> hex(xxhash64(id div 2, i))), if(id % 2 = 0, null, 'z'))"
    found = near_duplicates(spark.range(120_000).selectExpr("id as doc_id", pairs + " as text"), n=4)
    assert found.where("kept").count() == 60_000 and found.where("component_id <> doc_id - doc_id % 2").isEmpty()
    """,
    )
    nodes, rows = set(), []

    def walk(node):
        if node["nodeName"].startswith("BroadcastExchange"):
            nodes.update(m["accumulatorId"] for m in node["metrics"] if m["name"] == "number of output rows")
        for child in node["children"]:
            walk(child)

    for name in glob.glob(f"{tmp_path}/log/*"):
        for event in map(json.loads, open(name)):
            if "sparkPlanInfo" in event:
                walk(event["sparkPlanInfo"])
            elif event["Event"].endswith("DriverAccumUpdates"):
                rows += [n for k, n in event["accumUpdates"] if k in nodes]
    assert max(rows, default=0) <= 50_000  # the driver holds what is broadcast
