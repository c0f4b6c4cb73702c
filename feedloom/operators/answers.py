"""Model answers as tables: requests out, responses in, logs and caches. A model is only called through a function that the user gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L


def build_requests(products: DataFrame, evidence: DataFrame, most: int = 2000) -> DataFrame:
    """(product_id, fields, evidence): products (product_id, needs) with open needs and evidence lines (product_id, pos, field, text).

    A line has four characters at least with its colon and separator, so that no later one than the
    ``most // 4 + 1``st can reach into the evidence; Spark keeps that many of a product before the shuffle.
    """
    line = F.concat("field", F.lit(": "), "text")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(line.isNull(), "pos", "field", "text"))
    first = evidence.select("product_id", "pos", "field", "text").withColumn("_n", place).where(F.col("_n") <= most // 4 + 1)
    lines = first.groupBy("product_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field", "text"))), lambda x: F.concat(x["field"], F.lit(": "), x["text"])), "; "), 1, most).alias("evidence"))
    return products.where(F.size("needs") > 0).join(lines, "product_id").select("product_id", F.array_join("needs", ", ").alias("fields"), "evidence")


def request_totals(products: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: matched products (with evidence) that a model is asked about (requests), and those without open needs (avoided)."""
    matched = products.join(evidence.select("product_id").distinct(), "product_id", "left_semi")
    return matched.agg(F.count_if(F.size("needs") > 0).alias("requests"), F.count_if(F.size("needs") == 0).alias("avoided"))


def parse_responses(raw: DataFrame, schema: str) -> DataFrame:
    """Adds parsed (of the DDL schema) and parse_error to (response): code fences are stripped, bad JSON is an error, confidence defaults to 0.8."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("response", r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"(?s)\s*```\s*$", ""))
    parsed = F.from_json(bare, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    out = raw.withColumn("parsed", parsed)
    broken = F.col("parsed").isNull() | F.col("parsed._bad").isNotNull() | (bare == "") | ~F.coalesce(bare.rlike(r"(?s)^\{.*\}$"), F.lit(False))
    out = out.withColumns({"parse_error": F.when(broken, "JSON parse error"), "parsed": F.when(~broken, F.col("parsed").dropFields("_bad"))})
    return out.withColumn("parsed", F.when(F.col("parsed").isNotNull(), F.col("parsed").withField("confidence", F.coalesce("parsed.confidence", F.lit(0.8))))) if "confidence" in schema else out


def apply_responses(answers: DataFrame, needs: DataFrame) -> DataFrame:
    """(product_id, field, value, number, confidence, status): answers (product_id, values map, confidence) that were asked for and are not empty."""
    rows = answers.select("product_id", F.coalesce("confidence", F.lit(0.6)).alias("confidence"), F.explode("values").alias("field", "value"))
    rows = rows.where(F.trim("value") != "").join(needs.select("product_id", F.explode("needs").alias("field")).distinct(), ["product_id", "field"])
    number = F.replace(F.nullif(F.regexp_extract(F.trim("value"), r"^(-?[0-9]+(?:[.,][0-9]+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return rows.select("product_id", "field", F.trim("value").alias("value"), number.alias("number"), "confidence", F.lit("inferred").alias("status"))


#: Partitions of requests whose shares of the quota are kept on the driver at most.
_PARTS = 100_000


def ask_model(requests: DataFrame, call: Callable[[str], str], quota: int | None = None, attempts: int = 3, key: str = "product_id", prompt: str = "prompt") -> DataFrame:
    """(key, response, status, error, attempts) of a user's model, one row per request (key, prompt); null prompts are not asked.

    ``call`` takes a prompt and returns a text or raises; a request that raises is asked again, ``attempts`` times at most, and ends as a row of
    status error for ``classify_errors``. Every call counts against ``quota``. It is handed out before anything is asked: each
    partition gets a call for each of its requests, in order of partitions, and what is left is shared as further attempts.
    A request without a call left is an error of its own. ``requests`` must give the same partitions when it is read again, as a written table does; a task that is
    run again after a lost executor asks again.
    """
    here = requests.where(F.col(prompt).isNotNull()).select(F.col(key).alias(key), F.col(prompt).cast("string").alias("_prompt"))
    shares: dict[int, tuple[int, int]] = {}
    if quota is not None:
        sizes = here.groupBy(F.spark_partition_id().alias("part")).count().orderBy("part").limit(_PARTS + 1).collect()
        if len(sizes) > _PARTS:
            raise ValueError(f"requests in more than {_PARTS} partitions: coalesce them first")
        left = quota
        for r in sizes:
            shares[r["part"]] = (r["count"], min(left, r["count"]))
            left -= shares[r["part"]][1]
        for part, (n, share) in shares.items():
            more = min(left, n * (attempts - 1))
            shares[part], left = (n, share + more), left - more

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, calls = shares.get(TaskContext.get().partitionId(), (0, None)) if quota is not None else (0, None)
        for batch in batches:
            out = []
            for text in batch["_prompt"]:
                waiting -= 1
                response, error, n = None, "quota exhausted", 0
                # a further attempt only takes a call that no waiting request needs
                while n < attempts and (calls is None or calls > (0 if n == 0 else max(0, waiting))):
                    n += 1
                    calls = None if calls is None else calls - 1
                    try:
                        response, error = call(text), None
                        break
                    except Exception as e:  # noqa: BLE001  a failing request is a row, not the end of the job
                        error = str(e)
                out.append((response, "success" if error is None else "error", error, n))
            yield batch[[key]].assign(**{c: [x[i] for x in out] for i, c in enumerate(("response", "status", "error", "attempts"))})

    kind = requests.schema[key].dataType.simpleString()
    return here.mapInPandas(ask, f"`{key}` {kind}, response string, status string, error string, attempts int")


def classify_errors(logs: DataFrame) -> DataFrame:
    """Adds code, message and safe_message to log rows (status, error, attempts)."""
    e = F.col("error")
    named = F.nullif(F.regexp_extract(e, r"status ([0-9]{3})", 1), F.lit(""))
    code = named
    for n in ("429", "500", "502", "503", "504"):
        code = F.coalesce(code, F.when(e.contains(n), n))
    code = F.coalesce(code, F.when(e.contains("network") | e.contains("ECONNREFUSED"), "NETWORK"), F.when(e.contains("timeout"), "TIMEOUT"), F.when(e.contains("JSON parse error"), "JSON_PARSE"), F.lit("UNKNOWN"))
    safe = F.when(e.contains("429"), "AI service rate limit reached.").when(e.contains("401") | e.contains("403"), "AI service authentication error.")
    safe = safe.when(e.contains("timeout") | e.contains("network") | e.contains("ECONNREFUSED"), "AI service network timeout.").otherwise("Step failed.")
    bad = (F.col("status") == "error") & e.isNotNull()
    message = F.concat(F.lit("["), code, F.lit("] Error after "), F.coalesce("attempts", F.lit(1)).cast("string"), F.lit(" attempt(s): "), e)
    return logs.withColumns({"code": F.when(bad, code), "message": F.when(bad, message), "safe_message": F.when(bad, safe)})


def input_hash(columns: list[str | Column]) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def step_cache(logs: DataFrame) -> DataFrame:
    """The latest successful log of every (item_id, step, input_hash)."""
    order = Window.partitionBy("item_id", "step", "input_hash").orderBy(F.col("created_at").desc(), F.col("log_id").desc())
    return logs.where("status = 'success'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def attributes_from_responses(answers: DataFrame, most: int = 50) -> DataFrame:
    """(item_id, seq, label, value, uom) of answers (item_id, attributes array): labelled values, numbered, measures split again."""
    full = F.filter("attributes", lambda a: (F.coalesce(a["label"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""))
    rows = answers.select("item_id", F.posexplode(F.slice(full, 1, most)).alias("i", "a"))
    both, pattern = F.concat("a.value", F.lit(" "), "a.uom"), r"^([0-9.]+)\s*(\w+)$"
    again = F.coalesce(both.rlike(pattern), F.lit(False))
    return rows.select("item_id", (F.col("i") + 1).alias("seq"), "a.label", F.when(again, F.regexp_extract(both, pattern, 1)).otherwise(F.col("a.value")).alias("value"), F.when(again, F.regexp_extract(both, pattern, 2)).otherwise(F.col("a.uom")).alias("uom"))


def enforce_lengths(descriptions: DataFrame) -> DataFrame:
    """Descriptions cut to the limit of their field, with three points, and counted again."""
    limits = F.create_map(*[F.lit(x) for kv in L.MAX_LENGTHS.items() for x in kv])
    most = F.coalesce(F.try_element_at(limits, "field_name"), F.lit(L.DEFAULT_LENGTH))
    value = F.when(F.length("value") > most, F.concat(F.substring("value", F.lit(1), most - 3), F.lit("..."))).otherwise(F.col("value"))
    return descriptions.withColumn("value", value).withColumn("char_count", F.length("value"))


def fractions_to_decimals(text: Column) -> Column:
    """Every W-N/D and N/D as a decimal; a division by zero stays as it is."""
    pattern = r"([0-9]+)-([0-9]+)/([0-9]+)|([0-9]+)/([0-9]+)"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(F.regexp_replace(text, pattern, "\x01"), "\x01", -1)

    def decimal(m: Column) -> Column:
        get = lambda i: F.regexp_extract(m, pattern, i).try_cast("double")
        value = F.when(get(1).isNotNull(), get(1) + F.try_divide(get(2), get(3))).otherwise(F.try_divide(get(4), get(5)))
        plain = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
        return F.coalesce(plain, m)

    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(decimal(F.get(found, i)), F.lit("")))), "")


def attribute_text(attributes: DataFrame) -> DataFrame:
    """(item_id, text): ``label: value uom`` of every attribute in order, joined by semicolons."""
    one = F.struct("seq", F.concat("label", F.lit(": "), F.coalesce("value", F.lit("")), F.coalesce(F.concat(F.lit(" "), "uom"), F.lit(""))).alias("t"))
    return attributes.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "; ").alias("text"))
