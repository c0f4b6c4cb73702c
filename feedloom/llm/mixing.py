"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. The text is read twice and never shuffled: once for word totals by
source and hash bucket, once for the output. Only sums, and the documents of one boundary bucket
in ``BUCKETS`` for each source, are grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_by_key

#: Buckets of the seeded order by its leading bits (12 of 60).
BUCKETS = 4096


def word_count(text: str) -> Column:
    """Number of words of a text column; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(doc_id: str, seed: int) -> Column:
    """A 60-bit number that orders documents by the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Targets for (source, source_size): ``share`` of all sizes by weight, none above ``epochs`` times its size.

    Sources in code-point order, null last, take the weights in turn. Sorted by size per weight,
    the sources that the common level would lift above their cap are a prefix; the level follows
    from running sums. One row per source: a table far smaller than the documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "pos": F.row_number().over(order),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "after": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "wanted": F.sum("source_size").over(everything) * F.lit(float(share)),
        }
    ).withColumn("level", (F.col("wanted") - F.col("before")) / F.col("after"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("pos", "level"))
    rows = rows.withColumn("common", F.min(free).over(everything)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), "cap").alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 20240601) -> DataFrame:
    """Documents with the words that a mixture of their sources takes of each.

    Adds to every row of ``docs`` (which has doc_id, text, source): size, source_size, target and
    taken; columns of those names in ``docs`` are replaced. A source with target/source_size = w + f
    takes every document w whole times, and once more the documents first in the seeded order until
    f of the source's words are reached; the last of these is taken in part, so that a source's
    words equal its target rounded.

    Null text or no words: size and taken 0. Null source: a source of its own, last. Rows with
    equal doc_id (or null) have the same place in the order and share a partial take in proportion.
    Empty table: no rows. Running it again gives the same rows.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    rank = seeded_order("doc_id", seed)
    bucket = F.shiftright("_rank", 48)
    sums = cut(docs.select("source", rank.alias("_rank"), word_count("text").alias("_size")).groupBy("source", bucket.alias("bucket")).agg(F.sum("_size").alias("words")))
    plan = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut(plan.withColumn("_whole", whole).withColumn("_need", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long")))
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    at = sums.withColumn("until", F.sum("words").over(by_bucket)).join(plan.select(F.col("source").alias("_s"), "_need"), F.col("source").eqNullSafe(F.col("_s")))
    at = at.where("until - words < _need and _need <= until").select("source", F.col("bucket").alias("_bucket"), (F.col("_need") - F.col("until") + F.col("words")).alias("rest"))
    near = join_by_key(docs.select("doc_id", "text", "source", rank.alias("_rank")), at, "source", "doc_id").where(bucket == F.col("_bucket"))
    ties = near.groupBy("source", "_rank", "rest").agg(F.sum(word_count("text")).alias("words"))
    until = F.sum("words").over(Window.partitionBy("source").orderBy("_rank"))
    edge = ties.withColumn("until", until).where("until - words < rest and rest <= until")
    edge = edge.select(F.col("source").alias("_s"), F.col("_rank").alias("_edge"), (F.col("rest") - F.col("until") + F.col("words")).alias("_part"), F.col("words").alias("_part_of"))
    plan = cut(plan.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_need"))
    out = join_by_key(docs.withColumns({"_rank": rank, "size": word_count("text")}), plan, "source", "doc_id")
    more = F.when(F.col("_rank") < F.col("_edge"), F.col("size")).when(F.col("_rank") == F.col("_edge"), F.expr("size * _part div _part_of")).otherwise(F.lit(0))
    return out.withColumn("taken", (F.col("_whole") * F.col("size") + more).cast("long")).drop("_rank", "_whole", "_edge", "_part", "_part_of")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, the last time cut behind the words taken in part, with all white space before them as it was.

    Columns as in ``docs``. Documents of which no word is taken are not in the mixture. Null, empty and tied rows as in ``mix_sources``. Empty table: no rows.
    """
    rows = mix_sources(docs, **options)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), 1, left.cast("int")), "")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(head)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


#: The rows of op3_mix_sources in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20240601:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS rnk
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (
  SELECT *, row_number() OVER q AS pos,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
         (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS wanted
  FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST)
), l AS (SELECT *, (wanted - before) / after AS level FROM o),
t AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(level, pos) FROM l WHERE level * weight <= cap) * weight), cap) AS target
  FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), n AS (SELECT *, floor(target - whole * source_size + 0.5::DOUBLE)::BIGINT AS need FROM p),
g AS (
  SELECT source, rnk, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY rnk)::BIGINT AS until
  FROM d GROUP BY source, rnk
)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (n.whole * d.size + CASE WHEN g.until <= n.need THEN d.size WHEN g.until - g.words < n.need
         THEN d.size * (n.need - g.until + g.words) // g.words ELSE 0 END)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.rnk = g.rnk
"""
