"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``WINDOW`` words. As a set of shingles (``SHINGLE`` successive words),
a window is contained in a document only if all its shingles are, so one shingle is prefix enough:
the rarest over all documents. A first scan counts the windows' shingles in all documents; each window
is then filed under its rarest one. A second scan emits the places of a document where a filed shingle
stands, with the words around it; both scans skip other words by a bit filter of bounded size, which
lets nothing wanted through unseen. The places are joined with the windows by shingle, must leave room for the
whole window within the document (position and length), and are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, Words, bounded_batches, frame, join_by_key, mix, text_chunks, written

WINDOW, SHINGLE = 10, 3
#: Bits of the filter at least and at most (as powers of two); 16 MB at most.
LEAST_BITS, MOST_BITS = 20, 27
#: Windows are broadcast when their texts and items have at most so many bytes and they are at most so many.
WINDOW_BYTES, WINDOW_ROWS = 32 << 20, 200_000
#: Bytes between words: all ASCII but digits and letters (``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[b for b in range(128) if not chr(b).isalnum()]] = True


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the ``size`` words from each place of a batch, and whether they lie in one text."""
    n = len(words.hash)
    total = np.full(max(0, n - size + 1), size, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words.hash[i : n - size + 1 + i] * np.uint64(2 * i + 3)
    ends = np.repeat(words.first[1:], np.diff(words.first))[: len(total)]
    return mix(total), np.arange(len(total)) + size <= ends


class HashFilter:
    """Bits that are set for the leading bits of every wanted hash."""

    def __init__(self, hashes: DataFrame, column: str):
        wanted = hashes.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(32 * wanted).bit_length()))
        place = F.shiftrightunsigned(column, 64 - self.bits)
        rows = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned({column}, {64 - self.bits}) & 63))")).alias("mask")).toPandas()
        self.masks = np.zeros(1 << (self.bits - 6), np.uint64)
        self.masks[rows.word.to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.masks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, text, len, keys) of every window of (item_id, text): its words joined by spaces, and the hashes of its shingles in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, texts in text_chunks(list(batch.item), list(batch.text)):
                w = Words(texts, separators=SEPARATORS)
                found = [w.data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(w.start, w.end, strict=True)]
                keys = {s: runs(w, s)[0].view(np.int64) for s in range(1, min(SHINGLE, window) + 1)}
                rows = []
                for item, a, b in zip(ids, w.first[:-1], w.first[1:], strict=True):
                    k = min(window, b - a)
                    s = min(SHINGLE, k)
                    for i in range(a, b - k + 1 if k else a):
                        rows.append((item, " ".join(found[i : i + k]), k, keys[s][i : i + k - s + 1].tolist()))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=["item", "text", "len", "keys"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["item", "text", "len", "keys"])

    some = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    return bounded_batches(some).mapInPandas(run, "item string, text string, len int, keys array<long>")


def _counted(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n): how often shingles that pass a filter of ``wanted`` (key) occur in all documents, by task."""
    held = docs.sparkSession.sparkContext.broadcast(HashFilter(wanted, "key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in text_chunks([0] * len(batch), list(batch.text), 1 << 21):
                w = Words(texts, separators=SEPARATORS)
                for s in sizes:
                    h, whole = runs(w, s)
                    key, n = np.unique(h[held.value.passes(h) & whole].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"key": key, "n": n})

    return bounded_batches(docs.select("text")).mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, wanted: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(row, doc_id, n_words, key, at, lead, around): each place where a wanted shingle may stand, with the words from ``lead`` on.

    A document without such a place has one row, with a null key.
    """
    held = docs.sparkSession.sparkContext.broadcast(HashFilter(wanted, "key"))
    names = ["row", "doc_id", "n_words", "key", "at", "lead", "around"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for ids, texts in text_chunks(list(batch.doc_id), list(batch.text), 1 << 21):
                w = Words(texts, separators=SEPARATORS)
                met: dict[int, list] = {}
                for s in sizes:
                    h, whole = runs(w, s)
                    at = np.flatnonzero(held.value.passes(h) & whole)
                    for p, d in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), strict=True):
                        met.setdefault(d, []).append((p, s, int(h[p : p + 1].view(np.int64)[0])))
                out = []
                for d, doc in enumerate(ids):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    for p, s, key in met.get(d, ()):
                        low, high = max(a, p - window + s), min(b, p + window)
                        around = " ".join([w.data[x:y].tobytes().decode("utf-8", "surrogatepass") for x, y in zip(w.start[low:high], w.end[low:high], strict=True)])
                        out.append((row + d, doc, b - a, key, p - a, low - a, around))
                        if len(out) >= 20_000:
                            yield frame(out, names, ["key", "at", "lead"])
                            out = []
                    if d not in met:
                        out.append((row + d, doc, b - a, None, None, None, None))
                yield frame(out, names, ["key", "at", "lead"])
                row += len(ids)

    return bounded_batches(docs.select("doc_id", "text")).mapInPandas(run, "row long, doc_id string, n_words long, key long, at long, lead long, around string")


def _bounded_rows(df: DataFrame, size) -> int:
    """Rows of ``df``, or one more than may be broadcast where they, or ``size`` summed over them, are too many."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return n if (total or 0) <= WINDOW_BYTES else WINDOW_ROWS + 1


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of documents (doc_id, text) that lie in windows of benchmark items (item_id, text).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A window is ``window``
    successive words of an item; an item of fewer words is one window. Returns one row per document row:
    doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with a window that
    occurs), items_sha256 (of those item_ids, sorted as strings, joined by commas), contaminated (n_hit > 0).

    Null, empty or wordless document: no words, nothing hit. Null, empty or wordless item: no window. Null
    item_id: its windows are hit, but count for no item. Repeated item_ids are one item with the windows of all its
    rows. Null doc_id and repeated documents: each row by itself. Other columns are ignored. Empty tables: no rows, or nothing hit.
    """
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # null ids would make floats of numbers in pandas
    cut_items = written(windows_of(items, window))
    distinct = cut_items.groupBy("text").agg(F.first("len").alias("len"), F.first("keys").alias("keys"), F.array_compact(F.collect_set("item")).alias("items"))
    distinct = written(distinct.withColumn("win", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in distinct.select(F.least("len", F.lit(SHINGLE)).alias("s")).distinct().collect())
    every = distinct.select("win", F.posexplode("keys").alias("offset", "key"))
    wanted = written(every.select("key").distinct())
    rarity = every.join(_counted(docs, wanted, sizes), "key", "left").select("win", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset").alias("rank"))
    rarest = rarity.groupBy("win").agg(F.min("rank").alias("rank")).join(distinct, "win").select(F.col("rank.key").alias("key"), F.struct("win", F.col("rank.offset").alias("offset"), "len", "text").alias("filed"))
    prefix = written(rarest.groupBy("key").agg(F.collect_list("filed").alias("filed")))
    places = written(_places(docs, prefix.select("key"), sizes, window))

    clean = places.where("key is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    met = places.where("key is not null")
    rows = _bounded_rows(prefix, F.expr("aggregate(filed, 0L, (s, x) -> s + octet_length(x.text) + 32)"))
    met = join_by_key(met, prefix, "key", "row", "left", WINDOW_ROWS, rows)
    fits = "x -> at - x.offset >= lead and at - x.offset + x.len <= n_words and array_join(slice(words, int(at - x.offset - lead) + 1, x.len), ' ') = x.text"
    met = met.withColumn("words", F.split("around", " ")).withColumn("hits", F.expr(f"transform(filter(filed, {fits}), x -> struct(at - x.offset as start, at - x.offset + x.len as stop, x.win as win))"))
    hits = written(met.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("h")).select("row", "doc_id", "n_words", "h.start", "h.stop", "h.win"))

    before = F.max("stop").over(Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest("start", F.coalesce("before", "start")), F.lit(0))
    spans = hits.select("row", "doc_id", "n_words", "start", "stop").distinct().withColumn("before", before)
    spans = spans.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum(new), F.lit(0)).alias("n_hit"))
    owners = distinct.select("win", "items")
    rows = _bounded_rows(owners, F.expr("aggregate(items, 0L, (s, x) -> s + octet_length(x) + 16)"))
    named = join_by_key(hits.where("win is not null").select("row", "win").distinct(), owners, "win", "row", "inner", WINDOW_ROWS, rows)
    named = named.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("items"))
    dirty = spans.join(named, "row", "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = clean.unionByName(dirty)
    joined = F.array_join(F.array_sort("items"), ",")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rows of op13_benchmark_decontamination in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) z
), k AS (SELECT DISTINCT k FROM win),
o AS MATERIALIZED (
  SELECT doc_id, i, k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k) z) y JOIN win USING (k, x)
), h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o) z) y GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) z GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
