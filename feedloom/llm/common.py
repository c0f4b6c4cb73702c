"""Helpers shared by the training-data operators: shared storage, bounded joins, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast after their rows have been counted.
BROADCAST_ROWS = 20_000
#: Tables of a few numbers a row may be broadcast up to this count (about 4 MB on the driver, whatever the input); a partition of such rows.
BROADCAST_IDS, ROWS_A_PART = 50_000, 100_000
#: Rows of one key that a join keeps together at most, about.
PER_SALT = 4096
#: Word separators of every text operator here: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local session gets a new temporary folder; on a cluster that is an error,
    as executors of other machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder (a reliable checkpoint that survives lost executors)."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (columnar, for wide intermediates)."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing will read again: what came of it must be written or checkpointed itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to hold at most ``rows`` rows of a few numbers, in at most one partition for every ``ROWS_A_PART`` of them.

    Nothing is shuffled, so what ``df`` is made from since its last shuffle runs in those partitions too: ``rows`` must bound
    that as well. It is not for the few rows that a filter leaves of a large aggregation.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_PART)))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after texts for Python workers are limited to 8 MB a batch in its session (one row may be larger).

    The default of 64 MB a batch would let two workers of an executor hold some hundred MB each.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows, found by counting no more than that."""
    return df.limit(most + 1).count() <= most


def join_by_key(big: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "inner", most: int = BROADCAST_ROWS, rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join (inner or left) on one null-safe key that may be skewed on the big side and is unique on the right side.

    The right side is counted, unless it is known to have at most ``rows``. Up to ``most`` rows are broadcast. Beyond that, keys with more than
    ``PER_SALT`` rows on the big side (counted here, or given as (key, n)) are dealt over one salt for
    every ``PER_SALT`` rows by the hash of ``salt_by``, with the right side's row repeated for each. At most one
    row in ``PER_SALT`` is such a key. Other keys are joined as they are.
    """
    right = right.withColumnRenamed(key, "_key")
    if rows <= most if rows is not None else small(right, most):
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["_key"]), how).drop("_key")
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    heavy = cut(counts.where(F.col("n") > PER_SALT).select(F.col(key).alias("_heavy"), F.ceil(F.col("n") / PER_SALT).cast("int").alias("_salts")))
    if heavy.isEmpty():
        return big.join(right, big[key].eqNullSafe(right["_key"]), how).drop("_key")
    heavy = F.broadcast(heavy) if small(heavy) else heavy
    left = big.join(heavy, F.col(key).eqNullSafe(F.col("_heavy")), "left").drop("_heavy")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = right.join(heavy, F.col("_key").eqNullSafe(F.col("_heavy")), "left").drop("_heavy")
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_salt2"]), how).drop("_key", "_salt", "_salt2")


def crc_remainder(column: str, n: int):
    """crc32 of the column as text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# --- words of UTF-8 text as flat numpy arrays -------------------------------------------------

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _PIECE + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a batch of texts: hash, byte start and end, and the text of each; ``first`` bounds each text's words.

    ``separators`` tells for each byte whether it stands between words; the space must be one.
    """

    def __init__(self, texts: list[str | None], lower: bool = True, separators: np.ndarray = _SEPARATOR):
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
        self.data = _LOWER[data] if lower else data
        separator = separators[data]
        edge = np.flatnonzero(np.diff(separator.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(data))
        ends = np.cumsum([len(b) + 1 for b in blobs]) if blobs else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + _PIECE, "right")))
            piece = self.data[at : self.end[j - 1]].astype(np.uint64) + np.uint64(1)
            power, inverse = _powers(len(piece) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * power[: len(piece)], dtype=np.uint64)])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
            i = j
        return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n successive words; fewer words give the whole sequence as one; none give none."""
    if len(words) == 0:
        return words
    if len(words) < n:
        total = np.full(1, len(words), np.uint64)
        for i in range(len(words)):
            total = total * np.uint64(_BASE) + words[i : i + 1] * np.uint64(2 * i + 3)
        return mix(total)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(_BASE) + words[i : len(words) - n + 1 + i] * np.uint64(2 * i + 3)
    return np.unique(mix(total))


def frame(rows: list[tuple], names: list[str], whole: list[str]) -> pd.DataFrame:
    """A pandas frame of rows, whose columns ``whole`` hold 64-bit numbers or null without a detour by floating point."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.array(c, "Int64") if n in whole else list(c) for n, c in zip(names, columns, strict=True)})


def text_chunks(ids: list, texts: list, limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Cut a batch into runs of about ``limit`` characters, so that memory follows the longest text, not the batch."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield ids[start : i + 1], texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each run of about ``ROWS_A_PART`` rows of a partition, replaced by (node, smallest node reachable in that run)."""
    most = ROWS_A_PART

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > most:
                yield contracted(held)
                held = []
            held.append(batch)
        if held:
            yield contracted(held)

    def contracted(held: list[pd.DataFrame]) -> pd.DataFrame:
        nodes, ends = np.unique(pd.concat(held)[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while (new[new] != new).any():
                new = new[new]
            new = new[label]
            if (new == label).all():
                moved = label != np.arange(len(nodes))
                return pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})
            label = new

    return edges.mapInPandas(run, "u long, v long")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Connected components of an edge table (a, b) of long numbers, until nothing changes.

    Returns (node, component): the smallest node reachable, for every node of an edge whose
    component is not itself. Runs of edges are first contracted within partitions; then each round takes a
    large-star and a small-star step: a keyed minimum (combined before the shuffle) and a join, with
    heavy nodes salted. Equal, repeated and null edges are ignored. ``most``, if given, bounds the
    number of edges. Edges of a single run are done when contracted.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if most is None:
        edges = cut(edges)
        most = edges.count()
    edges = forest(few(edges, most))
    if most <= ROWS_A_PART:
        return cut(edges).select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = written(edges)  # a checkpoint keeps the planner's estimate, which the joins of each round raise to a high power

    def state() -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def lowest(rows: DataFrame) -> DataFrame:
        low = few(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        return join_by_key(rows, low, "u", "v", most=BROADCAST_IDS, rows=2 * n)

    last, found = None, state()
    while found != last and found[0]:
        n = found[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = lowest(large)
        star = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        before, edges = edges, written(few(star.distinct(), 2 * n))
        discard(before)
        last, found = found, state()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
