"""Exact top-k inner-product search over an impact-ordered index, score at a time.

The index is a table of blocks of at most ``BLOCK`` vectors and ``POSTINGS`` postings. A block holds every non-zero component
as a posting (row, dimension, value), ordered by descending quantised impact (size of the
value in ``LEVELS`` steps), with the borders of the segments. A packet of queries, kept by their non-zero
components too, meets some blocks in one task: postings of the rows still possible are added to the accumulators, segment by segment from
the highest impact down. After each segment
the part of every vector not yet seen is bounded by its length times the query's length, so each
score is known within a margin, rounding included. Rows that cannot reach any query's k-th best
lower bound are left, and their further postings are not read. Processing stops when few rows are
possible, or at the end; those possible members are rescored exactly in integers, by their postings. Every query first
meets one block alone; its k-th best score there is a bound that all other blocks start from.
No matrix of rows or queries by dimensions is made: memory follows the postings, however long a vector is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

BLOCK, POSTINGS, LEVELS = 4096, 1 << 20, 8
#: Queries of a packet, those that are searched at a time at most, and the numbers of their vectors and accumulators at a time.
QUERIES, CHUNK, NUMBERS = 16384, 512, 1 << 18
#: Blocks that a packet meets in one task, about.
TOGETHER = 2
_EPS = 2.0**-52
#: A block is left for rescoring when at most this many rows per query and result can still be members.
SLACK = 4


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as whole numbers; unusable vectors are left out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers as 16 bits where they fit, else as 64."""
    return x.astype(np.int16 if len(x) and np.abs(x).max() < 1 << 15 else np.int64).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if len(blob) == 2 * n else np.int64).astype(np.int64)


def _sparse(vs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of every non-zero component."""
    sizes = np.fromiter(map(len, vs), np.int64, len(vs))
    flat = np.fromiter(chain.from_iterable(vs), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(vs)), sizes)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(flat)
    return row[kept], dim[kept], flat[kept]


def posting_block(name: int, ids: list, vs: list) -> tuple:
    """One row of the index: block, ids, rows, row and dimension of each posting, values, borders of the segments."""
    row, dim, value = _sparse(vs)
    size = np.abs(value).astype(np.float64)
    level = np.ceil(size * (LEVELS / max(1.0, size.max(initial=0)))).astype(np.int64)
    order = np.lexsort((row, -level))
    borders = np.searchsorted(-level[order], -np.arange(LEVELS, 0, -1), "right")
    return name, np.array(ids, np.int64).tobytes(), len(ids), row[order].astype(np.int16).tobytes(), dim[order].astype(np.int32).tobytes(), _narrow(value[order]), borders.tolist()


BLOCK_COLUMNS = ["block", "ids", "rows", "owners", "dims", "values", "borders"]
_BLOCK_SCHEMA = "block long, ids binary, rows int, owners binary, dims binary, values binary, borders array<int>"


def index(vectors: DataFrame) -> DataFrame:
    """The impact-ordered index: one row per block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vs, held, n = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, v in zip(batch.vec_id, batch.v, strict=True):
                if ids and (len(ids) == BLOCK or held + len(v) > POSTINGS):
                    yield pd.DataFrame([posting_block(n, ids, vs)], columns=BLOCK_COLUMNS)
                    ids, vs, held, n = [], [], 0, n + 1
                ids.append(i)
                vs.append(v)
                held += len(v)
        if ids:
            yield pd.DataFrame([posting_block(n, ids, vs)], columns=BLOCK_COLUMNS)

    return vectors.mapInPandas(run, _BLOCK_SCHEMA)


class Queries:
    """Vectors of a packet of queries by their non-zero components, sorted by query."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, dim: np.ndarray, value: np.ndarray, floor: np.ndarray | None = None):
        self.ids, self.row, self.dim, self.value, self.floor = ids, row, dim, value, floor

    def part(self, start: int, stop: int, used: np.ndarray) -> np.ndarray:
        """Queries start to stop by the dimensions ``used`` (sorted) alone."""
        a, b = np.searchsorted(self.row, [start, stop])
        at = np.minimum(np.searchsorted(used, self.dim[a:b]), len(used) - 1)
        here = used[at] == self.dim[a:b]
        out = np.zeros((stop - start, len(used)), np.int64)
        out[self.row[a:b][here] - start, at[here]] = self.value[a:b][here]
        return out


def search(queries: Queries, block: pd.Series, k: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector id and exact score of every query's k best rows of one block, without those surely below its floor.

    ``read`` is given the number of multiplications of each level and chunk of queries.
    """
    ids, n = np.frombuffer(block["ids"], np.int64), int(block["rows"])
    dim = np.frombuffer(block["dims"], np.int32)
    owner, value = np.frombuffer(block["owners"], np.int16).astype(np.int64), _wide(block["values"], len(dim))
    used, dim = np.unique(dim, return_inverse=True)
    square = value.astype(np.float64) ** 2
    whole = np.sqrt(np.bincount(owner, square, minlength=n))
    by_row = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_row], np.arange(n + 1))
    most = int(np.diff(bounds).max(initial=0))
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    step = max(1, min(CHUNK, NUMBERS // max(n, len(used), 1)))
    for at in range(0, len(queries.ids), step):
        stop = min(at + step, len(queries.ids))
        q = queries.part(at, stop, used) if len(used) else np.zeros((stop - at, 1), np.int64)
        qid, floor = queries.ids[at:stop], None if queries.floor is None else queries.floor[at:stop]
        i, j = _possible(qid, q, floor, ids, owner, dim, value, square, whole, block["borders"], most, k, read)
        score = _rescored(q, i, j, dim[by_row], value[by_row], bounds)
        i, vec, score = _best(i, ids[j], score, k)
        found.append((i + at, vec, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rescored(q: np.ndarray, i: np.ndarray, j: np.ndarray, dim: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Exact products of query rows i and block rows j, by the postings of j (in order of rows)."""
    score = np.zeros(len(i), np.int64)
    size = bounds[j + 1] - bounds[j]
    ends = np.cumsum(size)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + NUMBERS, "right")))
        some, n = size[start:stop], int(size[start:stop].sum())
        at = np.arange(n) - np.repeat(np.cumsum(some) - some, some) + np.repeat(bounds[j[start:stop]], some)
        product = q[np.repeat(i[start:stop], some), dim[at]] * value[at]
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(product)])
        score[start:stop] = np.diff(sums[np.concatenate([[0], np.cumsum(some)])])
        start = stop
    return score


def _possible(qid, q, floor, ids, owner, dim, value, square, whole, borders, most, k, read) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, block row) that can be among the query's k best of the block and above its floor."""
    n = len(ids)
    qt = np.ascontiguousarray(q.T, np.float64)
    length = np.sqrt((qt * qt).sum(axis=0))[None, :]
    #: Rounding of a sum of so many products is at most this share of the product of both lengths.
    rounding = (2 * most + 4 * LEVELS + 8) * _EPS
    alive, row_at = np.arange(n), np.arange(n)
    acc = np.zeros((n, len(q)))
    unseen = whole * whole
    own = ids[:, None] == qid[None, :]
    possible, low = ~own, 0
    for high in borders:
        if high == low and high < len(owner):
            continue
        here = low + np.flatnonzero(row_at[owner[low:high]] >= 0)
        mine = row_at[owner[here]]  # rising, as postings of a level are in order of rows
        for at in range(0, len(here), max(1, NUMBERS // len(q))):
            some = slice(at, at + max(1, NUMBERS // len(q)))
            rows, first = np.unique(mine[some], return_index=True)
            products = qt[dim[here[some]]]
            products *= value[here[some], None]
            acc[rows] += np.add.reduceat(products, first, axis=0)
        if read is not None:
            read.append(len(here) * len(q))
        unseen -= np.bincount(mine, square[here], minlength=len(alive))
        low = high
        w = whole[alive]
        margin = (np.sqrt(np.maximum(unseen, 0) + rounding * w * w) + rounding * w)[:, None] * length * (1 + 1e-9)
        bound = np.full(len(q), -np.inf)
        if len(alive) >= k:
            least = np.where(own, -np.inf, acc - margin)
            bound = np.partition(least, len(alive) - k, axis=0)[len(alive) - k]
        bound = bound if floor is None else np.maximum(bound, floor)
        possible = (acc + margin >= bound[None, :]) & ~own
        if low == len(owner) or possible.sum() <= SLACK * k * len(q):
            break
        keep = possible.any(axis=1)
        if not keep.all():
            alive, acc, unseen, own, possible = alive[keep], acc[keep], unseen[keep], own[keep], possible[keep]
            row_at = np.full(n, -1)
            row_at[alive] = np.arange(len(alive))
    j, i = np.nonzero(possible)
    return i, alive[j]


def _best(row: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of every row by descending score, then id."""
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], vec[rank < k], score[rank < k]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k rows of the highest integer inner product for every query, exactly.

    ``vectors`` has vec_id and embedding; components are floor(scale * x). Queries are the rows whose
    vec_id is divisible by ``every``; candidates are all rows of another vec_id. Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows where there are fewer.

    Vectors that are null or hold null or non-finite components, and rows of null vec_id, take no
    part. Vectors of different length: missing components count as 0. Repeated rows: each is a
    candidate; a repeated query id is asked once, with its smallest vector. Scores are exact while
    they fit 63 bits. Other columns are ignored. Empty table: no rows.
    """
    rows = scaled(vectors, scale)
    blocks = written(index(rows))
    asked = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    parts = max(1, -(-asked.count() // QUERIES))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        row, dim, value = _sparse(list(rows.v))
        return pd.DataFrame([(int(rows.part.iloc[0]), rows.vec_id.to_numpy(np.int64).tobytes(), row.astype(np.int32).tobytes(), dim.astype(np.int32).tobytes(), _narrow(value))], columns=["part", "asked", "at", "q_dims", "q"])

    packed = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part")
    packed = written(packed.applyInPandas(gather, "part int, asked binary, at binary, q_dims binary, q binary"))
    first = blocks.agg(F.min("block")).first()[0]

    def meet(some: DataFrame, packed: DataFrame) -> DataFrame:
        """Every packet with every block of ``some``: blocks are dealt to groups of about ``TOGETHER``, and a packet is sent once to a group."""
        groups = max(1, -(-some.count() // TOGETHER))
        meets = some.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return meets.unionByName(sent, allowMissingColumns=True).groupBy("group", "part").applyInPandas(searched, "query_id long, vec_id long, score long")

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        packet = rows[rows.q.notna()]
        if len(packet):
            p = packet.iloc[0]
            dim = np.frombuffer(p.q_dims, np.int32)
            floor = np.frombuffer(p.floors, np.float64) if "floors" in rows.columns and p.floors is not None else None
            q = Queries(np.frombuffer(p.asked, np.int64), np.frombuffer(p["at"], np.int32), dim, _wide(p.q, len(dim)), floor)
            for _, block in rows[rows.q.isna()].iterrows():
                row, vec, score = search(q, block, k)
                out.append(pd.DataFrame({"query_id": q.ids[row], "vec_id": vec, "score": score}))
        return pd.concat(out)

    def bounds(rows: pd.DataFrame) -> pd.DataFrame:
        """One packet of queries with its floors: the k-th best score of each so far, less what rounding may hide."""
        scored, one = rows[rows.q.isna()], rows[rows.q.notna()].iloc[0]
        known = dict(zip(scored.query_id, scored.kth, strict=True))
        floors = np.array([float(known.get(i, -np.inf)) for i in np.frombuffer(one.asked, np.int64)])
        floors -= np.abs(np.where(np.isfinite(floors), floors, 0)) * 2 * _EPS
        return pd.DataFrame([(int(one.part), one.asked, one["at"], one.q_dims, one.q, floors.tobytes())], columns=["part", "asked", "at", "q_dims", "q", "floors"])

    found = written(meet(blocks.where(F.col("block") == F.lit(first)), packed))
    kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    kth = kth.select("query_id", "kth", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
    none = F.lit(0).cast("long")
    bounded = packed.withColumns({"query_id": none, "kth": none}).unionByName(kth, allowMissingColumns=True).groupBy("part").applyInPandas(bounds, "part int, asked binary, at binary, q_dims binary, q binary, floors binary")
    bounded = written(bounded)
    both = found.unionByName(meet(blocks.where(F.col("block") != F.lit(first)), bounded))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", "rank", "vec_id", "score"))
    for table in (blocks, asked, packed, found, bounded):
        discard(table)
    return out


#: The rows of op1_exact_top_k in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
