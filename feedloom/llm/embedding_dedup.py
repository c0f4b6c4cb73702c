"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are projected on the leading ``AXES`` axes of all vectors of their length, whatever it is; lengths whose vectors
all fit in one tile need none. Equal vectors collapse
to one representative with a count. The leading two rotated coordinates of the unit vectors form
cells as wide as the largest distance of a linked pair, so links only join neighbouring cells; the
vectors of a cell are dealt to tiles of about ``TILE`` rows. A pair of tiles is one task's group:
leading dimensions are multiplied first, the rest is bounded by the product of suffix norms, and a
pair is left as soon as its cosine cannot reach the threshold; what lies outside the axes counts as a last
block of dimensions. Pairs that remain are decided by the
cosine of the original vectors in double precision. A task returns counts and a spanning edge for
each row, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, components, cut, join_by_key, written

#: Rows and numbers of a tile at most.
TILE, TILE_NUMBERS = 1536, 1 << 21
#: Leading axes that are found; up to so many dimensions from all second moments, beyond by so many block power iterations.
AXES, DIRECT_DIMS, ITERATIONS = 64, 256, 3
#: Leading dimensions after which a bound is taken.
STEPS = (8, 16, 32)
#: Bytes of vectors that are broadcast at most.
BROADCAST_BYTES = 32 << 20
_SURVIVORS = 1 << 16


def usable(column: str):
    """True where a vector has only finite components and is not zero."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _summed(vectors: DataFrame, held: dict[int, np.ndarray | None]) -> dict[int, np.ndarray]:
    """For each length of vectors in ``held``: the sum over all unit vectors x of x times (x' block), or of x x' where there is no block."""
    blocks = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, some in batch.groupby("dims").embedding:
                x, block = _unit(_matrix(some))[0], blocks.value[d]
                total[d] = total.get(d, 0) + x.T @ (x if block is None else x @ block)
        for d, t in total.items():
            yield pd.DataFrame({"dims": d, "i": range(d), "s": [row.tobytes() for row in t]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in rows.s], axis=0)
        return pd.DataFrame({"dims": rows.dims[:1], "i": rows.i[:1], "s": [total.tobytes()]})

    some = vectors.where(F.col("dims").isin(list(held))).select("dims", "embedding")
    rows = bounded_batches(some).mapInPandas(run, "dims int, i int, s binary").groupBy("dims", "i").applyInPandas(add, "dims int, i int, s binary").toPandas()
    return {int(d): np.stack([np.frombuffer(x) for x in some.sort_values("i").s]) for d, some in rows.groupby("dims")}


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal leading axes (dims x ``AXES`` at most), largest first, of all unit vectors of each length that has more than a tile of them.

    Short vectors: eigenvectors of their second moments. Long ones: block power iteration, each step a pass over
    the vectors that sums dims x ``AXES`` numbers. The driver holds those of each length.
    """
    found = vectors.groupBy("dims").count().where(F.col("count") > TILE).collect()
    lengths = sorted(r["dims"] for r in found)
    axes = {d: None for d in lengths if d <= DIRECT_DIMS}
    if axes:
        for d, m in _summed(vectors, axes).items():
            axes[d] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :AXES])
    long_ones = {d: np.linalg.qr(np.random.default_rng(d).normal(size=(d, AXES + 8)))[0] for d in lengths if d > DIRECT_DIMS}
    for _ in range(ITERATIONS if long_ones else 0):
        long_ones = {d: np.linalg.qr(y)[0] for d, y in _summed(vectors, long_ones).items()}
    if long_ones:  # of the block's own directions, those with the largest moments first
        for d, y in _summed(vectors, long_ones).items():
            small = long_ones[d].T @ y
            axes[d] = np.ascontiguousarray((long_ones[d] @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1])[:, :AXES])
    return axes


def _matrix(rows: pd.Series) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.stack([np.asarray(r, np.float64) for r in rows])


def _leading(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """The coordinates of unit vectors on the leading axes of their length; the first ones as they are where there are none."""
    return unit @ axes[unit.shape[1]] if unit.shape[1] in axes else unit[:, :AXES]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and their lengths, scaled first so that squares neither overflow nor vanish."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / np.where(scale == 0, 1, scale)
    norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / np.where(norm == 0, 1, norm), norm


def _tile_links(a: np.ndarray, b: np.ndarray, axes: dict[int, np.ndarray], threshold: float, same: bool, full: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b whose cosine reaches the threshold; only i < j in one tile. ``full`` is given the number of pairs multiplied in full."""
    ua, ub = _unit(a)[0], _unit(b)[0]
    ra, rb = _leading(ua, axes), _leading(ub, axes)
    steps = [s for s in STEPS if s < ra.shape[1]] + [ra.shape[1]]
    suffix = lambda r: np.sqrt(np.maximum(1 - np.cumsum(r * r, axis=1), 0)) + 1e-9
    sa, sb = suffix(ra), suffix(rb)
    dot = ra[:, : steps[0]] @ rb[:, : steps[0]].T
    alive = dot + np.outer(sa[:, steps[0] - 1], sb[:, steps[0] - 1]) >= threshold - 1e-9
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    rows, cols = np.nonzero(alive)
    kept = []
    some = max(1, min(_SURVIVORS, 2 * TILE_NUMBERS // a.shape[1]))
    for at in range(0, len(rows), some):
        i, j = rows[at : at + some], cols[at : at + some]
        acc = dot[i, j]
        for low, high in zip(steps[:-1], steps[1:], strict=True):
            acc = acc + np.einsum("ij,ij->i", ra[i, low:high], rb[j, low:high])
            ok = acc + sa[i, high - 1] * sb[j, high - 1] >= threshold - 1e-9
            i, j, acc = i[ok], j[ok], acc[ok]
        if full is not None:
            full.append(len(i))
        ok = _cosine(a[i], b[j]) >= threshold
        kept.append((i[ok], j[ok]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])) if kept else (none, none)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True) if len(x) and (np.abs(x).max() > 1e100 or np.abs(x).max() < 1e-100) else x
    a, b = scale(a), scale(b)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _spanning(i: np.ndarray, j: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id in each row's component of the links of one tile pair."""
    la, lb = na.copy(), nb.copy()
    while True:
        before = la.sum(dtype=object), lb.sum(dtype=object)
        low = np.minimum(la[i], lb[j])
        np.minimum.at(la, i, low)
        np.minimum.at(lb, j, low)
        if (la.sum(dtype=object), lb.sum(dtype=object)) == before:
            return la, lb


def embedding_near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links of vectors (vec_id, embedding, label) of equal label whose cosine is at least ``threshold`` (above 0).

    Returns one row per vec_id: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable, itself included), kept (vec_id = component_id).

    Null label; null, empty or zero vectors; null or non-finite components: linked with nothing.
    Vectors of different length: not compared. A repeated vec_id is one vector: the smallest
    (label, embedding) of its rows. Rows with null vec_id are left out, as they can't be linked to.
    Other columns are ignored. Empty table: no rows.
    """
    one = rows.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
    one = one.agg(F.min(F.struct(F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))).alias("v")).select("vec_id", "v.label", "v.embedding")
    one = one.withColumn("ok", usable("embedding") & F.col("label").isNotNull())
    # equal numbers may be written in two ways
    plain = F.transform("embedding", lambda x: F.when(x == 0.0, F.lit(0.0)).otherwise(x))
    one = written(one.select("vec_id", "label", F.when(F.col("ok"), plain).alias("embedding"), F.size("embedding").alias("dims")))
    valid = one.where("embedding is not null")
    same = F.struct("label", "embedding")
    reps = written(valid.groupBy("label", "dims", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    bound = rows.sparkSession.sparkContext.broadcast(principal_axes(reps))
    width = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby("dims"):
                unit = _unit(_matrix(some.embedding))[0]
                near = bound.value.get(unit.shape[1])
                lead = np.floor((unit[:, :2] if near is None else unit @ near[:, :2]) / width).astype(np.int32)
                yield some.assign(c0=lead[:, 0], c1=lead[:, 1] if lead.shape[1] > 1 else 0)

    cell = ["label", "dims", "c0", "c1"]
    placed = written(bounded_batches(reps).mapInPandas(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema) + ", c0 int, c1 int"))
    rows_a_tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_NUMBERS) / F.col("dims"))))
    placed = placed.withColumn("cell", F.xxhash64(*cell))
    sizes = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(1 / rows_a_tile).alias("each")).select("cell", "n", F.ceil(F.col("n") * F.col("each") - 1e-9).cast("int").alias("tiles")))
    tile = join_by_key(placed, sizes.select("cell", "tiles"), "cell", "rep", counts=sizes.select("cell", "n")).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tile = written(tile.select("rep", "copies", "embedding", F.xxhash64(*cell, "tile").alias("id"), *cell, "tile"))
    names = cut(tile.select("id", *cell, "tile").distinct())
    around = F.explode(F.expr("transform(sequence(0, 8), k -> struct(c0 + k div 3 - 1 as n0, c1 + k % 3 - 1 as n1))"))
    near = names.select(F.col("id").alias("left"), "label", "dims", around.alias("n")).select("left", "label", "dims", F.col("n.n0").alias("c0"), F.col("n.n1").alias("c1"))
    pairs = near.join(names.select(F.col("id").alias("right"), *cell), cell).where("left <= right").select("left", "right")
    pairs = cut(pairs.distinct())
    sides = pairs.select("left", "right", F.col("left").alias("id"), F.lit(True).alias("first")).unionByName(
        pairs.where("left < right").select("left", "right", F.col("right").alias("id"), F.lit(False).alias("first"))
    )
    grouped = sides.join(tile.select("id", "rep", "copies", "embedding"), "id").groupBy("left", "right")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["first"]], rows[~rows["first"]]
        same = not len(b)
        b = a if same else b
        na, nb = a.rep.to_numpy(np.int64), b.rep.to_numpy(np.int64)
        i, j = _tile_links(_matrix(a.embedding), _matrix(b.embedding), bound.value, threshold, same)
        if not len(i):
            return pd.DataFrame({"rep": [], "links": [], "to": []}).astype("int64")
        ca, cb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        np.add.at(ca, i, b.copies.to_numpy(np.int64)[j])
        np.add.at(cb, j, a.copies.to_numpy(np.int64)[i])
        if same:
            i, j, ca, cb = np.concatenate([i, j]), np.concatenate([j, i]), ca + cb, cb * 0
        la, lb = _spanning(i, j, na, nb)
        out = pd.DataFrame({"rep": np.concatenate([na, nb]), "links": np.concatenate([ca, cb]), "to": np.concatenate([la, lb])})
        return out[out.links > 0]

    found = written(grouped.applyInPandas(compare, "rep long, links long, to long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("rep", "copies", same.alias("same")).join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    size = reps.agg(F.count(F.lit(1)), F.max("dims")).first()
    fits = size[0] if size[0] <= BROADCAST_ROWS and size[0] * 8 * (size[1] or 0) <= BROADCAST_BYTES else BROADCAST_ROWS + 1
    linked = join_by_key(valid.withColumn("same", same), known, "same", "vec_id", "left", rows=fits, counts=reps.select(same.alias("same"), F.col("copies").alias("n")))
    out = linked.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    out = out.unionByName(one.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The rows of op10_embedding_near_dedup in DuckDB.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
