"""Embedding whitening by QDWH spectral divide-and-conquer.

Sums and centred second moments of all vectors are added up on the executors. The covariance, one
matrix of dims x dims, is taken apart on the driver: the polar factor U of the shifted covariance
(QDWH: dynamically weighted Halley iterations, each a QR factorisation) gives the spectral projector (U + I) / 2
onto the subspace of all eigenvalues above the shift. An orthonormal basis of it and of its
complement turns the covariance into two blocks, which are split again until a block is one component or a
multiple of the identity. The whitening matrix is broadcast (dims x components), and one pass over the
vectors projects them; another has measured the covariance of what comes out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
_EPS = np.finfo(np.float64).eps
#: A scaled entry beyond this counts as this, so that sums stay within 63 bits.
FARTHEST = float(1 << 40)
#: Output rows a batch at most.
ROWS_OUT = 100_000


def polar(a: np.ndarray, most: int = 12) -> np.ndarray:
    """The symmetric polar factor (matrix sign) of a symmetric matrix by QDWH iterations."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x, low = a / norm, _EPS / 4
    for _ in range(most):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * math.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))[0]
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if 1 - low < 10 * _EPS and moved < 1e-5:  # the iteration is of third order
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None where all lies on one side or the split is unclean."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < n:
        return None
    order = np.argsort(-np.diag(projector), kind="stable")
    basis = np.linalg.qr(projector[:, order])[0]
    basis = np.linalg.qr(np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]]))[0]  # subspace iteration
    above, below = basis[:, :rank], basis[:, rank:]
    clean = np.linalg.norm(above.T @ a @ below) <= 100 * n * _EPS * np.linalg.norm(a)
    return (above, below) if clean else None


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer."""
    n = len(v)
    values, vectors = np.zeros(n), np.zeros((n, n))
    whole, done = np.linalg.norm(v), 0
    left = [(np.eye(n), (v + v.T) / 2)]
    while left:
        basis, a = left.pop()
        k = len(a)
        mean = np.trace(a) / k
        parts = None
        if k > 1 and np.linalg.norm(a - mean * np.eye(k)) > 4 * _EPS * whole:
            diagonal = np.sort(np.diag(a))
            # the median balances the halves; the mean always has eigenvalues on both sides; the others step off an eigenvalue
            gap = math.sqrt(np.linalg.norm(a - mean * np.eye(k)) ** 2 / k)
            for shift in (float(np.median(diagonal)), mean, *(mean + gap * f for f in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.01, -0.01))):
                parts = _halves(a, shift)
                if parts:
                    break
        if parts is None:  # one component, or a multiple of the identity up to rounding
            # what is left of rounding in a block that no shift splits is below the precision of its eigenvalues
            values[done : done + k] = np.diag(a)
            vectors[:, done : done + k] = basis
            done += k
            continue
        for part in parts[::-1]:
            block = part.T @ a @ part
            left.append((basis @ part, (block + block.T) / 2))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def remaining(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(vec_id as text, x, dims): whole numbers floor(scale * c) + shift of every vector without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    whole = lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-FARTHEST)), F.lit(FARTHEST))).cast("long")
    return rows.select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.transform(v, lambda c: whole(c) + shift).alias("x"), F.size("embedding").alias("dims"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, np.int64) for r in rows])


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors, their number and exact sums by dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, some in batch.groupby("dims").x:
                m = _matrix(some)
                n, s = held.get(d, (0, 0))
                held[d] = n + len(m), s + m.sum(axis=0)
        for d, (n, s) in held.items():
            yield pd.DataFrame({"dims": d, "i": range(d), "n": n, "s": s})

    found = bounded_batches(rows.where("dims > 0").select("x", "dims")).mapInPandas(run, "dims int, i int, n long, s long").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    return {int(d): (int(some.n.iloc[0]), some.sort_values("i").s.to_numpy(np.int64)) for d, some in found.groupby("dims")}


def _moments(rows: DataFrame, project: Callable[[int, np.ndarray], np.ndarray], widths: dict[int, int], counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length of vectors, the mean outer product of ``project`` (dims, matrix) of all its vectors, ``widths`` numbers each.

    Tasks' sums are added row by row of the matrix, first within groups of tasks and then over those.
    """
    slots = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        slot = TaskContext.get().partitionId() % slots
        for batch in batches:
            for d, some in batch.groupby("dims").x:
                y = project(d, _matrix(some))
                held[d] = held.get(d, 0) + y.T @ y
        for d, m in held.items():
            yield pd.DataFrame({"dims": d, "i": range(len(m)), "slot": slot, "s": [r.tobytes() for r in m]})

    def add(some: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in some.s], axis=0)
        return pd.DataFrame({"dims": some.dims[:1], "i": some.i[:1], "slot": some.slot[:1], "s": [total.tobytes()]})

    schema = "dims int, i int, slot int, s binary"
    sums = bounded_batches(rows.where("dims > 0").select("x", "dims")).mapInPandas(run, schema).groupBy("dims", "i", "slot").applyInPandas(add, schema).groupBy("dims", "i").applyInPandas(add, schema).toPandas()
    out = {d: np.zeros((w, w)) for d, w in widths.items()}
    for d, i, s in zip(sums.dims, sums.i, sums.s, strict=True):
        out[d][i] = np.frombuffer(s)
    return {d: (m + m.T) / 2 / counts[d] for d, m in out.items()}


def deviation(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n * x - s) squared of each row, exactly; None beyond 63 bits."""
    y = n * x.astype(object) - s.astype(object) if n * max(1, int(np.abs(x).max(initial=0))) >= 1 << 62 else n * x - s
    most = max(1, int(np.abs(y).max(initial=0)))
    if most * most * max(1, y.shape[1]) < 1 << 63:
        y = y.astype(np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    exact = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Whitened leading components of all vectors (vec_id, embedding), fitted on all of them.

    Each entry c counts as x = floor(scale * c) + shift. Returns for each vector and each of its first
    ``components`` components (by falling eigenvalue e of the covariance, divisor n): vec_id, component (from
    1), n (vectors fitted), deviation (sum over dimensions of (n * x - S) squared, exact), whitened (x - S / n on the component over
    the root of e), explained (e over the trace), identity_error (the largest entry of the measured covariance of
    all whitened vectors minus the identity).

    Vectors that are null or hold null or non-finite entries are left out. Vectors of each length are fitted and
    numbered by themselves; an empty vector has no component. Null vec_id and repeated rows: each row takes part and
    is returned. A component whose eigenvalue is nothing but rounding (fewer different vectors than dimensions) has whitened null and
    takes no part in identity_error; without any other, identity_error is null, and so is explained where the trace is 0. A
    deviation beyond 63 bits is null. Entries beyond 2**40 after scaling count as that. Other columns are ignored. Empty table: no rows.
    The driver holds one covariance (8 * dims * dims bytes) for each length of vectors.
    """
    rows = remaining(vectors, scale, shift)
    sums = _sums(rows)
    counts = {d: n for d, (n, _) in sums.items()}
    mean = {d: s / n for d, (n, s) in sums.items()}
    covariance = _moments(rows, lambda d, x: x - mean[d], {d: d for d in sums}, counts)
    model = {}
    for d, v in covariance.items():
        e, q = spectrum(v)
        e, q = e[:components], q[:, :components]
        real = e > d * _EPS * max(e[0], 0) * 4
        model[d] = e, np.trace(v), real, q / np.sqrt(np.where(real, e, 1))
    bound = vectors.sparkSession.sparkContext.broadcast({d: (mean[d], w) for d, (_, _, _, w) in model.items()})

    def projected(d: int, x: np.ndarray) -> np.ndarray:
        centre, w = bound.value[d]
        return (x - centre) @ w

    error = {}
    for d, m in _moments(rows, projected, {d: m[3].shape[1] for d, m in model.items()}, counts).items():
        real = model[d][2]
        m = (m - np.eye(len(m)))[np.ix_(real, real)]
        error[d] = float(np.abs(m).max()) if m.size else None
    facts = {d: (counts[d], sums[d][1], real, e / trace if trace > 0 else None, error[d]) for d, (e, trace, real, _) in model.items()}
    facts = vectors.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, some in batch.groupby("dims"):
                n, s, real, explained, wrong = facts.value[d]
                k = len(real)
                for at in range(0, len(some), max(1, ROWS_OUT // k)):
                    part = some.iloc[at : at + max(1, ROWS_OUT // k)]
                    x = _matrix(part.x)
                    yield pd.DataFrame(
                        {
                            "vec_id": part.vec_id.repeat(k).array,
                            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                            "n": n,
                            "deviation": pd.array(deviation(x, n, s), "Int64").repeat(k),
                            "whitened": pd.array(np.where(real, projected(d, x), np.nan).ravel(), "Float64"),
                            "explained": None if explained is None else np.tile(explained, len(part)),
                            "identity_error": wrong,
                        }
                    )

    schema = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = bounded_batches(rows.where("dims > 0")).mapInPandas(run, schema)
    return out.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("whitened", F.when(~F.isnan("whitened"), F.col("whitened")))
