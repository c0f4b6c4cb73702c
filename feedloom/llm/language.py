"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine.

Features are hashed byte 1-, 2- and 3-grams of the lower-cased text with all ASCII other than
letters as space. Document frequencies come from all learnable documents; the centroids of each
language from spherical k-means over a bounded sample, one language per task. A text is nearest to
the centroid of the highest cosine; below the language's floor for texts of its length it is rejected
as too distant. Short texts are far from any centroid, so floors are learned from pieces of every length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, crc_remainder

BITS = 13
#: Texts of each language from which centroids are clustered (first by a hash), and clusters.
PER_LANGUAGE, CLUSTERS = 400, 4
#: Floors are learned for pieces of so many characters, and for whole texts.
LENGTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256)
_LUT = np.full(256, 32, np.uint8)
_LUT[97:123] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)
_PIECE = 1 << 20


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed n-grams of one text (2**bits)."""
    data = _LUT[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, len(data), _PIECE):
        b = data[max(0, at - 2) : at + _PIECE].astype(np.uint32)
        skip = min(2, at)
        letter = b != 32
        two = b[:-1] * np.uint32(256) + b[1:]
        grams = (
            b[skip:][letter[skip:]] + np.uint32(1 << 25),
            two[max(0, skip - 1) :][(letter[:-1] | letter[1:])[max(0, skip - 1) :]] + np.uint32(1 << 26),
            (two[:-1] * np.uint32(256) + b[2:])[letter[:-2] | letter[1:-1] | letter[2:]],
        )
        for g in grams:
            out += np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.stack([counts(t, int(np.log2(len(idf)))) for t in texts]).astype(np.float32)
    x = np.log1p(x, out=x) * idf.astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k unit centroids of unit rows, started from rows far from each other."""
    chosen = [x.mean(axis=0)]
    nearest = x @ (chosen[0] / max(np.linalg.norm(chosen[0]), 1e-12))
    starts = []
    for _ in range(min(k, len(x))):
        i = int(nearest.argmin())
        starts.append(x[i])
        nearest = np.maximum(nearest, x @ x[i])
    c = np.stack(starts)
    for _ in range(rounds):
        owner = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (owner == i).any():
                c[i] = x[owner == i].mean(axis=0)
                c[i] /= max(np.linalg.norm(c[i]), 1e-12)
    return c


@dataclass
class LanguageModel:
    """Inverse document frequencies, unit centroids by row, and each row's language and floors by length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: list[list[float]]


def train(docs: DataFrame, held: int = 2, of: int = 4, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, bits: int = BITS) -> LanguageModel:
    """Learn from the text and non-null lang of documents whose crc32(doc_id as text) modulo ``of`` is not ``held``.

    Document frequencies count all of them; centroids take ``per_language`` different texts of each
    language. A language's floor is a quarter of the first percentile of its sample's cosines; for pieces of
    these texts of few characters half of the lowest 500th. Texts that are null or hold no letter
    are not learned from. What reaches the driver is bounded by the number of languages: the sums
    and ``clusters`` centroids of each. Only rows that may be in the sample are shuffled with their texts.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and doc_id is not null").where(crc_remainder("doc_id", of) != held).where(F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for t in batch.text:
                total += counts(t, bits) > 0
            n += len(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": np.append(at, -1), "df": np.append(total[at], n)})

    sums = {r["at"]: r["df"] for r in bounded_batches(known.select("text")).mapInPandas(frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()}
    n = sums.pop(-1, 0) or 0
    df = np.zeros(1 << bits)
    for at, v in sums.items():
        df[at] = v
    idf = np.log((n + 1) / (df + 1)) + 0.1
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 40))
    rows = known.withColumn("place", place)
    distinct = rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n"))
    near = rows.join(F.broadcast(distinct), "lang").where(F.col("place") < (8 * per_language + 200) / F.col("n") * float(1 << 40))
    near = near.groupBy("lang", "place").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    order = Window.partitionBy("lang").orderBy("place")
    chosen = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).select("lang", "r.doc_id", "r.text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        x = _vectors(list(rows.text), idf)
        c = spherical_k_means(x, clusters)
        nearest = lambda x: (x @ c.T).max(axis=1)
        rng, floors = np.random.default_rng(9), []
        for size in LENGTHS:
            pieces = [t[at : at + size] for t in rows.text for at in rng.integers(0, max(1, len(t) - size + 1), 2)]
            pieces = [p for p in pieces if any(ch.isalpha() for ch in p)]
            floors.append(0.5 * float(np.quantile(nearest(_vectors(pieces, idf)), 0.002)) if pieces else 0.0)
        floors.append(0.25 * float(np.quantile(nearest(x), 0.01)))
        floors = np.minimum.accumulate(floors[::-1])[::-1].tolist()
        return pd.DataFrame({"lang": rows.lang.iloc[0], "vector": [v.astype(np.float32).tobytes() for v in c], "floors": [floors] * len(c)})

    found = chosen.groupBy("lang").applyInPandas(fit, "lang string, vector binary, floors array<double>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["vector"]))
    centroids = np.stack([np.frombuffer(r["vector"], np.float32) for r in found]) if found else np.zeros((0, 1 << bits), np.float32)
    return LanguageModel(idf, centroids, [r["lang"] for r in found], [list(r["floors"]) for r in found])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score (cosine, 0 to 1) and rejected to ``docs``.

    lang_pred is the nearest learned language; ``und`` with score 0 where the text is null or holds
    no letter, or nothing was learned. rejected: ``und``, or a cosine below the language's floor for texts of this length.
    Only the whole text is read. Ties go to the first language in code-point order. Columns of
    these names are replaced, others and repeated rows stay. Empty table: no rows.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    idf, centroids, languages, floors = model.idf, model.centroids, model.languages, model.floors

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(texts), 256):
            some = list(texts.iloc[at : at + 256])
            live = [i for i, t in enumerate(some) if t is not None and languages]
            rows = [("und", 0.0, True)] * len(some)
            if live:
                cosine = _vectors([some[i] for i in live], idf) @ centroids.T
                for i, c in zip(live, cosine, strict=True):
                    k = int(c.argmax())
                    rows[i] = (languages[k], float(min(1.0, max(0.0, c[k]))), bool(c[k] < floors[k][np.searchsorted(LENGTHS, len(some[i].strip()))]))
            out += rows
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    lettered = F.when(text.rlike(r"\p{L}"), text)
    found = bounded_batches(docs).withColumn("_found", nearest(lettered))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_found")
