"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are hashed unigrams and bigrams of its words, of the words' shapes (capitals,
last byte, length) and of equality with the word before. A feature that occurs c times among n has
the value sqrt(c / n), so every text has length 1. Training is one pass after another over a bounded,
hash-ordered sample of labelled texts; scoring is a sparse dot product in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, crc_remainder, discard, mix, text_chunks, written

BITS = 16
#: At most so many labelled texts are fitted, with at most so many features in all: those first in the order of a hash of their id.
MAX_LABELLED, MAX_FEATURES = 4000, 8_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def hashed_features(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """The feature indices of each text, one per occurrence."""
    words = Words(texts, lower=True)
    raw = Words.__new__(Words)
    raw.data = np.frombuffer(b" ".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b" ", np.uint8)
    start, end = words.start, words.end
    upper = np.concatenate([[0], np.cumsum((raw.data >= 65) & (raw.data <= 90))])
    length = end - start
    capitals = upper[end] - upper[start]
    if len(start):
        last, first = raw.data[end - 1].astype(np.uint64), (raw.data[start] >= 65) & (raw.data[start] <= 90)
        same = np.concatenate([[False], words.hash[1:] == words.hash[:-1]])
        same[words.first[:-1][words.first[:-1] < len(start)]] = False
    else:
        last, first, same = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    case = np.where(2 * capitals > length, 2, first.astype(np.int64)).astype(np.uint64)
    closing = np.where((last >= 128) | (last >= 97) & (last <= 122), np.uint64(0), last)
    shape = mix(case * np.uint64(1 << 16) + closing * np.uint64(256) + np.minimum(length, 24).astype(np.uint64) // np.uint64(6) + np.uint64(1))
    repeat = mix(same.astype(np.uint64) + np.uint64(77))
    word = words.hash
    pair = lambda x, y, salt: mix(x[:-1] * _K + y[1:] * np.uint64(3) + np.uint64(salt))
    columns = [word, shape, repeat]
    two = [pair(word, word, 11), pair(shape, shape, 12)] if len(word) else []
    shift = np.uint64(64 - bits)
    one, two = [(c >> shift).astype(np.int32) for c in columns], [(c >> shift).astype(np.int32) for c in two]
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        out.append(np.concatenate([c[a:b] for c in one] + [c[a : b - 1] for c in two]) if b > a else np.zeros(0, np.int32))
    return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0) -> np.ndarray:
    """Weights of 2**bits features and, last, the bias, by per-coordinate FTRL-proximal updates."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for at, value, label in examples:
            at, value = np.append(at, 1 << bits), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange((1 << bits) + 1))


def train(docs: DataFrame, labels: DataFrame, held: int = 1, of: int = 3, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, bits: int = BITS) -> np.ndarray:
    """Fit on labelled documents whose crc32(doc_id as text) modulo ``of`` is not ``held``.

    Those that come first in the order of a hash of doc_id are used, at most ``max_labelled`` whole texts with
    together at most ``max_features`` distinct features a text (8 bytes each; the first text always counts), so the fit needs bounded memory
    on the driver. Rows of other or null labels are not used. Repeated rows count each. Without rows
    all weights are 0 and every score 0.5.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc_remainder("doc_id", of) != held)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id", "quality").limit(max_labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(zip(batch.doc_id, batch.quality, strict=True))
            for ids, texts in text_chunks(rows, list(batch.text)):
                for (doc, label), f in zip(ids, hashed_features(texts, bits), strict=True):
                    at, count = np.unique(f, return_counts=True)
                    value = np.sqrt(count / max(1, len(f))).astype(np.float32)
                    yield pd.DataFrame([(doc, label, at.tobytes(), value.tobytes())], columns=["doc_id", "quality", "at", "value"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    order = F.struct(F.xxhash64(F.lit(17), "doc_id").alias("h"), "doc_id", "quality", F.xxhash64("at", "value").alias("x"))
    rows = written(bounded_batches(joined).mapInPandas(run, "doc_id long, quality int, at binary, value binary").withColumn("place", order))
    sizes = rows.select("place", (F.octet_length("at") / 4).cast("long").alias("n")).orderBy("place").limit(max_labelled).collect()
    fits = int((np.cumsum([r["n"] for r in sizes]) <= max_features).sum())
    if not sizes:
        return ftrl([], bits)
    last = sizes[max(fits, 1) - 1]["place"]
    end = F.struct(*[F.lit(last[c]).cast(rows.schema["place"].dataType[c].dataType).alias(c) for c in ("h", "doc_id", "quality", "x")])
    found = sorted(rows.where(F.col("place") <= end).orderBy("place").limit(max(fits, 1)).collect(), key=lambda r: tuple(r["place"]))
    discard(rows)
    return ftrl([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), r["quality"]) for r in found], bits)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(score, predicted) added to ``docs``: the probability of label 1, and 1 where it is at least 0.5.

    Only the text is read: whole, of any length. Null, empty or wordless text scores by the bias
    alone. Columns named score or predicted are replaced; other columns, repeated rows and rows of
    null doc_id stay as they are. Empty table: no rows.
    """
    docs = docs.drop("score", "predicted")
    w, bits = weights[:-1].astype(np.float64), int(np.log2(len(weights) - 1))
    bias = float(weights[-1])

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for _, chunk in text_chunks(list(texts), list(texts)):
            for f in hashed_features(chunk, bits):
                if not len(f):
                    out.append(bias)
                    continue
                count = np.bincount(f, minlength=1)[f]
                out.append(bias + float((w[f] / np.sqrt(count)).sum()) / np.sqrt(len(f)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35))))

    scored = bounded_batches(docs).withColumn("score", score(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
