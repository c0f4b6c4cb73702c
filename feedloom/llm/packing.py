"""Concatenate and cut: documents as token ids, end to end in one long row, cut into fixed windows.

Pass 1 makes the ids of every document and its offset within its partition, and keeps both as a
table. The totals of the partitions, one row each, give the partitions' global offsets by a
running sum. Pass 2 cuts each document at the window borders. No document moves between tasks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_by_key, text_chunks, written

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker remembers (about 150 bytes each); a full memory is emptied.
WORD_MEMORY = 500_000
_TAIL = b".,!?;:"


class WordIds(dict):
    """Ids of words by a tokenizer whose pieces never cross white space; remembers the words it has met.

    A word is what stands between ASCII white space. A word of printable code points below 256
    needs no composition, so its lower-cased pieces go straight to the tokenizer's model in the
    byte alphabet; any other word, and one that may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.other = regex.compile(r"[^\x21-\x7E\xA1-\xAC\xAE-\xFF]|<\|").search
        unprintable = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = {b: 256 + i for i, b in enumerate(unprintable)}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_TAIL)
        text = core.decode("utf-8", "replace")
        if text.isalpha() and (core.isascii() or not self.other(text)):
            ids = self._piece(text.lower()) if len(core) == len(word) else self[core] + self[word[len(core) :]]
        elif self.other(text := word.decode("utf-8", "replace")):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            pieces = self.pieces(text.lower())
            ids = self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self[p.encode()] for p in pieces])
        if len(self) >= WORD_MEMORY:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        text = text or ""
        try:
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, part, before, doc_tokens, ids): ids of each document and the tokens before it in its partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, before = word_ids(path).of, TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for ids, texts in text_chunks(list(batch.doc_id), list(batch.text), 1 << 20):
                blobs = [encode(t) + end for t in texts]
                sizes = np.array([len(b) // 4 for b in blobs], np.int64)
                narrow = [np.frombuffer(b, np.uint32).astype(np.uint16).tobytes() if max_16(b) else b for b in blobs]
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "part": part, "before": before + ends - sizes, "doc_tokens": sizes, "ids": narrow})
                before += int(ends[-1])

    return bounded_batches(docs).mapInPandas(run, "doc_id long, part int, before long, doc_tokens long, ids binary")


def max_16(blob: bytes) -> bool:
    """Whether all 32-bit ids fit in 16 bits, as they are kept then."""
    return int(np.frombuffer(blob, np.uint32).max(initial=0)) < 1 << 16


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text) in sequences of ``window`` tokens; only the last one is shorter.

    Returns one row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of
    the little-endian unsigned 32-bit ids), doc_tokens (the document's ids with ``end_id``),
    sequence_id, offset (place in the sequence, gapless from 0), and the ids themselves with ``with_ids``.

    Null or empty text: ``end_id`` alone. Very long texts: cut into as many pieces as they need.
    Null doc_id and repeated rows: packed like any others. Other columns are ignored. Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(tokenised(docs, tokenizer, end_id))
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    base = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    placed = join_by_key(ids, base, "part", "before").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for batch in batches:
            rows = []
            for doc, n, blob, at in zip(batch.doc_id.astype("Int64"), batch.doc_tokens, batch["ids"], batch["at"], strict=True):
                all_ids = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % window
                    length = min(n - start, window - offset)
                    piece = all_ids[start : start + length]
                    rows.append((doc, start, length, zlib.crc32(piece), n, (at + start) // window, offset, *[piece.tolist()] * with_ids))
                    start += length
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return bounded_batches(placed).mapInPandas(run, schema)
