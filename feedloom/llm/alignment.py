"""Alignment of two tokenizers' tokens over the same bytes.

A text is cut into units where neither tokenizer can join what lies on both sides: before a single
space that stands between other characters. A unit's tokens, its groups and its links do not depend on the
rest of the text, so each worker remembers those of the units it met lately. The new units of a batch
are encoded by both tokenizers and aligned by ``pandas.merge_asof``, keyed by document: each
token's start finds the token of the other side that covers it. Both directions together give all overlaps;
offsets where tokens of both sides end close the groups.

Counts of linked id pairs are summed over the whole corpus, by chunk of documents, then by pair. While the
distinct pairs are at most ``BROADCAST_PAIRS`` they are broadcast as sorted arrays; beyond that, each chunk's
distinct pairs are joined with them and meet the chunk's documents by its number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, join_by_key, small, text_chunks, written

#: Distinct pairs (12 bytes each in a worker) that are broadcast at most.
BROADCAST_PAIRS = 4_000_000
#: Units that a worker remembers in each of two generations (about 400 bytes each).
UNIT_MEMORY = 150_000
#: Distinct pairs of documents that a chunk holds at most, about.
CHUNK_PAIRS = 2_000_000
#: What splits text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S)(?= \S)")
_REGULAR = re.compile(r" \S(?:.*\S)?\Z", re.S)
_SPACE = "▁"


class ByteLevel:
    """The byte-level vocabulary of a tokenizers file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ids = [vocabulary[m] for m in merged]
        if ids == sorted(ids) and len(set(ids)) == len(ids):  # merges by rank are merges by id
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocabulary.values()}
            self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda texts: model.encode(texts, num_threads=1)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        #: Whether no piece runs on over the beginning of a word, so that words are encoded alike alone and in a text.
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in names)


class Aligner:
    """Tokens of A and B of texts, as groups and links; units are remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size = np.array([len(x) for x in self.a.bytes])
        self.b_size = np.array([len(x) for x in self.b.bytes])
        decimals = lambda n: np.array([f"{i}{end}".encode() for i in range(n) for end in ",|;"], object)
        self.names = decimals(max(len(self.a_size), len(self.b_size)))
        self.name_size = np.array([len(x) for x in self.names])
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.b.by_word else [" " + text]

    def _encoded(self, units: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of A and B of each unit; those of A of ordinary units from one text of them all."""
        a: list = [None] * len(units)
        plain = [i for i, u in enumerate(units) if _REGULAR.match(u)] if self.b.by_word else []
        if plain:
            ids = np.array(self.a.encode("".join([units[i] for i in plain])), np.int64)
            ends = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum([len(units[i].encode()) for i in plain]), "left") + 1
            for i, some in zip(plain, np.split(ids, ends[:-1]), strict=True):
                a[i] = some
        for i, u in enumerate(units):
            if a[i] is None:
                a[i] = np.array(self.a.encode(u), np.int64)
        return a, self.b.encode([u[1:] for u in units])

    def _kept(self, size: np.ndarray, table: list[bytes], ids: list, units: list[str]) -> list[bool]:
        """Whether the joined bytes of each unit's tokens are those of the unit."""
        if b"".join([table[i] for i in chain.from_iterable(ids)]) == "".join(units).encode():
            wanted = np.array([len(u.encode()) for u in units])
            counts = np.array([len(x) for x in ids])
            sums = np.concatenate([[0], np.cumsum(size[np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))])])
            ends = np.cumsum(counts)
            if np.array_equal(sums[ends] - sums[ends - counts], wanted):
                return [True] * len(units)
        return [b"".join([table[i] for i in x]) == u.encode() for x, u in zip(ids, units, strict=True)]

    def aligned(self, units: list[str], doc: list[int]) -> list[tuple[int, bytes, bytes] | None]:
        """For each unit (of document ``doc``): tokens of A, links as 64-bit pairs, groups as text with a last semicolon; None where bytes differ."""
        a, b = self._encoded(units)
        ok = [x and y for x, y in zip(self._kept(self.a_size, self.a.bytes, a, units), self._kept(self.b_size, self.b.bytes, b, units), strict=True)]
        good = [i for i, x in enumerate(ok) if x]
        out: list = [None] * len(units)
        if not good:
            return out
        side = []
        for ids, size in (([a[i] for i in good], self.a_size), ([b[i] for i in good], self.b_size)):
            counts = np.array([len(x) for x in ids])
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            end = np.cumsum(size[flat])
            side.append(pd.DataFrame({"at": end - size[flat], "end": end, "id": flat, "unit": np.repeat(np.arange(len(good)), counts), "doc": np.repeat(np.array([doc[i] for i in good]), counts)}))
        x, y = side
        cover_x = pd.merge_asof(x[["at", "doc", "id", "unit"]], y[["at", "doc", "id"]], on="at", by="doc", suffixes=("", "_other"))
        cover_y = pd.merge_asof(y[["at", "doc", "id", "unit"]], x[["at", "doc", "id"]].assign(start=x["at"]), on="at", by="doc", suffixes=("", "_other"))
        more = cover_y[cover_y["start"] != cover_y["at"]]  # equal starts are found by the other direction
        unit = np.concatenate([cover_x.unit, more.unit])
        order = np.argsort(unit, kind="stable")
        many = len(self.b_size)
        links = np.concatenate([cover_x.id * many + cover_x.id_other, more.id_other * many + more.id])[order].astype(np.int64)
        link_ends = np.searchsorted(unit[order], np.arange(len(good)), "right") * 8

        both = np.intersect1d(x.end, y.end, assume_unique=True)
        group = np.concatenate([np.searchsorted(both, x.end), np.searchsorted(both, y.end)])
        closes = np.concatenate([np.isin(x.end, both), np.isin(y.end, both)])
        code = np.concatenate([x.id, y.id]) * 3 + closes * np.repeat([1, 2], [len(x), len(y)])
        order = np.argsort(group, kind="stable")
        code, of = code[order], np.concatenate([x.unit, y.unit])[order]
        text = b"".join(self.names[code].tolist())
        text_ends = np.cumsum(self.name_size[code])[np.searchsorted(of, np.arange(len(good)), "right") - 1]
        blob = links.tobytes()
        a_counts = np.bincount(x.unit, minlength=len(good))
        for k, i in enumerate(good):
            out[i] = int(a_counts[k]), blob[link_ends[k - 1] if k else 0 : link_ends[k]], text[text_ends[k - 1] if k else 0 : text_ends[k]]
        return out

    def batch(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The aligned units of each text; None for a text without tokens."""
        units = [self.units(t) if t else [] for t in texts]
        for d, some in enumerate(units):
            if len(some) > UNIT_MEMORY // 4:  # a very long text: its units are remembered for itself, not for others
                self._learn([u for u in dict.fromkeys(some) if u not in self.new and u not in self.old], d)
        fresh: dict[str, int] = {}
        for d, some in enumerate(units):
            for u in some:
                if u not in self.new:
                    if u in self.old:
                        self.new[u] = self.old[u]
                    elif u not in fresh:
                        fresh[u] = d
        if fresh:
            self.new.update(zip(fresh, self.aligned(list(fresh), list(fresh.values())), strict=True))
        out = [[self.new[u] for u in some] if some else None for some in units]
        for d, some in enumerate(out):
            if some and None in some:  # a unit whose bytes change: ask for the whole text
                whole = self.aligned([" " + texts[d]], [d])[0]
                out[d] = None if whole is None else [whole]
        if len(self.new) >= UNIT_MEMORY:
            self.old, self.new = self.new if len(self.new) < 3 * UNIT_MEMORY else {}, {}
        return out

    def _learn(self, units: list[str], doc: int) -> None:
        for at in range(0, len(units), UNIT_MEMORY // 4):
            some = units[at : at + UNIT_MEMORY // 4]
            self.new.update(zip(some, self.aligned(some, [doc] * len(some)), strict=True))


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_DOC = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of times of each."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document with its figures, distinct linked pairs (64-bit) and how often (32-bit) it links each, and one per chunk with the sums of its documents in all_pairs and all_times."""
    names = [c.split()[0] for c in _DOC.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_path, b_path)
        chunk, keys, times, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for ids, texts in text_chunks(list(batch.doc_id), list(batch.text)):
                rows = []
                for doc, units in zip(ids, tool.batch(texts), strict=True):
                    if units is None:
                        rows.append((chunk, doc, 0, 0, 0, 0, "", b"", b""))
                        continue
                    links = np.frombuffer(b"".join([u[1] for u in units]), np.int64)
                    groups = b"".join([u[2] for u in units])
                    n_a, n_groups = sum([u[0] for u in units]), groups.count(b"|")
                    pair, n = np.unique(links, return_counts=True)
                    keys.append(pair)
                    times.append(n)
                    held += len(pair)
                    # each group starts with one overlap, each further token of either side adds one
                    rows.append((chunk, doc, n_a, len(links) + n_groups - n_a, n_groups, len(links), hashlib.sha256(groups[:-1]).hexdigest(), pair.tobytes(), n.astype(np.uint32).tobytes()))
                yield pd.DataFrame(rows, columns=names)
                if held > CHUNK_PAIRS:
                    keys, times = ([x] for x in _summed(keys, times))
                    held = len(keys[0])
                    if held > CHUNK_PAIRS // 2:
                        yield pd.DataFrame([(chunk, keys[0].tobytes(), times[0].tobytes())], columns=["chunk", "all_pairs", "all_times"])
                        chunk, keys, times, held = chunk + 1, [], [], 0
        if keys:
            key, n = _summed(keys, times)
            yield pd.DataFrame([(chunk, key.tobytes(), n.tobytes())], columns=["chunk", "all_pairs", "all_times"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, "all_pairs", "all_times"]
        for part in run(batches):
            part = part.reindex(columns=columns)
            yield part.astype({c: "Int64" for c in ("n_a", "n_b", "n_groups", "n_links")}).astype({c: object for c in ("doc_id", "groups_sha256", "pairs", "times", "all_pairs", "all_times")}).where(part.notna(), None)

    return bounded_batches(docs).mapInPandas(whole, _DOC + ", all_pairs binary, all_times binary")


def _exploded(chunks: DataFrame) -> DataFrame:
    """(chunk, pair, n) of each chunk's distinct pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, pairs, n in zip(batch.chunk, batch.all_pairs, batch.all_times, strict=True):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
                for at in range(0, len(pairs), 1 << 18):
                    yield pd.DataFrame({"chunk": chunk, "pair": pairs[at : at + (1 << 18)], "n": n[at : at + (1 << 18)]})

    return bounded_batches(chunks).mapInPandas(run, "chunk long, pair long, n long")


def _rated(batch: pd.DataFrame, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    """Adds n_best and count_sum to documents, given all their pairs, sorted, with count and whether it is the best of its id of B."""
    pairs = np.frombuffer(b"".join(batch.pairs), np.int64)
    times = np.frombuffer(b"".join(batch.times), np.uint32).astype(np.int64)
    ends = np.cumsum([len(p) // 8 for p in batch.pairs])
    at = np.searchsorted(pair, pairs)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
    return batch.drop(columns=["pairs", "times"]).assign(n_best=total(times * best[at]), count_sum=total(times * count[at]))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment of the tokens of space + text by a byte-level vocabulary (A) with those of text by a sentencepiece model (B).

    Returns one row per row of ``docs`` (doc_id, text): doc_id; n_a, n_b (tokens); n_groups (runs between offsets where tokens
    of both sides end); n_links (pairs of tokens whose bytes overlap); n_best (links whose id pair is linked as often in the
    whole corpus as any with that id of B); count_sum (corpus-wide count of the pair, over the links);
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, ids in decimal; empty without tokens).

    Null or empty text, and one whose tokens' joined bytes are not space + text (B changes or cannot write it): no tokens. Null
    doc_id and repeated rows: each row counts and is returned. Other columns are ignored. Empty table: no rows.
    """
    b_size = _b_size(b_path)
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # null ids would make floats of numbers in pandas
    table = written(aligned_documents(docs, a_path, b_path))
    in_chunks = _exploded(table.where("all_pairs is not null").select("chunk", "all_pairs", "all_times"))
    counts = written(in_chunks.groupBy("pair").agg(F.sum("n").alias("n")))
    highest = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))  # at most one row for each id of B
    rated = counts.join(F.broadcast(highest) if b_size <= BROADCAST_IDS else highest, F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    own = table.where("all_pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    schema = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    if small(counts, BROADCAST_PAIRS):
        known = rated.toPandas().sort_values("pair")
        held = docs.sparkSession.sparkContext.broadcast((known.pair.to_numpy(np.int64), known.n.to_numpy(np.int64), known.best.to_numpy(bool)))

        def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _rated(batch, *held.value)

        out = bounded_batches(own).mapInPandas(rate, schema)
    else:
        mine = join_by_key(in_chunks.select("chunk", "pair"), rated, "pair", "chunk", "inner", rows=BROADCAST_PAIRS + 1)

        def meet(batch: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values("pair")
            return _rated(batch, some.pair.to_numpy(np.int64), some.n.to_numpy(np.int64), some.best.to_numpy(bool))

        out = own.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(meet, schema)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _b_size(path: str) -> int:
    return len(_pieces(path).bytes)


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)
