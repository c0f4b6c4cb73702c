"""MinHash near-duplicate detection: SuperMinHash signatures, banding, verification, union-find grouping.

One pass turns each text into the distinct 64-bit hashes of its word shingles, a SuperMinHash
signature cut into band keys, and ``node``, a number for the whole set. Exact copies share a node,
so a group of copies of any size is one node from there on. Then links between nodes are found:

1. Every node is compared, on full sets, with the smallest of the smallest nodes of its buckets
   (nodes that share a band key): one comparison a node. The links give first components.
2. Buckets that still hold several components compare all pairs of different components, block
   against block, by parity bitmaps: bit x of a set's bitmap tells whether an odd number of its
   shingles fall on x. Two bitmaps differ in at most as many bits as the sets differ in shingles, so
   many different bits prove that a pair is not linked. Bitmaps are narrowed to few bits first and
   widened for pairs that are left. Of the pairs that are not ruled out, as many as would join all
   their components are confirmed on full sets.
3. Where one of those was not confirmed, its buckets compare the pairs that are left on full sets. So do
   all such buckets where their full sets are small in all.

With 32 bands of 4 a pair at the threshold of 0.8 shares no band with probability 5e-8, and less
above it. A bucket is split into blocks and dealt to tasks; only links leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Words, bounded_batches, components, cut, discard, join_by_key, mix, shingles, text_chunks, written

BANDS, ROWS = 32, 4
#: A block holds at most so many rows and bytes of sets or bitmaps, a task about so many bytes.
BLOCK, BLOCK_BYTES, TASK_BYTES = 4096, 16 << 20, 32 << 20
#: Where the full sets to be dealt to blocks have at most so many bytes in all, bitmaps need not come first.
DIRECT_BYTES = 64 << 20
#: Bits of the narrowest bitmap, and how many times a set's size its bitmap has at least.
NARROW, WIDE = 256, 4
_LOW40 = np.uint64((1 << 40) - 1)


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (one row of m values per set; infinite for an empty set).

    Round j gives each element the value j + r in slot j of its own pseudo-random permutation,
    shuffled lazily. A set is finished after the first round that leaves no slot above j + 1,
    because later rounds only give larger values.
    """
    sketch = np.full((len(sets), m), np.inf)
    if not sets:
        return sketch
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        target = (np.uint64(j) + (((draw >> np.uint64(40)) * np.uint64(m - j)) >> np.uint64(24))).astype(np.int16)
        slot = target.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == swaps[i]] = i
        np.minimum.at(sketch.reshape(-1), owner * m + slot, (draw & _LOW40) / float(1 << 40) + j)
        swaps.append(target)
        left = (sketch.max(axis=1) >= j + 1)[owner]
        if not left.all():
            element, owner, swaps = element[left], owner[left], [s[left] for s in swaps]
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band and set."""
    parts = mix(np.ascontiguousarray(sketch).view(np.uint64)).reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def set_numbers(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers of a whole sorted set."""
    sums = [mix(s + np.uint64(len(s))).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]
    node, check = mix(np.array(sums, np.uint64)).view(np.int64)
    return int(node), int(check)


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """Bit x tells whether an odd number of the set's hashes end in x; as 64-bit words, a power of two of them."""
    bits = NARROW
    while bits < WIDE * len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(texts: list, n: int) -> list[np.ndarray]:
    words = Words(texts)
    return [shingles(words.hash[a:b], n) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, node, check, bands) of (doc_id, text); the last three are null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, texts in text_chunks(list(batch.doc_id), list(batch.text), 1 << 21):
                sets = _sets(texts, n)
                keys = band_keys(super_min_hash(sets, bands * rows), bands, rows)
                numbers = [set_numbers(s) if len(s) else (None, None) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, "Int64"),
                        "n_shingles": [len(s) for s in sets],
                        "node": pd.array([a for a, _ in numbers], "Int64"),
                        "check": pd.array([b for _, b in numbers], "Int64"),
                        "bands": [k if len(s) else None for k, s in zip(keys, sets, strict=True)],
                    }
                )

    return bounded_batches(docs).mapInPandas(run, "doc_id long, n_shingles long, node long, check long, bands array<long>")


def _clashes(feats: DataFrame) -> DataFrame:
    """(node): numbers that several different sets share by chance, told by ``check``; hardly ever any."""
    seen = feats.where("node is not null").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    return cut(seen.where("a <> b").select("node", F.lit(True).alias("clash")))


def _told_apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows (node, check, ...) with a node of its own for each set that shares one by chance."""
    if clashes.isEmpty():
        return rows
    return join_by_key(rows, clashes, "node", "check", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash")


def _full_sets(docs: DataFrame, feats: DataFrame, clashes: DataFrame, nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The full sets and bitmaps (node, n, items, bits) of the given nodes, made again from one text of each, and the table that holds them."""
    ids = feats.select("node", "doc_id").where("node is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = cut(ids.select("doc_id").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for _, texts in text_chunks(list(batch.doc_id), list(batch.text), 1 << 21):
                sets = [s for s in _sets(texts, n) if len(s)]
                numbers = [set_numbers(s) for s in sets]
                bits = [parity_bitmap(s).tobytes() for s in sets]
                yield pd.DataFrame({"row": range(at, at + len(sets)), "node": [a for a, _ in numbers], "check": [b for _, b in numbers], "n": [len(s) for s in sets], "items": [s.tobytes() for s in sets], "bits": bits})
                at += len(sets)

    chosen = join_by_key(docs, ids, "doc_id", "text", "inner", BROADCAST_IDS)
    table = written(bounded_batches(chosen).mapInPandas(run, "row long, node long, check long, n long, items binary, bits binary"))
    sets = _told_apart(table, clashes)
    twice = cut(sets.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("node", "first"))
    if not twice.isEmpty():  # a doc_id that stands for several texts
        sets = join_by_key(sets, twice, "node", "row", "left").where("first is null or first = row").drop("first")
    return sets.select("node", "n", "items", "bits"), table


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    few_items, many = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(many, few_items)
    common = int((many[np.minimum(at, len(many) - 1)] == few_items).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _tasks(rows: int, bytes_each: float) -> int:
    return max(1, int(rows * max(64.0, bytes_each) // TASK_BYTES) + 1)


def _verified(pairs: DataFrame, count: int, sets: DataFrame, mean: float, percent: int) -> DataFrame:
    """The ``count`` pairs (a, b) whose full sets are linked. A set is sent once for each pair of its ``b``, and once for every ``BLOCK`` pairs of its ``a``."""
    items = sets.select("node", "items")
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select(F.col("a").alias("_a"), F.ceil(F.col("c") / BLOCK).cast("int").alias("salts"))
    heavy = cut(heavy) if count > BLOCK else None

    def salted(df: DataFrame) -> DataFrame:
        if heavy is None:
            return df.withColumn("salts", F.lit(1))
        known = F.broadcast(heavy) if count // BLOCK <= BROADCAST_IDS else heavy
        return df.join(known, F.col("a") == F.col("_a"), "left").drop("_a").withColumn("salts", F.coalesce("salts", F.lit(1)))

    members = salted(pairs).withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).join(items.select(F.col("node").alias("b"), "items"), "b").select("a", "b", "salt", "items", F.lit(False).alias("hub"))
    hubs = salted(pairs.select("a").distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(items.select(F.col("node").alias("a"), "items"), "a").select("a", F.lit(0).cast("long").alias("b"), "salt", "items", F.lit(True).alias("hub"))
    task = F.pmod(F.xxhash64("a", "salt"), F.lit(_tasks(count, 2 * mean))).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hub = rows[rows.hub]
        held = {k: np.frombuffer(x, np.uint64) for k, x in zip(zip(hub.a, hub.salt, strict=True), hub["items"], strict=True)}
        rest = rows[~rows.hub]
        ok = [_linked(held[k], np.frombuffer(y, np.uint64), percent) for k, y in zip(zip(rest.a, rest.salt, strict=True), rest["items"], strict=True)]
        return rest.loc[np.array(ok, bool), ["a", "b"]]

    return members.unionByName(hubs).groupBy(task.alias("task")).applyInPandas(run, "a long, b long")


def _unsettled(active: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (key, node, root) of buckets that hold several components, unless their only pair was compared before."""
    hubs = active.groupBy("key").agg(F.min("hub").alias("node"), F.count(F.lit(1)).alias("others"), F.min("compared").alias("compared"))
    open_ones = hubs.where("not (others = 1 and compared)")
    rows = active.select("key", "node").join(open_ones.select("key"), "key", "left_semi").unionByName(open_ones.select("key", "node"))
    rooted = cut(join_by_key(rows, groups, "node", "key", "left", BROADCAST_IDS).select("key", "node", F.coalesce("component", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", F.lit(True).alias("open"))
    return join_by_key(rooted, mixed, "key", "node", "inner", BROADCAST_IDS, rows=rooted.count()).drop("open")


class Bitmaps:
    """Parity bitmaps of one block pair's sets, folded to fewer bits where those suffice."""

    def __init__(self, blobs: list[bytes], n: np.ndarray, percent: int):
        self.words = [np.frombuffer(b, np.uint64) for b in blobs]
        self.width = np.array([len(w) for w in self.words])
        self.n, self.percent = n, percent
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of so many words of all sets that have as many, and the row of each set in them."""
        if words not in self.levels:
            have = np.flatnonzero(self.width >= words)
            row = np.full(len(self.words), -1)
            row[have] = np.arange(len(have))
            out = np.empty((len(have), words), np.uint64)
            for k, i in enumerate(have):
                out[k] = np.bitwise_xor.reduce(self.words[i].reshape(-1, words), axis=0)
            self.levels[words] = out, row
        return self.levels[words]

    def possible(self, different: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets that differ in at least so many shingles can be linked."""
        return different.astype(np.int64) * (100 + self.percent) <= (100 - self.percent) * (self.n[i] + self.n[j])

    def left(self, tile: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of ``tile`` and one of ``others`` that their sizes and narrowest bitmaps do not rule out."""
        maps, row = self.level(NARROW // 64)
        x, y = maps[row[tile]], maps[row[others]]
        different = np.zeros((len(tile), len(others)), np.int16)
        for w in range(x.shape[1]):
            different += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
        ni, nj = self.n[tile][:, None], self.n[others][None, :]
        ok = different.astype(np.int64) * (100 + self.percent) <= (100 - self.percent) * (ni + nj)
        ok &= (100 * ni >= self.percent * nj) & (100 * nj >= self.percent * ni)
        i, j = np.nonzero(ok)
        return tile[i], others[j]

    def narrowed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that their full bitmaps do not rule out either."""
        words = NARROW // 64
        open_, most = np.ones(len(i), bool), np.minimum(self.width[i], self.width[j])
        while True:
            words *= 4
            at = np.flatnonzero(open_ & (most > words // 4))
            if not len(at):
                return i[open_], j[open_]
            for size in np.unique(np.minimum(words, most[at])):
                these = at[np.minimum(words, most[at]) == size]
                maps, row = self.level(int(size))
                step = max(1, (1 << 21) // int(size))
                for start in range(0, len(these), step):
                    some = these[start : start + step]
                    a, b = i[some], j[some]
                    different = np.bitwise_count(maps[row[a]] ^ maps[row[b]]).sum(axis=1, dtype=np.int64)
                    open_[some[~self.possible(different, a, b)]] = False


def joining_pairs(left: np.ndarray, right: np.ndarray, same: bool, root: np.ndarray, maps: Bitmaps, confirm: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Pairs (row of ``left``, row of ``right``) of different roots that bitmaps do not rule out, as many as join all their roots.

    With ``confirm`` only confirmed pairs count, and every pair is asked until its roots are joined.
    """
    label = np.unique(root, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 19) // max(1, len(right)))
    for at in range(0, len(left), step):
        tile = left[at : at + step]
        i, j = maps.left(tile, right)
        keep = label[i] != label[j]
        if same:
            keep &= i < j
        i, j = maps.narrowed(i[keep], j[keep])
        if not len(i):
            continue
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(i)], strict=True):
            a, some = int(i[start]), j[start:end]
            some = some[label[some] != label[a]]
            while len(some):
                b = int(some[0])
                if confirm is None or confirm(a, b):
                    out.append((a, b))
                    label[label == label[b]] = label[a]
                    some = some[label[some] != label[a]]
                else:
                    some = some[1:]
    return out


def _weights(members: DataFrame, sets: DataFrame, each: int) -> tuple[DataFrame, int, int]:
    """(key, blocks) of the members' buckets where a shingle takes ``each`` bytes, all bytes to be dealt, and the most blocks of a bucket."""
    sizes = members.join(sets.select("node", (F.col("n") * each + 64).alias("w")), "node").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"))
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / BLOCK_BYTES)).cast("int").alias("blocks"), "w")
    total, most = sizes.agg(F.sum(F.col("w") * F.col("blocks")), F.max("blocks")).first()
    return sizes.select("key", "blocks"), total or 0, most or 1


def _block_pairs(members: DataFrame, sets: DataFrame, percent: int, exact: bool, weights: tuple[DataFrame, int, int]) -> DataFrame:
    """(key, a, b): of the members (key, node, root) of each bucket, pairs that would join all roots that can be joined.

    Without ``exact`` the pairs are those that bitmaps do not rule out, to be confirmed; with it they are links.
    Members are dealt to pairs of blocks of their bucket, and those to tasks.
    """
    blocks, total, most = weights
    rows = members.join(sets.select("node", "n", "bits", *["items"] * exact), "node")
    if most == 1:
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
    else:
        several = cut(blocks.where("blocks > 1"))
        rows = join_by_key(rows, several, "key", "node", "left", BROADCAST_IDS).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"i": F.least("block", "x"), "j": F.greatest("block", "x")}).drop("x", "blocks")
    task = F.pmod(F.xxhash64("key", "i", "j"), F.lit(int(total // TASK_BYTES) + 1)).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.sort_values(["key", "i", "j", "n", "node"], ignore_index=True)
        edge = np.flatnonzero((rows[["key", "i", "j"]] != rows[["key", "i", "j"]].shift()).any(axis=1).to_numpy())
        for start, end in zip(edge, [*edge[1:], len(rows)], strict=True):
            part = rows.iloc[start:end]
            node, root, block = part.node.to_numpy(np.int64), part.root.to_numpy(np.int64), part.block.to_numpy()
            if (root == root[0]).all():
                continue
            i, j = part.i.iloc[0], part.j.iloc[0]
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            maps = Bitmaps(list(part.bits), part.n.to_numpy(np.int64), percent)
            full = [np.frombuffer(x, np.uint64) for x in part["items"]] if exact else []
            confirm = (lambda a, b: _linked(full[a], full[b], percent)) if exact else None  # noqa: B023
            found += [(part.key.iloc[0], min(node[a], node[b]), max(node[a], node[b])) for a, b in joining_pairs(left, right, i == j, root, maps, confirm)]
        return pd.DataFrame(found, columns=["key", "a", "b"]).astype("int64")

    return rows.groupBy(task.alias("task")).applyInPandas(run, "key long, a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near-duplicate texts of (doc_id, text); other columns are ignored.

    Words are runs of other than space and tab to carriage return, with A-Z lower-cased. Two
    documents are linked where the Jaccard similarity of their sets of n-word shingles is at least
    ``percent`` per cent. Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, itself included), kept (doc_id = component_id).

    Null, empty or wordless text: no shingles, its own component, kept. Fewer than n words: the
    whole sequence is the one shingle. Null doc_id: linked like any other, never the smallest of a
    component that has a doc_id. Repeated rows: linked as copies; each gives a row. Empty table: no rows.
    """
    return grouped(docs, n, percent, bands, rows).drop("check", "grp")


def with_check(docs: DataFrame, n: int) -> DataFrame:
    """Adds check, a number of its whole set as in ``grouped``, to rows with a text; null for an empty set."""

    @F.pandas_udf("long")
    def check(texts: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for _, some in text_chunks([0] * len(texts), list(texts), 1 << 21):
            out += [set_numbers(s)[1] if len(s) else None for s in _sets(some, n)]
        return pd.Series(out, dtype="Int64")

    return bounded_batches(docs).withColumn("check", check(F.col("text").cast("string")))


def _groups(docs: DataFrame, feats: DataFrame, clashes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of nodes whose component is another node."""
    buckets = feats.where("node is not null").select("node", F.explode("bands").alias("key"))
    hubs = cut(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("n")).where("hub < top").select("key", "hub", "n"))
    shared = join_by_key(buckets, hubs.select("key", "hub"), "key", "node", "inner", BROADCAST_IDS, counts=hubs.select("key", "n")).where("node <> hub").distinct()
    active = cut(shared.withColumn("first", F.min("hub").over(Window.partitionBy("node"))).select("key", "node", "hub", "first", (F.col("hub") == F.col("first")).alias("compared")))
    pairs = cut(active.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    involved = cut(active.select("node").union(active.select("hub")).distinct())
    sets, table = _full_sets(docs, feats, clashes, involved, n)
    mean = 8 * (sets.agg(F.avg("n")).first()[0] or 1)
    links = cut(_verified(pairs, n_pairs, sets, mean, percent))
    groups = components(links, n_pairs)
    rest = cut(_unsettled(active, groups))
    whole = _weights(rest, sets, 9)
    if whole[1] > DIRECT_BYTES:
        maybe = cut(_block_pairs(rest, sets, percent, False, _weights(rest, sets, 1)))
        asked = cut(maybe.select("a", "b").distinct())
        more = cut(_verified(asked, n_asked := asked.count(), sets, mean, percent))
        links = links.unionByName(more)
        groups = components(links, n_pairs := n_pairs + n_asked)
        failed = maybe.join(more.select("a", "b", F.lit(True).alias("ok")), ["a", "b"], "left").where("ok is null").select("key").distinct()
        rest = cut(_unsettled(active.join(failed, "key", "left_semi"), groups))
        whole = _weights(rest, sets, 9)
    if whole[1]:
        exact = cut(_block_pairs(rest, sets, percent, True, whole).select("a", "b"))
        groups = components(links.unionByName(exact), n_pairs + exact.count())
    discard(table)
    return groups


def grouped(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``near_duplicates`` with check (a number of the whole set) and grp (the same for all rows of a group); both null for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = written(features(docs, n, bands, rows))
    clashes = _clashes(raw)
    feats = _told_apart(raw, clashes)
    groups = _groups(docs, feats, clashes, n, percent)
    nodes = feats.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    n_groups = 2 * groups.count()
    placed = join_by_key(nodes, groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()), "node", "low", "left", BROADCAST_IDS, n_groups)
    placed = cut(placed.where("copies > 1 or component is not null").select("node", "low", F.coalesce("component", "node").alias("grp")))
    n_placed = placed.count()
    least = placed.groupBy("grp").agg(F.min("low").alias("least"))
    known = cut(join_by_key(placed.select("node", "grp"), least, "grp", "node", "inner", BROADCAST_IDS, n_placed))
    rows = feats.select("doc_id", "n_shingles", "node", "check")
    full = join_by_key(rows.where("node is not null"), known, "node", "doc_id", "left", BROADCAST_IDS, n_placed)
    out = full.unionByName(rows.where("node is null").withColumns({"grp": F.lit(None).cast("long"), "least": F.lit(None).cast("long")}))
    component = F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "check", F.when(F.col("node").isNotNull(), F.coalesce("grp", "node")).alias("grp"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The rows of op8_minhash_near_dedup in DuckDB, by comparing all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w
), u AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(x) AS h, x FROM (SELECT doc_id, s, unnest(s) AS x FROM s) z),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM s LEFT JOIN c ON c.a = doc_id
"""
