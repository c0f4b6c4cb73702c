"""The ten training-data operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, common, embedding_dedup, html_text, language, licenses, mixing, near_dedup, packing, quality, topk
from feedloom.llm.common import Words, components, shingles
from feedloom.llm.queries import oracle_sql, queries, tokenizer_path
from tests.compare import duckdb_on, same

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def con():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ours, theirs = same(queries()[name](spark, FOLDER), con, oracle_sql()[name])
    assert ours[0] == theirs[0] and len(ours[1]) > 0
    assert ours[1] == theirs[1]


def odd_documents(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "de", "a", 3), (4, "one two", "en", "b", 7), (5, "One  TWO", "en", None, 8), (5, "One  TWO", "en", None, 8), (None, "one two three four five", None, "b", None), (7, "é" * 50_000 + " x" * 50_000, "fr", "c", 1), (8, "12 !! ??", "en", "c", 8)]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with extra columns of names that operators use."""
    return df.withColumns({c: F.lit("x") for c in ("node", "rank", "size", "ids", "score", "segment", "bucket", "part")})


# --- words and shingles


def test_words_and_shingles():
    texts = ["Ab  cd\tab\x0b", None, "", "É\xa0x Z"]
    w = Words(texts)
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [b"ab", b"cd", b"ab", "É\xa0x".encode(), b"z"]
    assert list(w.first) == [0, 3, 3, 3, 5] and w.hash[0] == w.hash[2] != w.hash[1]
    assert len(shingles(w.hash[:3], 4)) == 1 and len(shingles(w.hash[:0], 4)) == 0 and len(shingles(w.hash[:3], 2)) == 2


@pytest.mark.parametrize("limits", [{}, {"ROWS_A_PART": 20}, {"ROWS_A_PART": 20, "BROADCAST_IDS": 3, "PER_SALT": 5}])
def test_components(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(common, name, value)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_of_components_do_not_grow_by_round(spark, monkeypatch):
    for name, value in {"ROWS_A_PART": 20, "BROADCAST_IDS": 3}.items():
        monkeypatch.setattr(common, name, value)
    found = components(spark.createDataFrame([(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)], "a long, b long"))
    assert found.count() == 100 and found.where("component <> 0").isEmpty()
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 100


# --- 8: near duplicates


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(x for x in least[find(i)])) for i, (d, _) in enumerate(rows)]


def near_corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # a group of near copies, many below the threshold to each other
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "Same  text\nof THREE dozens " + "x y z w " * 5) for i in range(40)]
    rows += [(300 + i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_match_brute_force(spark, n):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, n=n).collect())
    assert got == sorted(brute_groups(rows, n, 80))


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "BROADCAST_IDS": 3, "PER_SALT": 5, "ROWS_A_PART": 7}])
def test_bitmaps_blocks_and_salts_lose_no_link(spark, monkeypatch, limits):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    rows = near_corpus(4)
    for i in range(120):  # a template: similar texts of which hardly any are linked
        w = list(base)
        at = rng.randrange(110)
        w[at : at + 16] = [word() for _ in range(16 + rng.randrange(-3, 2))]
        rows.append((1000 + i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "DIRECT_BYTES", 0)
    for name, value in limits.items():
        for module in (common, near_dedup):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, n=4).collect())
    assert got == sorted(brute_groups(rows, 4, 80))


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([pool[: rng.integers(1, 900)], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(90)]
    n = np.array([len(x) for x in sets])
    maps = near_dedup.Bitmaps([near_dedup.parity_bitmap(x).tobytes() for x in sets], n, 80)
    every = np.arange(len(sets))
    i, j = maps.narrowed(*maps.left(every, every))
    left = set(zip(i.tolist(), j.tolist()))
    linked = {(a, b) for a in range(90) for b in range(90) if near_dedup._linked(sets[a], sets[b], 80)}
    assert linked <= left and len(left) < 1.3 * len(linked)
    confirm = lambda a, b: (a, b) in linked
    pairs = near_dedup.joining_pairs(every, every, True, every, maps, confirm)
    assert set(pairs) <= linked
    root = list(range(90))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in linked)


def test_sets_that_share_a_number_are_told_apart(spark):
    feats = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)], "doc_id long, node long, check long")
    clashes = near_dedup._clashes(feats)
    got = {r["doc_id"]: r["node"] for r in near_dedup._told_apart(feats, clashes).collect()}
    assert clashes.count() == 1 and got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None


def test_near_duplicates_of_odd_documents(spark):
    for docs in (odd_documents(spark), clashing(odd_documents(spark))):
        got = near_dedup.near_duplicates(docs, n=4).collect()
        by = {r["doc_id"]: r for r in got}
        assert len(got) == docs.count() and by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
        assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[1]["kept"] and by[2]["kept"] and by[7]["kept"]
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.sort(pool[:200]), np.sort(pool[40:240]), np.sort(pool[:3]), pool[:0]]
    sketch = near_dedup.super_min_hash(sets, 128)
    assert abs((sketch[0] == sketch[1]).mean() - 160 / 240) < 0.13
    assert np.isfinite(sketch[:3]).all() and np.isinf(sketch[3]).all()
    assert (near_dedup.super_min_hash([sets[0]], 128)[0] == sketch[0]).all()


# --- 10: embeddings


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.05, size=(20, 16)), base[:10] * 3, np.repeat(base[:1], 30, axis=0), rng.normal(size=(100, 16))])
    label = [i % 3 for i in range(len(x))]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [], 0), (906, [1.0, 2.0], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_near_duplicates(df.withColumn("rep", F.lit(1)).repartition(3)).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert all((got[i]["n_links"], got[i]["component_id"]) == (link[i].sum(), comp[i]) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    assert embedding_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_one_very_long_vector_among_others(spark):
    rng = np.random.default_rng(8)
    long = rng.normal(size=50_000)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 1) for i in range(50)] + [(100, [float(v) for v in long], 1), (101, [float(v) * 2 + 1e-3 for v in long], 1), (102, [1.0] * 1500, 1), (103, [1.0] * 1500, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert got[100] == (1, 100) and got[101] == (1, 100) and got[102] == (1, 102) and got[103] == (1, 102)
    assert embedding_dedup.principal_axes(df.withColumn("dims", F.size("embedding"))) == {}  # of no length is there more than a tile


@pytest.mark.parametrize("dims", [40, 300, 1536])
def test_leading_axes_of_any_length_prune_most_pairs(spark, monkeypatch, dims):
    monkeypatch.setattr(embedding_dedup, "TILE", 300)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(1200, dims)) * np.where(np.arange(dims) < dims // 10, 1.0, 0.05) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x[600:640] = x[:40] + rng.normal(scale=0.002, size=(40, dims))
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    axes = embedding_dedup.principal_axes(df.withColumn("dims", F.size("embedding")))
    q = axes[dims]
    assert q.shape == (dims, min(dims, embedding_dedup.AXES)) and np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-10
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.sort(np.linalg.eigvalsh(unit.T @ unit))[::-1][: q.shape[1]].sum()
    assert ((unit @ q) ** 2).sum() >= 0.9 * best
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    full = []
    i, j = embedding_dedup._tile_links(x[:600], x[600:], axes, 0.98, False, full)
    assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(k.tolist() for k in np.nonzero(link[:600, 600:]))))
    assert sum(full) < 600 * 600 / 10 + len(i)
    comp = np.arange(len(x))
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert got == {k: (link[k].sum(), comp[k]) for k in range(1200)} and link.any()


def test_one_vector_copied_often(spark, monkeypatch):
    monkeypatch.setattr(common, "PER_SALT", 50)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_BYTES", 0)
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).when(F.col("id") % 3 == 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(-1.0), F.col("id").cast("double"))).alias("embedding"), F.lit(1).alias("label"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert all(got[i] == (999, 0) for i in range(0, 3000, 3)) and all(got[i] == (0, i) for i in range(1, 3000, 3)) and got[2][0] < 999 and len(got) == 3000


def test_top_k_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 8)) / 8
    x[250:] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1050, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, 300, 50):
        order = sorted((-int(v[q] @ v[j]), j) for j in range(300) if j != q)[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.withColumn("score", F.lit(0)).repartition(4)).collect())
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 0")).count() == 0


def posting_block(ids, m):
    return dict(zip(topk.BLOCK_COLUMNS, topk.posting_block(0, list(ids), [list(v) for v in m])))


def packet(ids, m, floor=None):
    return topk.Queries(ids, *topk._sparse([list(v) for v in m]), floor)


@pytest.mark.parametrize("scale", [256, 2**29])
def test_search_stops_early_and_stays_exact(monkeypatch, scale):
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16)) ** 3
    m = (x / np.abs(x).max() * scale).astype(np.int64) if scale > 256 else (x * scale).astype(np.int64)
    m[1000:1010] = m[:10] + 1  # near ties
    ids = np.arange(2000)
    read = []
    row, vec, score = topk.search(packet(ids[:20], m[:20]), posting_block(ids, m), 5, read)
    full = m[:20].astype(object) @ m.T.astype(object)
    for q in range(20):
        want = sorted((-int(full[q, j]), j) for j in range(2000) if j != q)[:5]
        assert [(-int(s), int(v)) for r, v, s in zip(row, vec, score) if r == q] == want
    assert sum(read) < 0.8 * 20 * np.count_nonzero(m)  # multiplications: fewer than those of one full product
    floor = np.array([float(sorted(-int(full[q, j]) for j in range(2000) if j != q)[4]) * -1 for q in range(20)])
    less = []
    again = topk.search(packet(ids[:20], m[:20], floor - np.abs(floor) * 2**-50), posting_block(ids, m), 5, less)
    assert [a.tolist() for a in again] == [row.tolist(), vec.tolist(), score.tolist()] and sum(less) <= sum(read)


def test_one_long_vector_inflates_nothing():
    import tracemalloc

    rng = np.random.default_rng(1)
    vs = [list(v) for v in rng.integers(-200, 200, (4000, 16))] + [list(rng.integers(-200, 200, 50_000))]
    tracemalloc.start()
    block = dict(zip(topk.BLOCK_COLUMNS, topk.posting_block(0, list(range(4001)), vs)))
    row, vec, score = topk.search(topk.Queries(np.arange(3900, 4001), *topk._sparse(vs[3900:])), block, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and len(row) == 101 * 5
    wide = np.zeros((4001, 50_000), np.int16)
    for i, v in enumerate(vs):
        wide[i, : len(v)] = v
    for q in (0, 57, 100):
        s = wide[:, : len(vs[3900 + q])].astype(np.int64) @ wide[3900 + q, : len(vs[3900 + q])].astype(np.int64)
        want = sorted((-int(s[j]), j) for j in range(4001) if j != 3900 + q)[:5]
        assert [(-int(x), int(v)) for r, v, x in zip(row, vec, score) if r == q] == want


def test_top_k_of_odd_vectors(spark, monkeypatch):
    for name, value in {"BLOCK": 4, "POSTINGS": 5, "TOGETHER": 2, "QUERIES": 1}.items():
        monkeypatch.setattr(topk, name, value)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0]), (2, [3.0, 0.0, 7.0]), (3, []), (4, [-1.0, -1.0]), (50, [2.0**20, 2.0**20]), (5, [2.0**21, 1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide = lambda v: [int(256 * x) for x in v] + [0] * (3 - len(v))
    for q in (0, 50):
        mine = wide(dict(rows)[q])
        want = sorted((-sum(a * b for a, b in zip(mine, wide(v))), i) for i, v in rows if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


# --- 3: mixing


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    target, taken = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    words = sum(len(WORD.findall(r["text"])) for r in mixing.mixed_documents(docs).select("text").collect())
    assert words == sum(taken.values())


def test_water_filling(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got["a"] == 20.0 and got["c"] == 20.0 and got[None] == 1000.0 and abs(sum(got.values()) - 2280) < 1e-6


def test_mixing_of_odd_documents(spark):
    docs = clashing(odd_documents(spark))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 9 and {r["taken"] for r in rows if r["size"] == 0} == {0}
    assert mixing.mixed_documents(odd_documents(spark)).columns == odd_documents(spark).columns
    assert mixing.mix_sources(empty_documents(spark)).count() == 0 and mixing.mixed_documents(empty_documents(spark)).count() == 0


# --- 7: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    special = ["It's the DON'T ''s 'S", "CAFÉ Café İstanbul ΣΑΣ ẞ", "a\x1cb\x85c\xa0d", "<|endoftext|> X<|EndOfText|>y", "J̌ a ́b", "日本語 😀😀 a😀b", "1,234.50 «x» ...!!!?", "\x00 \x7f ª º µ"]
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).union(spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(special)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(clashing(df), tokenizer_path(), window=256, with_ids=True).collect()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    parts, where = {}, {}
    for r in got:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, spans in parts.items():
        assert sum(n for _, n in spans) == len(ids[d])
    for s, spans in where.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 256 or s == max(where)
    assert sorted(where) == list(range(len(where)))
    assert packing.pack(empty_documents(spark), tokenizer_path()).count() == 0


# --- 4 and 6: classifiers


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries()["op4_quality_classifier"](spark, folder).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == labels.count() and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert docs.count() == queries()["op4_quality_classifier"](spark, folder).count()


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    weights = quality.train(odd_documents(spark), labels)
    rows = quality.score_quality(clashing(odd_documents(spark)), weights).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.score_quality(empty_documents(spark), quality.train(empty_documents(spark), labels.limit(0))).count() == 0


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries()["op6_language_id"](spark, folder).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_matches_a_plain_version(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC.") for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(70, "x y " * 30_000), (71, None), (3, "again a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(75)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    known = [(r["doc_id"], r["text"], r["quality"]) for r in docs.join(labels.distinct(), "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    values = {}
    for d, t, y in known:
        f = quality.hashed_features([t])[0].tolist()
        values[d, t, y] = {i: np.float64(np.float32(np.sqrt(f.count(i) / max(1, len(f))))) for i in (sorted(set(f)) if len(f) < 9000 else np.unique(f).tolist())}
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).distinct().collect()}
    trained = quality.train(docs, labels)
    ties = {k for k in values if sum(k[0] == o[0] for o in values) > 1}
    order = sorted(values, key=lambda k: (hashes[k[0]], k[0], k[2]))
    z, n = {}, {}
    size = 1 << quality.BITS

    def weight(i, l1=0.002, alpha=0.5):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(n.get(i, 0.0))) / alpha)

    for _ in range(5):
        for k in order:
            x = {**values[k], size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - k[2]) * v
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / 0.5
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    plain = np.array([weight(i) for i in range(size + 1)])
    if not ties:
        assert np.allclose(trained, plain, atol=1e-6)
    for r in quality.score_quality(docs, trained).collect():
        f = quality.hashed_features([r["text"]])[0]
        at, c = np.unique(f, return_counts=True)
        dot = trained[-1] + (trained[at] * np.sqrt(c / max(1, len(f)))).sum()
        assert abs(r["score"] - 1 / (1 + np.exp(-dot))) < 1e-9
    few = quality.train(docs, labels, max_features=300)
    assert np.count_nonzero(few) < np.count_nonzero(trained) and np.count_nonzero(quality.train(docs, labels, max_features=0)) > 0


def test_language_matches_a_plain_version_and_keeps_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    rows = docs.limit(40).collect()
    got = {r["doc_id"]: r for r in language.identify(docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows])), model).collect()}
    for r in rows:
        data = [c if c >= 128 or 97 <= c <= 122 else 32 for c in r["text"].lower().encode()]
        grams = {}
        for size, tag in ((1, 25), (2, 26), (3, None)):
            for at in range(len(data) - size + 1):
                g = data[at : at + size]
                if any(c != 32 for c in g):
                    v = int.from_bytes(bytes(g), "big") + (1 << tag if tag else 0)
                    h = (v * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)
                    grams[h] = grams.get(h, 0) + 1
        v = {h: np.log1p(c) * model.idf[h] for h, c in grams.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[h]) for h, x in v.items()) / max(norm, 1e-12) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert abs(got[r["doc_id"]]["score"] - min(1, max(0, cosine[best]))) < 1e-3
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-4
    for size, most in ((5, 0.03), (10, 0.01), (40, 0.01)):
        short = docs.where(F.length("text") >= size).select(F.substring("text", 1, size).alias("text")).where(F.col("text").rlike(r"\p{L}"))
        found = language.identify(short, model)
        assert found.where("rejected").count() <= most * short.count()
    odd = ["The quick brown fox jumps over the lazy dog.", "Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ", "xq zzkj wqx qqzx jjkq vvxz qxzj kqvx zzxq"]
    rejected = [r["rejected"] for r in language.identify(spark.createDataFrame([(t,) for t in odd], "text string").coalesce(1), model).collect()]
    assert rejected[0] is False and rejected[1] and rejected[2]


def test_language_sample_of_repeated_rows(spark):
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, f"hello there number {i % 3} of the rows", "en") for i in range(3000)] + [(i, f"guten tag zusammen {i}", "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert set(model.languages) == {"de", "en"} and len([x for x in model.languages if x == "en"]) <= 3


def test_language_of_odd_documents(spark):
    model = language.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    got = {r["doc_id"]: r for r in language.identify(clashing(odd_documents(spark)), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and got[4]["lang_pred"] in model.languages
    assert language.identify(empty_documents(spark), language.train(empty_documents(spark))).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_documents(spark), language.train(empty_documents(spark))).collect()} == {"und"}


# --- 9: pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x -->
<article><h1>Title &amp; more</h1><p><b>First   line.<br><p>Second&nbsp;one &lt;here&gt;.</p></article><div class="comments"><p>me too</p></div><footer>&copy; me</footer>"""


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = html_text.train(pages)
    for r in html_text.extract_text(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        body = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        import html

        want = " ".join(html.unescape(re.sub(r"<br>|</?(p|h1|article)>", " ", body).replace("<b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain text"), (5, "u", "<p"), (6, "u", "<div>" * 3000 + "x")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), model).collect()}
    assert got[1] == "Title & more First line. Second one <here>." and got[2] == got[3] == ""
    assert html_text.extract_text(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


def test_blocks():
    names = [(b.place.name, b.text) for b in html_text.blocks(PAGE)]
    assert names == [("li", "A"), ("h1", "Title & more"), ("p", "First line."), ("p", "Second one <here>."), ("p", "me too"), ("footer", "© me")]


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p>one</p><svg class="i"/><p>two</p>', ["one", "two"]),
        ("<p>one</p><iframe src=x/><p>two</p>", ["one", "two"]),
        ("<p>one</p><button>x<p>two</p>", ["one", "x", "two"]),
        ("<title-bar>one</title-bar><video-card/><p>two</p>", ["one", "two"]),
        ("<p>a</p><math><mi>x</mi></math><object>kept</object>", ["a", "x", "kept"]),
        ("<p>1 < 2 & 3 > 2</p>", ["1 < 2 & 3 > 2"]),
        ("a <!-- x <p>b</p>", ["a b"]),
        ("a<!-->b<!-- x --><!--->c", ["abc"]),
        ("<p class='x>one</p><p>two</p>", ["one", "two"]),
        ('<p title="a > b">one</p>', ["one"]),
        ("<script/>one<script>x</SCRIPT >two<style>y", ["one two"]),
        ("<template><p>x</p></template>y<title>t</title>", ["y"]),
        ("<p", ["<p"]),
        ("x</", ["x</"]),
        ("<!DOCTYPE html>z<!", ["z<!"]),
    ],
)
def test_odd_markup_loses_no_text(page, texts):
    assert [b.text for b in html_text.blocks(page)] == texts


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>x" * 60_000, "<a b='" * 170_000, "<div>" * 80_000 + "</p>" * 80_000, "<div>" * 80_000 + "<li>x</li>" * 60_000, "<!--" * 250_000, "< " * 300_000])
def test_hostile_pages_are_read_in_linear_time(page):
    import time

    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 5


def test_long_pages_are_labelled_whole_and_alike():
    rng = np.random.default_rng(1)
    page = [html_text.Block(html_text.placed(("html", "div", ".content", "p")), "word " * int(rng.integers(1, 30)) + "end.", 0.0) for _ in range(html_text.STEPS + 700)]
    model = html_text.BlockLabeller()
    alone = model.probabilities([page])[0]
    assert len(alone) == len(page)
    together = model.probabilities([page, page[:50], [], page[:3]])
    assert np.allclose(together[0], alone, atol=1e-5) and np.allclose(together[1], model.probabilities([page[:50]])[0], atol=1e-5) and len(together[2]) == 0
    x, live = model._pad([html_text.block_vectors(page[:50])])
    both = np.concatenate([model._run(x, live, "f", False)[0], model._run(x[::-1], live[::-1], "b", False)[0][::-1]], axis=2)
    plain = 1 / (1 + np.exp(-(both @ model.p["o"] + model.p["ob"])[:, 0, 0]))
    assert np.allclose(plain, together[1], atol=1e-5)


def test_pages_that_name_no_part(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(20):
        paragraphs = [" ".join(word() for _ in range(rng.randrange(40, 90))).capitalize() + "." for _ in range(rng.randrange(3, 7))]
        page = "<html><body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</td><td>Copyright 2020</td></tr></table></body></html>"
        rows.append((i, "u", page, " ".join(paragraphs)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, html_text.train(pages)).collect()}
    kept = sum(all(p in got[i] for p in want.split(". ")) for i, _, _, want in rows)
    assert kept >= 18 and sum("Home" in t for t in got.values()) <= 2
    model = html_text.train(pages.limit(0))
    assert html_text.extract_text(pages.limit(1), model).count() == 1


def test_block_vectors_hold_all_words_and_names():
    words = [f"w{i % 700}" for i in range(30_000)]
    text = "same opening " * 12 + " ".join(words)
    place = html_text.placed(("p",))
    got = html_text.block_vectors([html_text.Block(place, text, 0.0), html_text.Block(place, "same opening " * 12 + "other", 0.0)])[:, html_text.PATH : html_text.PATH + html_text.WORDS]
    want = np.bincount([zlib.crc32(w.encode()) % html_text.WORDS for w in text.split(" ")], minlength=html_text.WORDS) / len(text.split(" "))
    assert np.allclose(got[0], want, atol=1e-6) and not np.allclose(got[0], got[1])
    long = "x" * 60
    assert html_text.blocks(f"<p class='{long}'>t</p>")[0].place.bits >> (zlib.crc32(f".{long}".encode()) % html_text.PATH) & 1


# --- 2: licences


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "code\nno header"), ("a/b/c/y.c", "/* Licensed under the Apache License, Version 2.0. */\ncode"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/z.c", None), ("q/x.c", ""), ("top.c", "the of and"), (None, "Licensed under CC BY-NC 4.0."), ("a/LICENSE", "Released under the MIT License."), ("ab/x.c", "x"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("?"))
    got = {(r["path"], r["own_license"]): (r["license"], r["license_from"]) for r in licenses.scan_licenses(files).collect()}
    assert got["a/b/x.c", None] == ("GPL-3.0", "a/b") and got["a/b/c/z.c", None] == ("GPL-3.0", "a/b")
    assert got["a/b/c/y.c", "Apache-2.0"][0] == "Apache-2.0" and got[None, "CC-BY-NC-4.0"][0] == "CC-BY-NC-4.0"
    assert got["q/x.c", None] == (None, None) == got["top.c", None] == got["ab/x.c", None]
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_licence_anchors_lose_nothing():
    model = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "of": 800, "to": 700, "and": 600, "is": 500}, 1000, licenses.THRESHOLD)
    for _, text in licenses.TEMPLATES:
        assert model.best(text)[1] > 0.999
    rng = random.Random(7)
    every = sorted(model.by_term)
    for _ in range(300):
        line = " ".join(rng.choice([*every, "other", "words"]) for _ in range(rng.randrange(1, 12)))
        bare = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "of": 800, "to": 700, "and": 600, "is": 500}, 1000, licenses.THRESHOLD)
        bare.anchors = every
        assert model.best(line) == bare.best(line)


def test_licence_among_other_words(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    texts = {
        "neighbours": "copyright zork quux Released under the MIT License. frobnicate all of it again and again", "lines": "zork zork\n * Licensed under the\n * Apache License, Version 2.0. zork zork zork zork zork",
        "paragraph": "blah " * 400 + apache + " blib" * 400, "nothing": "a license to sail under the flag of version two", "twice": f"x {apache} y Released under the MIT License.",
    }
    for n in (20, 20_000):
        files = spark.createDataFrame(list(texts.items()), "path string, text string").unionByName(spark.range(n).select(F.lit("z/").alias("path"), F.lit("plain words").alias("text")))
        got = {r["path"]: r["own_license"] for r in licenses.scan_licenses(files).where("path <> 'z/'").collect()}
        assert got == {"neighbours": "MIT", "lines": "Apache-2.0", "paragraph": "Apache-2.0", "nothing": None, "twice": "Apache-2.0"}


def test_licence_scores_count_all_terms(spark):
    rows = [("a", "Released today under the MIT License")] + [(f"t{i}", "today") for i in range(70)] + [(f"n{i}", "other") for i in range(30)]
    got = {r["path"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}["a"]
    model = licenses.Matcher(licenses.TEMPLATES, {t: 1 for t in ("released", "under", "the", "mit", "license")}, 101, licenses.THRESHOLD)
    assert got["own_license"] == "MIT" and abs(got["own_score"] - model.best("released today under the mit license", {"today": 71})[1]) < 1e-9
    assert model.passages("x Released under the MIT License y")[2][:3] == (1, 6, 0)


def test_real_licence_texts(spark):
    import pathlib

    t = dict((n, t) for n, t in licenses.TEMPLATES)
    folder = pathlib.Path("/usr/share/common-licenses")
    rows = [("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + t["Unlicense"].replace("unencumbered", "unencumbered")), ("n/LICENSE", "The MIT License (MIT)\n\nCopyright (c) 1999-2024 A. N. Other\n\n" + [x for n, x in licenses.TEMPLATES if n == "MIT"][-1])]
    want = {"m/LICENSE": "Unlicense", "n/LICENSE": "MIT"}
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("BSD", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0")):
        if (folder / file).exists():
            rows.append((f"{file}/COPYING", (folder / file).read_text()))
            want[f"{file}/COPYING"] = name
    rows += [
        ("spdx.c", "// SPDX-License-Identifier: MIT\nint x;"), ("spdx2.c", "# SPDX-License-Identifier: (Apache-2.0 OR MIT)\n"), ("not.txt", "This file is not released under the MIT License."), ("nor.txt", "Never licensed under the Apache License, Version 2.0."),
        ("warranty.txt", "There is no warranty. Released under the MIT License."), ("isc.c", "/*\n * Copyright (c) 2001 X\n *\n * " + t["ISC"].replace(". ", ".\n * ") + "\n */\ncode"),
    ]
    want |= {"spdx.c": "MIT", "spdx2.c": "Apache-2.0 OR MIT", "not.txt": None, "nor.txt": None, "warranty.txt": "MIT", "isc.c": "ISC"}
    files = spark.createDataFrame(rows, "path string, text string")
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.concat(F.lit("z/"), F.col("doc_id").cast("string")).alias("path"), "text")
    got = {r["path"]: r["own_license"] for r in licenses.scan_licenses(files.unionByName(prose)).where("path not like 'z/%'").collect()}
    assert got == want


@pytest.mark.parametrize("n", [10, 3000])
@pytest.mark.parametrize("most", [200_000, 0])
def test_versions_choices_and_bygone_licences(spark, monkeypatch, n, most):
    monkeypatch.setattr(licenses, "BROADCAST_TERMS", most)
    texts = {
        "gpl": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright", "old": "Licensed under the Apache License, Version 1.1.", "gone": "We left it. Released under the MIT License before, now proprietary.",
        "two": "Released under the MIT License. Also zork quux blah. Licensed under the Apache License, Version 2.0.", "null": None,
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string").unionByName(spark.range(n).select(F.lit("z/").alias("path"), F.lit("plain words").alias("text")))
    got = {r["path"]: r for r in licenses.scan_licenses(files).where("path <> 'z/'").collect()}
    assert got["gpl"]["own_license"] in ("GPL-3.0", None) and got["old"]["own_license"] != "Apache-2.0" and got["gone"]["own_license"] is None and got["null"]["own_licenses"] is None
    assert got["two"]["own_licenses"] == ["MIT", "Apache-2.0"]


def test_files_of_many_licences_and_repeated_anchors():
    model = licenses.Matcher(licenses.TEMPLATES, {}, 1000, licenses.THRESHOLD)
    mit = [x for n, x in licenses.TEMPLATES if n == "MIT"][-1]
    rng = random.Random(5)
    bundle = "\n\n".join(f"Copyright {i} {rng.random()} Holder{i}\n" + " ".join(w for w in mit.split() if rng.random() > 0.1) for i in range(200))
    began = time.process_time()
    wanted = model.wanted(bundle)
    assert sum(len(w) for w in wanted) < len(bundle) / 2
    name, score, names = model.judged(bundle, dict.fromkeys(wanted, 1))
    assert name == "MIT" and score < 1 and names[0] == "MIT"
    assert time.process_time() - began < 60
    for word in ("a", "license", "the"):
        began = time.process_time()
        model.wanted(mit + ("\n" + word) * (1_000_000 // (len(word) + 1)))
        assert time.process_time() - began < 15


def test_scan_and_inheritance_match_brute_force(spark):
    rng = random.Random(11)
    short = [(n, x) for n, x in licenses.TEMPLATES if len(licenses.terms(x)) < 14]
    pool = sorted({w for _, x in short for w in licenses.terms(x)} - licenses.DENIALS) + ["zork", "quux", "blah"] * 6
    files = []
    for i in range(60):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randrange(0, 4)))
        name = rng.choice(["LICENSE", "COPYING.txt", "x.c", "y.c", "z.c"])
        text = "\n".join(rng.choice(short)[1] if rng.random() < 0.2 else " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 4)))
        files.append((f"{folder}/{i}{name}".lstrip("/") if name[0] in "xyz" else f"{folder}/{name}{i}".lstrip("/"), text))
    held = [set(licenses.terms(t)) for _, t in files]
    idf = lambda t: np.log((len(files) + 1) / (sum(t in h for h in held) + 1)) + 0.05

    def cosine(a, b):
        a, b = ({t: (1 + np.log(n)) * idf(t) for t, n in licenses.Counter(x).items()} for x in (a, b))
        length = lambda v: np.sqrt(sum(x * x for x in v.values()))
        return sum(w * b.get(t, 0) for t, w in a.items()) / max(1e-300, length(a) * length(b))

    def own(text):
        words, best = licenses.terms(text), (0.0, None)
        passages = [licenses.terms(x) for x in text.splitlines()] + ([words] if len(words) >= 30 else [])
        for name, wording in short:
            size = len(licenses.terms(wording))
            runs = [words[at : at + size] for at in range(len(words) - size + 1)]
            said = lambda w: {w[k + 1] for k in range(len(w) - 1) if w[k] == "version" and w[k + 1].isdigit()}
            mine = said(licenses.terms(wording))
            bounds = [(at, at + size) for at in range(len(words) - size + 1)]
            ends = np.cumsum([0, *[len(licenses.terms(x)) for x in text.splitlines()]])
            bounds = [*zip(ends[:-1], ends[1:]), *([(0, len(words))] if len(words) >= 30 else []), *bounds]
            for p, (start, end) in zip(passages + runs, bounds, strict=True):
                other = said(words[start : end + 3])  # stated in the passage, or by the two words after it
                if mine and other and not other & mine:
                    continue
                best = max(best, (cosine(p, licenses.terms(wording)) if p else 0.0, name), key=lambda x: round(x[0], 9))
        return best[0] if best[0] >= licenses.THRESHOLD else None

    want = {p: own(t) for p, t in files}
    df = spark.createDataFrame(files, "path string, text string")
    got = {r["path"]: r for r in licenses.scan_licenses(df, short).collect()}
    for path, score in want.items():
        assert (got[path]["own_score"] is None) == (score is None) and (score is None or abs(got[path]["own_score"] - score) < 1e-6), path
    for path, r in got.items():
        if r["own_license"] is None:
            folder, nearest = path.rsplit("/", 1)[0] if "/" in path else "", None
            while True:
                above = [(-o["own_score"], p) for p, o in got.items() if (p.rsplit("/", 1)[0] if "/" in p else "") == folder and o["own_license"] and re.match("(?i)(un)?licen[sc]e|copying", p.rsplit("/", 1)[-1])]
                if above:
                    nearest = got[min(above)[1]]["own_license"]
                    break
                if not folder:
                    break
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
            assert r["license"] == nearest, path


# --- 5: chat


def brute_states(codes, model):
    import itertools

    seen = chat.seen_scores(np.array(codes), 0, model)
    best = None
    for path in itertools.product(range(chat.STATES), repeat=len(codes)):
        score = model.start[path[0]] + sum(s[r] for s, r in zip(seen, path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
        if best is None or score > best[0] + 1e-9:
            best = (score, path)
    return list(best[1])


def test_viterbi_matches_brute_force(spark):
    model = chat.train(chat.as_transcripts(spark.read.parquet(f"{FOLDER}/conversations.parquet")))
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, chat.MARKERS * 12, n).tolist() for n in (1, 2, 3, 4, 4, 4, 5)]
    none = np.zeros((len(codes), chat.STATES))
    got = chat.viterbi([chat.seen_scores(np.array(c), 0, model) for c in codes], model.move, none + model.start, none)
    assert [g.tolist() for g in got] == [brute_states(c, model) for c in codes]


def whole_turns(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn_found"], r["piece"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


@pytest.mark.parametrize("segment", [3, 64])
def test_transcripts_are_parsed_alike_in_segments_and_nothing_is_lost(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    chunks = chat.as_transcripts(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    model = chat.train(chunks)
    found = whole_turns(chat.parse(chunks, model).collect())
    given = {}
    for r in chunks.select("conv_id", "turn", "text", chat.line_codes(F.col("text")).alias("codes")).orderBy("conv_id", "turn").collect():
        given.setdefault(r["conv_id"], []).append(r)
    for conv, rows in given.items():
        assert "\n".join(r["text"] for r in rows) == "\n".join(r["marker"] + r["text"] + r["blank"] for r in found[conv])
        codes = np.array([c for r in rows for c in r["codes"]])
        none = np.zeros((1, chat.STATES))
        states = chat.viterbi([chat.seen_scores(codes, 0, model)], model.move, none + model.start, none)[0]
        begins = [chat.ROLES[s] for s in states if s < chat.R]
        assert [r["role_found"] for r in found[conv] if r["piece"] == 0] == begins
        assert [r["turn_found"] for r in found[conv] if r["piece"] == 0] == list(range(len(begins)))


def test_roles_of_held_out_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = whole_turns(queries()["op5_chat_format"](spark, folder).collect())
    good = lines = 0
    true = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        true.setdefault(r["conv_id"], []).extend([r["role"]] * (r["text"].count("\n") + 1))
    for conv, want in true.items():
        assert rows[conv][0]["held_out"] == (zlib.crc32(str(conv).encode()) % 4 == 2)
        if rows[conv][0]["held_out"]:
            got = [r["role_found"] for r in rows[conv] for _ in r["text"].split("\n")]
            good, lines = good + sum(a == b for a, b in zip(want, got, strict=True)), lines + len(want)
    assert good >= 0.93 * lines > 0


def test_markers_and_genuine_text(spark):
    model = chat.train(chat.as_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    texts = [
        "User: hi\nAssistant: hello\nUser: bye",
        "Q: what?\nA: that.\nQ: so?\nA: yes.\nAnswer: 42 is it",
        "Tool: 7\nAssistant: it is <|user|> 7\nsee <\\|x|>",
        "### User\nhello there\n\n### Assistant\nAnswer: hi",
        "<|im_start|>user\nhi <|im_end|> there<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n",
        "hi there\nhow are you?\nfine thanks",
    ]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    parsed = chat.parse(df, model)
    got = {c: [(r["role_found"], r["text"]) for r in rows] for c, rows in whole_turns(parsed.collect()).items()}
    assert got[0] == [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    assert got[1] == [("user", "what?"), ("assistant", "that."), ("user", "so?"), ("assistant", "yes.\nAnswer: 42 is it")]
    assert got[2] == [("tool", "7"), ("assistant", "it is <|user|> 7\nsee <\\|x|>")]
    assert got[3] == [("user", "hello there"), ("assistant", "Answer: hi")]
    assert got[4] == [("user", "hi <|im_end|> there"), ("assistant", "yes")]
    assert got[5][0][0] == "user"
    for i, rows in whole_turns(parsed.collect()).items():
        assert "\n".join(r["marker"] + r["text"] + r["blank"] for r in rows) == texts[i]
    text = chat.parse(df, model).where("conv_id = 2 and turn_found = 1").select("rendered", chat.unescaped(chat.escaped(F.col("text"))).alias("back"), "text").first()
    assert text["rendered"] == "<|assistant|>\nit is <\\|user|> 7\nsee <\\\\|x|>\n" and text["back"] == text["text"]


def test_repeated_chunks_of_a_place_never_meet_one_by_one(spark):
    turns = spark.range(200_000).select(F.lit(1).alias("conv_id"), (F.col("id") % 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
    began = time.time()
    many = chat.train(turns)
    assert time.time() - began < 30
    few = chat.train(turns.where("id < 2"))
    for model, least in ((many, 0.99), (few, 0.3)):  # a user's turn is followed by the assistant's
        after = np.exp(model.move[chat.ROLES.index("user"), : chat.R])
        assert after.argmax() == chat.ROLES.index("assistant") and after.max() >= least * after.sum()


def test_odd_chunks(spark):
    odd = spark.createDataFrame([(1, 0, None, None), (1, None, "user", "User: x"), (1, None, "user", "User: y"), (None, 3, "odd", ""), (1, 0, None, None), (2, 5, "bot", "### Assistant\nhi"), (4, 1, "user", "x" * 200_000 + "\n" * 3000)], "conv_id long, turn long, role string, text string")
    model = chat.train(odd)
    got = whole_turns(chat.parse(odd.withColumn("segment", F.lit(9)), model).collect())
    assert set(got) == {None, 1, 2, 4} and all(r["role_found"] in chat.ROLES for rows in got.values() for r in rows)
    assert sum(len(r["text"]) + len(r["blank"]) for r in got[4]) + len(got[4]) - 1 == 203_000
    assert sorted(r["text"] for r in got[1] if r["marker"]) == ["x", "y"] and got[2][0]["role_found"] == "assistant"
    assert chat.parse(odd.limit(0), chat.train(odd.limit(0))).count() == 0
