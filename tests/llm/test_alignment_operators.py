"""Whitening, token alignment and benchmark decontamination against brute force, and on odd input."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import alignment, decontamination, whitening
from feedloom.llm.queries import queries, tokenizer_path
from tests.llm.test_training_operators import FOLDER, LOWER, clashing, empty_documents, odd_documents

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>"

# --- 11: whitening


@pytest.mark.parametrize("kind", ["random", "identity", "zero", "clusters", "graded", "rank"])
def test_spectrum_matches_eigenvalues(kind):
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    x = rng.normal(size=(200, 48)) * np.linspace(1, 20, 48)
    v = {
        "random": np.cov(x.T), "identity": np.eye(48) * 3, "zero": np.zeros((48, 48)), "clusters": (u * np.repeat([1, 2, 2 + 1e-10, 3], 12)) @ u.T,
        "graded": (u * np.logspace(0, -17, 48)) @ u.T, "rank": np.cov(x[:20].T),
    }[kind]
    e, q = whitening.spectrum(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh((v + v.T) / 2)[::-1]).max() <= 1e-14 * size
    assert np.linalg.norm(v @ q - q * e) <= 1e-13 * size and np.abs(q.T @ q - np.eye(48)).max() < 1e-13


def test_polar_factor_is_the_sign():
    u = np.linalg.qr(np.random.default_rng(2).normal(size=(30, 30)))[0]
    e = np.concatenate([np.logspace(0, -9, 14), -np.logspace(0, -12, 16)])
    assert np.abs(whitening.polar((u * e) @ u.T) - (u * np.sign(e)) @ u.T).max() < 1e-4
    assert np.abs(whitening.polar((u * np.sign(e) * 7) @ u.T) - (u * np.sign(e)) @ u.T).max() < 1e-13


def brute_whitened(rows, components=32):
    kept = [(i, [int(np.floor(c * 64)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    n, sums = len(x), [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    centred = x - x.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    y = centred @ q[:, :components] / np.sqrt(e[:components])
    out = {}
    for k, (i, v) in enumerate(kept):
        for c in range(y.shape[1]):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), y[k, c], e[c] / e.sum())
    return out


def test_whitening_matches_eigendecomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = {(r["vec_id"], r["component"]): r for r in queries()["op11_whiten_embeddings"](spark, FOLDER).collect()}
    want = brute_whitened(rows)
    assert set(got) == set(want)
    signs = {c: np.sign(sum(got[k]["whitened"] * want[k][2] for k in want if k[1] == c)) for c in range(1, 33)}
    for k, (n, deviation, y, explained) in want.items():
        r = got[k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] * signs[k[1]] - y) < 1e-8 and abs(r["explained"] - explained) < 1e-10 and 0 <= r["identity_error"] < 1e-10


def test_whitening_on_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [1.0, 7.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), ((1 << 60) + 1, [-1.0, 4.0])]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = whitening.whiten(df).collect()
    two = [r for r in got if r["n"] == 5]
    assert sorted((r["vec_id"] or 0, r["component"]) for r in two) == sorted([(i, c) for i in (0, 1, 2, 2, (1 << 60) + 1) for c in (1, 2)])
    assert all(abs(r["identity_error"]) < 1e-12 for r in two)
    want = brute_whitened([(i, v) for i, v in rows if v and len(v) == 2])
    assert all(r["deviation"] == want[r["vec_id"], r["component"]][1] for r in two)
    alone = [r for r in got if r["vec_id"] == 9]
    assert len(alone) == 3 and all(r["whitened"] is None and r["identity_error"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in alone)
    assert {r["vec_id"] for r in got} == {None, 1, 2, 9, (1 << 60) + 1}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], VECTORS)).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] is None for r in same)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], VECTORS)).collect()
    assert len(far) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in far)


# --- 12: alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(A)
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, encoding="utf-8") as file:
        name = {v: k for k, v in json.load(file)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    piece = lambda i, p: bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode()
    ends = lambda tokens: list(np.cumsum([len(t) for t in tokens]))
    docs, total = [], Counter()
    for d, text in rows:
        a = a_tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        a_bytes, b_bytes = [bytes(byte[c] for c in name[i]) for i in a], [piece(i, b_tool.id_to_piece(i)) for i in b]
        links, groups = [], []
        if text and b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            ea, eb, i, j, first = ends(a_bytes), ends(b_bytes), 0, 0, (0, 0)
            while i < len(a):
                links.append((a[i], b[j]))
                end = min(ea[i], eb[j])
                i, j = i + (ea[i] == end), j + (eb[j] == end)
                if ea[i - 1] == eb[j - 1] == end and i and j:
                    groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                    first = i, j
        else:
            a = b = []
        total.update(links)
        docs.append((d, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(d, na, nb, len(g), len(x), sum(total[k] == best[k[1]] for k in x), sum(total[k] for k in x), digest(g)) for d, na, nb, g, x in docs]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b", "a\n\nb", "a \n b\t c", "▁x", "a▁ b", "<|endoftext|> a <s> <unk> <0x0A>", "\x00a", "a\x1cb \x1d c", "\x85 x\x85y", "\xa0x y\xa0", "it's 'll don't", "éè 日本語 𝄞 x",
    "foo   bar    baz", "x" * 5000, "ﬁ ½ Å é", "​ a​b", "﻿hi", "a\r\nb", "１２３ ４５", "a" * 300 + " " + "b " * 200, "foo   bar    baz",
]
FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_PAIRS": 0, "CHUNK_PAIRS": 300, "UNIT_MEMORY": 200}])
def test_alignment_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    alignment.aligner.cache_clear()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [((1 << 60) + i if i else None, t) for i, t in enumerate(ODD)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = sorted(str(tuple(r[c] for c in FIGURES)) for r in alignment.align(df, A, B).collect())
    assert got == sorted(map(str, brute_alignment(rows)))


def test_units_are_encoded_as_in_their_text():  # a text that holds U+2581 has no tokens, so it is left out
    tool, rng = alignment.Aligner(A, B), random.Random(4)
    assert tool.b.by_word
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", " ", " ", "  ", "\n", "\t", "é", "'s", "1", "-", "\xa0", "\x1c", "日", ".", "<s>"]) for _ in range(rng.randrange(1, 40)))
        units = tool.units(text)
        assert "".join(units) == " " + text
        a, b = tool._encoded(units)
        assert [int(i) for x in a for i in x] == list(tool.a.encode(" " + text)) and [i for x in b for i in x] == tool.b.encode([text])[0]


def test_alignment_of_odd_documents(spark):
    got = {r["doc_id"]: r for r in alignment.align(clashing(odd_documents(spark)), A, B).collect()}
    assert (got[1]["n_links"], got[2]["n_links"], got[1]["groups_sha256"]) == (0, 0, "") and got[4]["n_links"] > 0
    assert alignment.align(empty_documents(spark), A, B).count() == 0


# --- 13: decontamination

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, window=10):
    words = lambda t: PART.findall((t or "").translate(LOWER))
    owners = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in owners}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in owners:
                    hit |= set(range(i, i + k))
                    found |= owners[tuple(w[i : i + k])]
        found = sorted(str(x) for x in found - {None})
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def _rows(df):
    return sorted(map(str, (tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect())))


@pytest.mark.parametrize("limits", [{}, {"WINDOW_BYTES": 10, "LEAST_BITS": 8}])
def test_contamination_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontamination, name, value)
    rng = random.Random(8)
    text = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 40]), ["w%d" % j for j in range(300)] + ["É", "Über", "x"])) for i in range(60)]
    items += [(70, "the the the the the the the the the the the the the"), (71, items[5][1].upper()), (None, "no item has these very words at all in its whole text"), (72, None), (73, " ..,"), (74, items[40][1] + " tail"), (74, "second row of it")]
    docs = [(i, text(200, ["w%d" % j for j in range(300)])) for i in range(40)]
    for i in range(60):
        t = rng.choice(items)[1] or ""
        docs.append((100 + i, f"{text(5, ['a', 'b'])}, {t[: rng.randrange(5, 400)].replace(' ', rng.choice([' ', ', ', chr(10) + '-']))} {text(6, ['a', 'b'])}"))
    docs += [(200, "the " * 500), (201, "the " * 9), (202, None), (203, ""), (204, "._ -"), (None, items[0][1]), ((1 << 60) + 1, items[1][1]), (200, "the " * 500), (205, "x" * 70_000 + " " + " ".join([items[20][1]] * 30))]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    b = clashing(spark.createDataFrame(items, "item_id long, text string")).repartition(2)
    got = _rows(decontamination.contamination(d, b))
    assert got == sorted(map(str, brute_contamination(docs, items))) and sum("True" in r for r in got) > 30


def test_contamination_on_odd_documents(spark):
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = odd_documents(spark)
    got = _rows(decontamination.contamination(clashing(docs), b))
    assert got == sorted(map(str, brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "one two")])))
    assert decontamination.contamination(empty_documents(spark), b).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, b.limit(0)).collect())
