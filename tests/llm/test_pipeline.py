"""The corpus pipeline: every stage does its work on what its predecessor kept."""

import hashlib
import re
from collections import Counter

import numpy as np
import regex
from tokenizers import Tokenizer

import corpus_pipeline as P
from feedloom.llm import common, language, near_dedup, quality
from feedloom.llm.queries import tokenizer_path
from tests.llm.test_training_operators import WORD, brute_groups, odd_documents

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in P.STAGES[:-1]:
        kept.append(P.written(stage(spark, kept[-1], FOLDER)))
        assert kept[-1].columns == columns, name
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4]
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    assert len(good - ids[1]) <= 0.02 * len(good)
    rows = [(r["doc_id"], r["text"]) for r in kept[2].select("doc_id", "text").collect()]
    assert ids[3] == {d for d, _, c in brute_groups(rows, 5, 80) if d == c}
    words = lambda df: sum(len(WORD.findall(r["text"])) for r in df.select("text").collect())
    assert abs(words(kept[4]) - 1.5 * words(kept[3])) <= 20
    pieces = P.STAGES[-1][1](spark, kept[4], FOLDER).collect()
    full = {}
    for r in pieces:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 4096 for s, n in full.items() if s != max(full)) and {r["doc_id"] for r in pieces} == ids[4]
    assert tokenizer_path().endswith(".json")


def test_odd_documents(spark):
    docs = odd_documents(spark)
    left = P.near_deduplicated(spark, docs, FOLDER)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert P.near_deduplicated(spark, docs.limit(0), FOLDER).count() == 0 and P.mixed(spark, docs.limit(0), FOLDER).count() == 0


def test_shared_ids_are_no_copies(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, "a"), (None, "b"), (None, "a"), (5, "c"), (5, "d"), (5, "d"), (1, "e"), (7, "e"), (7, "f"), (None, "f"), (9, "c")]
    docs = [(d, text(k), "en", "s", 1) for d, k in rows] + [(None, "", "en", "s", 0), (None, "", "en", "s", 0), (None, " ", "en", "s", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = P.near_deduplicated(spark, docs, FOLDER)
    got = sorted((r["doc_id"] or 0, r["text"][:1]) for r in left.collect())
    assert left.columns == docs.columns and got == [(0, ""), (0, " "), (0, "a"), (0, "b"), (1, "e"), (5, "c"), (5, "d"), (7, "f")]


def test_shared_ids_beyond_what_is_broadcast(spark, monkeypatch):
    for module in (common, near_dedup, P):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "PER_SALT", 2)
    test_shared_ids_are_no_copies(spark)


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in P.STAGES[:-1]:
        left = P.written(stage(spark, docs, FOLDER))
        assert left.columns == docs.columns and left.count() <= 3 * docs.count(), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    pieces = P.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


def test_a_document_taken_in_part_keeps_its_line_breaks(spark):
    text = " one\ttwo\n\nthree  four\x0bfive \n six" * 9
    docs = spark.createDataFrame([(i, text, "en", s, len(text)) for i in range(7) for s in ("a", "b", "c")], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.mixed(spark, docs, FOLDER).collect()
    assert all(text.startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows) and any(r["text"] != text for r in rows)


def test_run_writes_each_stage_and_leaves_the_last_to_read(spark):
    pieces = P.run(spark, FOLDER).collect()
    assert pieces and all(r["length"] <= 4096 for r in pieces)


# --- every stage against a plain version of what it decides, on the rows its predecessor kept


def plain_quality(spark, docs):
    weights = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = []
    for r in docs.collect():
        f = quality.hashed_features([r["text"]])[0]
        at, n = np.unique(f, return_counts=True)
        if weights[-1] + (weights[at] * np.sqrt(n / max(1, len(f)))).sum() >= 0:
            kept.append(tuple(r))
    return kept


def plain_language(docs):
    model, kept = language.train(docs), []
    for r in docs.collect():
        text = r["text"]
        if text is None or not regex.search(r"\p{L}", text):
            continue
        data = [c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()]
        grams = {}
        for size, tag in ((1, 25), (2, 26), (3, None)):
            for at in range(len(data) - size + 1):
                g = data[at : at + size]
                if any(c != 32 for c in g):
                    h = ((int.from_bytes(bytes(g), "big") + (1 << tag if tag else 0)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)
                    grams[h] = grams.get(h, 0) + 1
        v = {h: np.log1p(c) * model.idf[h] for h, c in grams.items()}
        norm = max(np.sqrt(sum(x * x for x in v.values())), 1e-12)
        cosine = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        floor = model.floors[best][sum(bound < len(text.strip()) for bound in language.LENGTHS)]
        if cosine[best] >= floor:
            kept.append((tuple(r), abs(cosine[best] - floor)))
    return kept


def plain_mixture(docs):
    """Times and cuts of each document by filling sources one after another until none is above its cap."""
    rows = docs.collect()
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in enumerate(rows)}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    capped, left = {}, 1.5 * sum(total.values())
    while True:
        open_ = [s for s in sources if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * total[s]
            left -= capped[s]
    target = capped | share
    out = []
    for s in sources:
        mine = [i for i, r in enumerate(rows) if r["source"] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        need = int(target[s] - whole * total[s] + 0.5)
        for i in sorted(mine, key=lambda i: hashlib.md5(f"20240601:{rows[i]['doc_id']}".encode()).hexdigest()[:15]):
            more = min(need, size[i])
            need -= more
            out += [(rows[i]["doc_id"], rows[i]["text"])] * (whole if size[i] else 0)
            if more:
                words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", rows[i]["text"])
                out.append((rows[i]["doc_id"], rows[i]["text"] if more == size[i] else "".join(words[:more])))
    return out


def test_every_stage_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(P.STAGES)
    good = P.written(stages["quality classifier"](spark, docs, FOLDER))
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(good.collect()) == text(plain_quality(spark, docs))
    known = P.written(stages["language identification"](spark, good, FOLDER))
    sure = plain_language(good)
    got = text(known.collect())
    assert {tuple(map(str, r)) for r, by in sure if by > 1e-3} <= set(got) and len(got) <= len(sure) + sum(by <= 1e-3 for _, by in sure)
    one = P.written(stages["MinHash near-dedup"](spark, known, FOLDER))
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _, c in brute_groups(rows, 5, 80) if d == c)
    mix = P.written(stages["mixing to target weights"](spark, one, FOLDER))
    assert sorted((r["doc_id"], r["text"]) for r in mix.collect()) == sorted(plain_mixture(one))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in mix.collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        want[r["doc_id"], len(ids)] += len(ids)
    got, full = Counter(), Counter()
    for r in stages["packing"](spark, mix, FOLDER).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        full[r["sequence_id"]] += r["length"]
    assert got == want and sorted(full) == list(range(len(full))) and all(n == 4096 for s, n in full.items() if s < len(full) - 1)
