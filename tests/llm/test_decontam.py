import random
import re

import numpy as np
import pytest

from driftloom.llm import decontam
from driftloom.llm.registry import QUERIES


def _words(text):
    return re.findall(r"[a-z0-9\u0080-￿]+", (text or "").lower())


def _shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _overlap(part, document):
    own = _words(part)
    k = min(5, len(own))
    wanted = _shingles(own, k)
    return len(wanted & _shingles(document, k)) / len(wanted) if wanted else 1.0


def _brute(docs, items):
    out = set()
    for d, text in docs:
        words = _words(text)
        for i, item in items:
            if len(_words(item)) < 5:
                if _words(item) and _words(item) == words:
                    out.add((d, i))
                continue
            q, a = decontam.split_item(item)
            if _overlap(item, words) >= 0.8 or (_overlap(q, words) >= 0.8 and _overlap(a, words) >= 0.8):
                out.add((d, i))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op10_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = QUERIES["op10_bm25_decontamination"](spark, path).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got) == len(rows) and got == _brute(docs, items) and got
    assert all(0 < r.score <= 1 + 1e-9 for r in rows)


def test_wand_finds_what_full_scores_find():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (1 + k) for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 40)))) for k in range(500)]
    index = decontam.build_index(items)
    for _ in range(150):
        own = sorted(rng.sample(range(len(index.terms)), rng.randint(1, min(60, len(index.terms)))))
        threshold = rng.choice([0.05, 0.2, 0.4])
        keys = [int(index.terms[t]) for t in own]
        want = [k for k, item in enumerate(index.items) if sum(item.impacts.get(t, 0.0) / item.least for t in keys) >= threshold - 1e-9]
        assert decontam.block_max_wand(index, own, threshold) == want


def test_edited_and_cut_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(k, " ".join(word() for _ in range(40)) + ". " + " ".join(word() for _ in range(8)) + ".") for k in range(30)]
    items += [(100, "What is the capital of the country? It is a city."), (101, "too short item"), (102, None), (103, "")]
    docs = []
    for k in range(30):
        words = items[k][1].split()
        if k % 3 == 1:
            words[20] = "edited"
        if k % 3 == 2:
            words = words[:15]
        filler = [word() for _ in range(rng.randint(0, 400))]
        docs.append((k, " ".join(filler + words + [word() for _ in range(rng.randint(0, 300))])))
    docs += [(200, "they ask what is the capital of the country it is a city they say"), (201, "too short item"), (202, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()}
    assert got == _brute(docs, [i for i in items if i[1]]) and len(got) == 22 and (201, 101) in got
    kept = {r.doc_id for r in decontam.keep_clean(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got}


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op10_odd(spark, request, which):
    docs = request.getfixturevalue(which)
    items = spark.createDataFrame([(1, "the same words again and again"), (2, "word word word word word word"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert got == ({(7, 2), (9, 1), (10, 1)} if docs.count() else set())
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == max(0, docs.count() - 3)
    none = items.filter("false")
    assert decontam.leaks(docs, none).count() == 0 and decontam.keep_clean(docs, none).count() == docs.count()


def test_many_indexes_find_the_same(spark, monkeypatch):
    path = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    clean = {r.doc_id for r in decontam.keep_clean(docs, items).collect()}
    monkeypatch.setattr(decontam, "INDEX_CHARS", 2_000)
    assert decontam.indexes(items)[0] > 1
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == one
    assert {r.doc_id for r in decontam.keep_clean(docs, items).collect()} == clean


def test_cut_items_of_unequal_words(spark):
    """Cuts that leave 0.8 of the shingles but take the rare words, the most of the BM25 weight."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(12)]
    items = []
    for k in range(40):
        words = rng.choices(common, k=64)
        items.append((k, " ".join(words[:48] + [f"rare{k}x{j}" for j in range(12)] + words[48:52])))
    items.append((50, "the short one"))
    docs = [(k, " ".join(rng.choices(common, k=rng.randint(0, 300)) + t.split()[: 64 - 12] + rng.choices(common, k=90))) for k, t in items]
    docs += [(100 + k, " ".join(t.split()[:48])) for k, t in items] + [(200, "The short, ONE!"), (201, "the short one more")]
    long = [" ".join(t.split()[:30] + [f"in{j}" for j in range(60)] + t.split()[30:]) for _, t in items[:9]]
    docs += [(300 + k, " ".join(rng.choices(common, k=17 * k) + t.split())) for k, t in enumerate(long)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()}
    assert got == _brute(docs, items) and (200, 50) in got and (201, 50) not in got
    assert {x for x, _ in got} >= {300 + k for k in range(9)}


def test_grams_are_of_runs():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(decontam.grams(h, 5)) == 4 and len(decontam.grams(h, 9)) == 0
    assert decontam.grams(h, 3)[2] == decontam.grams(h[2:5], 3)[0]
