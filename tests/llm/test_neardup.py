import random
from collections import Counter, defaultdict
from math import ceil, comb

import numpy as np
import pytest

from driftloom.llm import neardup
from driftloom.llm.registry import QUERIES
from driftloom.llm.words import Words


def _multiset(text):
    h, _ = neardup.shingle_hashes(Words([text or ""], digits=True))
    return np.unique(h, return_counts=True)


def _brute(rows):
    """Classes by all pairs that share a shingle; rows are (doc_id, text)."""
    sets = {d: _multiset(t) for d, t in rows}
    text = dict(rows)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    where, plain = defaultdict(list), defaultdict(list)
    for d, (h, _) in sets.items():
        for x in h.tolist():
            where[x].append(d)
        if not len(h):
            plain[text[d] or ""].append(d)
    shared = Counter()
    for own in where.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                shared[b, a] += 1
    for (a, b), n in shared.items():
        if n >= 0.2 * min(len(sets[a][0]), len(sets[b][0])) and neardup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
            join(a, b)
    for own in plain.values():
        for b in own:
            join(own[0], b)
    return {d: root(d) for d, _ in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op1_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op1_bagminhash"](spark, path).collect()}
    assert got == _brute(rows)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_of_copies(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(220)]
        rows += [" ".join(base)] * 2 + [_edited(rng, base, n) for n in range(1, 8 if group else 100)]
        if group == 0:
            rows += [_edited(rng, base, 5) for _ in range(150)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(150)]
    rows += ["the same line " * 40, "the same line " * 60, "the same line " * 45]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == _brute(rows)
    kept = [r.doc_id for r in neardup.keep_one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_strays_try_all_their_partners(spark, monkeypatch):
    """Each stray is just apart from 120 copies, and near one text that needn't agree with it most."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]

    def text(edits):
        return " ".join(edits.get(k, w) for k, w in enumerate(base))

    rows = [text({rng.choice(range(205, 395, 10)): f"copy{k}"}) for k in range(120)]
    for k in range(10):
        own = {at: f"own{k}at{at}" for at in (5 + 6 * k, *rng.sample(range(65, 195, 6), 7))}
        rows += [text(own), text({5 + 6 * k: own[5 + 6 * k]})]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    want = _brute(rows)
    assert len(set(want.values())) == 1 and got == want


def test_similar_pairs_agree_enough():
    m = neardup.REGISTERS
    least = ceil(m * neardup.LEAST_AGREEMENT - 1e-9)
    assert sum(comb(m, k) * 0.8**k * 0.2 ** (m - k) for k in range(least)) < 1e-6


@pytest.mark.parametrize("weights", [(1, 1), (3, 1), (6, 9), (1000, 700)])
def test_registers_agree_as_often_as_weights_overlap(weights):
    rng = np.random.default_rng(4)
    agree = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 50, dtype=np.uint64)
        b = np.concatenate([a[:35], rng.integers(0, 2**63, 15, dtype=np.uint64)])
        r = neardup.bag_min_hash(np.concatenate([a, b]), np.repeat(weights, 50), np.repeat([0, 1], 50), 2)
        agree.append((r[0] == r[1]).mean())
    low, high = min(weights), max(weights)
    assert abs(np.mean(agree) - 35 * low / (35 * high + 15 * (low + high))) < 0.025


def _block(rows):
    """Rows: (component, stray, bands, registers, text)."""
    import pyarrow as pa

    return pa.table(
        {
            "band": pa.array([rows[0][2][0]] * len(rows)),
            "component": pa.array([r[0] for r in rows], pa.binary()),
            "stray": [r[1] for r in rows],
            "bands": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            "sig": pa.array([bytes(r[3]) for r in rows], pa.binary()),
            "size": pa.array([len(_multiset(r[4])[1]) for r in rows], pa.int64()),
            "text": [r[4] for r in rows],
        }
    )


def test_a_block_passes_over_no_pair():
    """Thirty decoys agree with the stray more than its one similar partner does."""
    words = [f"w{k}" for k in range(300)]
    near = " ".join(words[:-3])
    decoys = [" ".join(words[:200] + [f"d{n}x{k}" for k in range(100)]) for n in range(30)]
    most = neardup.REGISTERS * (1 - neardup.LEAST_AGREEMENT)
    sig = lambda off: [1] * off + [0] * (neardup.REGISTERS - off)
    bands = [7, *range(100, 100 + neardup.BANDS - 1)]
    rows = [(b"a%d" % k, False, bands, sig(k), t) for k, t in enumerate(decoys)]
    rows += [(b"b", False, bands, sig(int(most)), near), (b"x", False, bands, sig(0), " ".join(words)), (b"x", True, bands, sig(0), " ".join(words))]
    assert neardup.block_links(_block(rows)) == [(32, 30)]


def test_unlike_texts_may_share_an_id(spark):
    a, b, c = ("alpha " * 3 + f"{x} one two three four five six {x} seven" for x in "abc")
    rows = [(5, a), (5, b), (6, a), (7, b), (8, c), (None, "all alone here in the dark"), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()]
    of = {d: {c for e, c in got if e == d} for d, _ in got}
    assert len(got) == 7 and len(of[5]) == 2 and 5 in of[5] and len(of[6]) == len(of[7]) == 1
    assert of[6] | of[7] == of[5] and of[6] != of[7] and of[8] == {8} and min(of[None]) < 0
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one_of_each(docs).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (8, c), (None, "all alone here in the dark")], key=str)


def test_names_that_clash(spark):
    from pyspark.sql import functions as F

    names = ["key", "KEY_", "doc", "h1", "h2", "node", "component", "a.b", "chars", "size", "bands", "sig", "driftloom_doc", "none", "r"]
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    docs = docs.withColumns({n: F.lit("x") for n in names})
    (row,) = neardup.keep_one_of_each(docs).collect()
    assert row.doc_id == 1 and row.asDict() == {"doc_id": 1, "text": row.text, **dict.fromkeys(names, "x")}
    assert neardup.classes(docs).count() == 2


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op1_odd(request, which):
    docs = request.getfixturevalue(which)
    rows = neardup.classes(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r.class_id for r in rows}
    if rows:
        # null and empty, blank, and the two equal texts
        assert by_id[0] == by_id[1] and by_id[9] == by_id[10] and by_id[2] != by_id[0]
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(by_id.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
