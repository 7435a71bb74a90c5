"""Repeated passages against plain counts of every window."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from driftloom.llm import repeats

DOCS = "doc_id long, text string"


def plain(rows, keep, window=repeats.WINDOW):
    """doc_id to spans: every window of every text in a dictionary."""
    docs = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    seen = defaultdict(list)
    for k in order:
        for a in range(len(docs[k][1]) - window + 1):
            seen[docs[k][1][a : a + window]].append((docs[k][0], hash(docs[k][1]), a, k))
    out = []
    for k, (i, body) in enumerate(docs):
        hit = np.zeros(len(body) + 1, int)
        for a in range(len(body) - window + 1):
            places = seen[body[a : a + window]]
            # with "first", rows equal in id and text are one document
            earlier = any(p[0] != i or p[2] < a for p in [places[0]]) if keep == "first" else len(places) > 1
            if earlier:
                hit[a] += 1
                hit[a + window] -= 1 if a + window <= len(body) else 0
        covered = np.cumsum(hit)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append((i, body, [tuple(map(int, e)) for e in edges.reshape(-1, 2)]))
    return out


def some_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    line = prose(22)
    out = []
    for k in range(n):
        kind = k % 6
        if kind == 0:
            out.append(prose(rng.randint(5, 90)))
        elif kind == 1:
            out.append(prose(20) + rng.choice(shared) + prose(20))
        elif kind == 2:
            words = rng.choice(shared).split() * 2
            words[rng.randrange(len(words))] = "X"
            out.append(" ".join(words))
        elif kind == 3:
            out.append(prose(15) + line + prose(15))
        elif kind == 4:
            out.append(line[: rng.randint(1, len(line))] * 3)
        else:
            out.append(rng.choice(out))
    return out


def got(found):
    return sorted(((r.doc_id, bytes(r.body), [(s.start, s.end) for s in r.spans]) for r in found.collect()), key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equals_every_window(spark, keep):
    rows = list(enumerate(some_texts(1)))
    assert got(repeats.find(spark.createDataFrame(rows, DOCS), keep)) == sorted(plain(rows, keep), key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_grams_are_split(spark, monkeypatch, keep):
    monkeypatch.setattr(repeats, "GROUP", 3)
    rows = list(enumerate(some_texts(2, 90)))
    assert got(repeats.find(spark.createDataFrame(rows, DOCS), keep)) == sorted(plain(rows, keep), key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_odd_texts(spark, odd_docs, clashing_docs, no_docs, keep):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(plain(rows, keep), key=str)
    assert got(repeats.find(odd_docs, keep)) == want
    assert got(repeats.find(clashing_docs, keep)) == want
    assert got(repeats.find(no_docs, keep)) == []


def test_repeated_rows(spark):
    text = some_texts(3, 1)[0] * 9
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text + "!")]
    df = spark.createDataFrame(rows, DOCS)
    for keep in ("none", "first"):
        assert got(repeats.find(df, keep)) == sorted(plain(rows, keep), key=str)


def test_texts_beyond_a_block(spark, monkeypatch):
    """A text cut into blocks has the anchors of the whole one."""
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = repeats.anchors(raw, np.array([len(raw)]))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    for a, b in zip(whole, repeats._long(raw), strict=True):
        assert (a == b).all()


def test_factor_array_equals_all_pairs():
    rng = random.Random(5)
    for size in (1, 2, 9, 80):
        text = bytes(rng.choice(b"ab") for _ in range(size))
        order = sorted(range(size), key=lambda i: text[i:])
        shared = lambda i, j: next((k for k in range(size) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= size or j + k >= size), size)  # noqa: E731, B023
        lcp = np.array([0, *(shared(a, b) for a, b in zip(order, order[1:], strict=False))])
        factor = repeats.longest_previous(np.array(order), lcp)
        for k, i in enumerate(order):
            assert factor[k] == max([0, *(shared(i, j) for j in range(i))])


def test_query(spark, sf_dir):
    from driftloom.llm import registry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {}
    for i, body, spans in plain(rows, "none"):
        kept = b"".join(body[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(body)], strict=True))
        want[i] = (len(body), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())
    query = registry.queries()["op11_longest_previous_factor"](spark, sf_dir)
    result = query.collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result} == want
    assert sum(w[1] for w in want.values()) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    relation = con.sql(registry.oracle_sql()["op11_longest_previous_factor"])
    assert relation.columns == query.columns
    assert sorted(relation.fetchall()) == sorted(tuple(r) for r in result)
