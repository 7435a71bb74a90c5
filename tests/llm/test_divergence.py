"""The audit of sources against SQL and plain counts."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from driftloom.llm import divergence, registry, slices

ROWS = "text string, lang string, source string"


def plain(rows, top=divergence.TOP):
    docs = [((t or "").translate({c: c + 32 for c in range(65, 91)}), g or "", s or "") for t, g, s in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in docs]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, g, s), w in zip(docs, terms, strict=True):
        df[g].update(set(w))
        counts[g, s].update(w)
    out = []
    for lang in df.keys() | {g for _, g, _ in docs}:
        kept = sorted(w for w, n in df[lang].items() if n >= 3)
        sources = sorted(s for g, s in counts if g == lang)
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            mine = [(gap(p[s][w], whole[w]), w) for w in kept if counts[lang, s][w] and p[s][w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", mine, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def some_rows(seed, n=80):
    rng = random.Random(seed)
    words = ["Ab", "ab", "x", "É", "é", "éa", "你好", "z" * 40, "don", "t", "q1q", "[b]", "Ünter"] + [chr(97 + k) * 3 for k in range(20)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "S2", "é", None])) for _ in range(n)]
    return [*rows, (None, "en", "s0"), ("", "de", "only"), ("\x00 a\x7fb", "de", "two"), ("aa 12", "es", "alone")] + rows[:5]


@pytest.mark.parametrize("terms", [4, 50_000])
def test_equals_plain_counts(spark, monkeypatch, terms):
    monkeypatch.setattr(divergence, "BUCKET_TERMS", terms)
    rows = some_rows(1)
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, ROWS)).collect()) == plain(rows)


def test_ranks_end_at_the_top(spark):
    rows = some_rows(2)
    got = divergence.audit(spark.createDataFrame(rows, ROWS), top=2).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 2)


def test_odd_texts(spark, odd_docs, clashing_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    for docs in (odd_docs, clashing_docs):
        assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)
    assert divergence.audit(no_docs).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = registry.queries()["op12_source_divergence"](spark, sf_dir)
    want = con.sql(registry.oracle_sql()["op12_source_divergence"])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_shares_of_large_counts():
    count, total = np.array([0, 5, 10**15, 10**16]), 3 * 10**16
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // total for c in count.tolist()]


def test_hash_is_xxh64():
    rng = np.random.default_rng(1)
    for size in range(32):
        rows = rng.integers(0, 256, (7, size)).astype(np.uint8)
        assert slices.short_hashes(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def test_unlike_slices_of_one_hash_stay_apart(monkeypatch):
    raw = np.frombuffer(b"abcabdabcxyz", np.uint8)
    starts = np.arange(0, 12, 3)
    monkeypatch.setattr(slices, "short_hashes", lambda rows: np.zeros(len(rows), np.uint64))
    first, number = slices.distinct(raw, starts, starts + 3)
    assert len(first) == 3 and number[0] == number[2] and len(set(number.tolist())) == 3
