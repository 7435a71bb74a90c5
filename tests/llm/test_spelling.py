"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from driftloom.llm import registry, spelling

DOCS = "doc_id long, text string"


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def distance_is_one(a, b):
    """By the table of all prefixes."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def plain(rows, is_near=distance_is_one):
    words = counted(rows)
    form, near = {}, {}
    for w, n in words.items():
        around = [x for x in words if is_near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        near[w] = len(around)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def some_rows(seed, stems=12, n=150):
    rng = random.Random(seed)
    letters = "abcdeéÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(stems)]

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])

    pool = base * 40
    for _ in range(3):
        pool += [edited(rng.choice(pool)) for _ in range(60)] * 5
    return [(k, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(60))) for k in range(n)]


@pytest.mark.parametrize("few", [0, 16])
def test_equals_all_pairs(spark, monkeypatch, few):
    rows = some_rows(1)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 50)
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", 3)
    words = counted(rows)
    members = [(s, side, w, n) for w, n in words.items() for side, s in enumerate((w[: len(w) // 2], w[len(w) // 2 :]))]
    monkeypatch.setattr(spelling, "FEW", few)
    direct = {w: (k, n, f) for w, k, n, f in spelling.near_words(members, list(words))}
    want = plain(rows)
    assert {w: x[0] for w, x in direct.items()} == {r[0]: r[4] for r in want if r[4]}
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert got(spelling.variants(spark.createDataFrame(rows, DOCS))) == want


def test_odd_texts(spark, odd_docs, clashing_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(None, "letters " * 9), (None, "lettres " * 50), (3, "Lettres×÷")]
    more = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows[-3:], DOCS))
    assert got(spelling.variants(more)) == plain(rows)
    assert got(spelling.variants(clashing_docs)) == plain(rows[:-3])
    assert got(spelling.variants(no_docs)) == []


def test_checksums_are_crc32():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3000, 50)
    ends = starts + np.concatenate([rng.integers(1, 20, 45), [63, 64, 65, 66, 900]])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(50)], np.uint32)
    want = [zlib.crc32(b"%d:" % k + raw[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.checksums(raw, starts, ends, before).tolist() == want


def test_query(spark, sf_dir):
    """All words of the table, pairs by what is left without a code point."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.queries()["op13_spelling_halves"](spark, sf_dir)) == plain(rows, spelling_near)


def spelling_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:]
