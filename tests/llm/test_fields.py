import re
import zlib
from itertools import product

import numpy as np
import pytest

from driftloom.llm import crf, langid, toxicity
from driftloom.llm.registry import QUERIES
from driftloom.llm.words import Words

SF = "/root/testdata/sf0.01"


def test_words_and_hashes():
    texts = ["Die Ärzte, die ärzte!", "", "x" * 70_000 + " die", "déjà-vu 12 a1b"]
    w = Words(texts)
    got = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == ["die", "ärzte", "die", "ärzte", "x" * 70_000, "die", "déjà", "vu", "a", "b"]
    assert w.doc.tolist() == [0, 0, 0, 0, 2, 2, 3, 3, 3, 3] and w.counts.tolist() == [4, 0, 2, 4]
    h = dict(zip(got, w.hashes(), strict=True))
    assert [h[x] for x in got] == w.hashes().tolist() and len(set(h.values())) == len(h)
    assert Words(["zzz déjà"]).hashes()[1] == h["déjà"]


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    moves, begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(5, 2, 3)).astype(np.float32)
    used = np.ones((5, 2), bool)
    used[3:, 1] = False
    got = crf.forward_backward(scores, used, moves, begin)
    _, pair = crf._expected(scores, used, moves, begin)
    pairs = np.zeros((3, 3))
    for chain in range(2):
        n = int(used[:, chain].sum())
        want, total = np.zeros((n, 3)), 0.0
        own = np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            s = begin[path[0]] + sum(scores[t, chain, y] for t, y in enumerate(path))
            s = np.exp(s + sum(moves[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
            total += s
            for t, y in enumerate(path):
                want[t, y] += s
            for a, b in zip(path[:-1], path[1:], strict=True):
                own[a, b] += s
        np.testing.assert_allclose(got[:n, chain], want / total, rtol=1e-4)
        pairs += own / total
    np.testing.assert_allclose(pair, pairs, rtol=1e-4)


def test_long_texts_are_one_chain(monkeypatch):
    """Marginals don't depend on how a text's words are dealt to blocks."""
    rng = np.random.default_rng(5)
    for n in (2, 3, 5):
        counts = np.array([1, 4, 5, 0, 8, 29, 40, 3, 12])
        model = crf.Model([""] * n, np.zeros((n, 1)), 2 * rng.normal(size=(n, n)).astype(np.float32), rng.normal(size=n).astype(np.float32))
        scores = rng.normal(size=(int(counts.sum()), n)).astype(np.float32)
        want = model.marginals(scores, counts)
        for size in (1, 2, 4, 7):
            monkeypatch.setattr(crf, "CHAIN", size)
            np.testing.assert_allclose(model.marginals(scores, counts), want, atol=1e-5)
        monkeypatch.undo()


def test_op5_learns_every_language(spark):
    """Far more languages than any table of codes in common use has in one corpus."""
    rng = np.random.default_rng(6)
    letters = [chr(x) for x in range(ord("a"), ord("z") + 1)]
    rows = []
    for lang in range(70):
        words = ["".join(rng.choice(letters, 6)) for _ in range(8)]
        rows += [(10 * lang + k, " ".join(rng.choice(words, 12)), f"l{lang}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.95


def test_identified_rows_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the words of a text", "en"), (2, "die worte des textes", "de")], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    docs = docs.withColumns({n: F.lit("KEEP") for n in (*langid.ADDED, "a.b")})
    rows = langid.keep_identified(docs).collect()
    assert len(rows) == 2 and all(r[n] == "KEEP" for r in rows for n in (*langid.ADDED, "a.b"))


def test_op5_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_language_crf"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5_code_switched(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    text = {r.lang: r.text for r in docs.filter("n_chars between 1500 and 4000").orderBy("doc_id").collect()}
    mixed = " ".join(text["de"].split()[:100] + text["fr"].split()[:60])
    (name,), (score,), (switches,) = langid.label_texts(model, [mixed])
    assert name == "de" and 0.5 < score < 0.75 and 1 <= switches <= 12


@pytest.mark.parametrize("which", ["odd_docs", "clashing_docs"])
def test_op5_odd(request, which):
    docs = request.getfixturevalue(which)
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(rows) == docs.count()
    lettered = {r.doc_id: any(map(str.isalpha, r.text or "")) for r in docs.collect()}
    assert all((r.lang_pred == "und") == (not lettered[d]) for d, r in rows.items())


def test_op5_empty(no_docs):
    assert langid.identify(no_docs).count() == 0
    assert langid.keep_identified(no_docs).count() == 0


def test_op5_without_labels(odd_docs):
    from pyspark.sql import functions as F

    rows = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_op6_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_toxicity_crf"](spark, SF).collect()
    assert len(rows) == len(text)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    spans = [text[r.doc_id][int(a) : int(b)] for r in rows for a, b in re.findall(r"(\d+):(\d+)", r.spans)]
    assert spans and all(re.match(r"\w", s) and re.search(r"\w$", s) for s in spans)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op6_odd(spark, request, which):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (7, 0), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.assess(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.assess(docs, labels.filter("false")).collect()
    assert len(none) == docs.count()


def test_op6_spans_are_code_points(spark):
    rows = [(k, f"nice words é{k} here " + ("lowword horrid stuff" if k % 3 == 0 else "plain stuff")) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    out = toxicity.assess(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in out)
    for r in out:
        text = rows[r.doc_id][1]
        got = [text[int(a) : int(b)] for a, b in re.findall(r"(\d+):(\d+)", r.spans)]
        assert got == (["lowword horrid"] if r.predicted else [])
