import re
from collections import Counter
from math import log

import numpy as np
import pytest

from driftloom.llm import stupid_backoff as sb
from driftloom.llm.registry import QUERIES


def _words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[À-ÖØ-Þ]", lambda m: m.group().lower(), re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))


def _brute(docs, order, alpha=0.4, min_count=2):
    words = [(d, _words(t)) for d, t in docs]
    count = Counter()
    for _, w in words:
        for n in range(1, order + 1):
            count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def s(gram):
        if len(gram) == 1:
            return log(count[gram] / total)
        if count[gram] >= min_count:
            return log(count[gram] / count[gram[:-1]])
        return log(alpha) + s(gram[1:])

    return [(d, len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for d, w in words]


def _check(rows, want):
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_words, round(r.sum_log, 6)) for r in rows), key=str)
    assert got == sorted(((d is not None, d, n, round(s, 6) + 0.0) for d, n, s in want), key=str)
    assert all((r.score is None) == (r.n_words == 0) for r in rows)
    assert all(r.score == pytest.approx(r.sum_log / r.n_words) for r in rows if r.n_words)


def test_op9_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op9_stupid_backoff"](spark, sf_dir).collect()
    want = _brute(docs, sb.ORDER)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for d, n, s in want:
        assert got[d].n_words == n and got[d].sum_log == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_many_units(spark, sf_dir, monkeypatch, order):
    monkeypatch.setattr(sb, "UNIT_CHARS", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    got = {r.doc_id: r for r in sb.score(docs, order=order).collect()}
    for d, n, s in _brute([(r.doc_id, r.text) for r in docs.collect()], order):
        assert got[d].n_words == n and got[d].sum_log == pytest.approx(s, abs=1e-6)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op9_odd(request, which):
    docs = request.getfixturevalue(which)
    _check(sb.score(docs).collect(), _brute([(r.doc_id, r.text) for r in docs.collect()], sb.ORDER))


def test_numbers_pack():
    for x in (np.array([], np.uint64), np.array([0, 1, 2**63], np.uint64), np.arange(1000, dtype=np.uint32)):
        assert (sb.unpack_numbers(sb.pack_numbers(x), x.dtype.type) == x).all()


def test_op9_has_two_words_of_context():
    assert sb.ORDER == 3
