"""Toxic spans in text, with a conditional random field over tokens.

Labels say which documents are toxic, not where.  Tokens of toxic documents are
labelled first by the words and word beginnings that toxic documents have and others
don't; the field is fitted to that (tags O, B, I), labels the toxic documents anew,
and is fitted once more.  Forward-backward marginals of B and I are a token's
toxicity; a document's score is its most toxic token's, put on the scale of a
probability by a logistic fit over the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from driftloom.llm import crf
from driftloom.llm.common import limit_threads, map_rows, wider
from driftloom.llm.langid import drawn, in_order, remainder
from driftloom.llm.words import Words, grouped

#: Documents of each label that a model is fitted on, about.
TRAIN_PER_LABEL = 1500
#: Words of clean text in the training chains, at most.
CLEAN_WORDS = 150_000
O, B, I = 0, 1, 2
#: Lengths of word beginnings that may mark a token.
_PREFIXES = (4, 5, 6, 0)
#: Toxicity from which a token counts as an offending one.
TOKEN_THRESHOLD = 0.5


@dataclass
class ToxicityModel:
    field: crf.Model
    slope: float
    shift: float


def _keys(words: Words, prefix: int) -> np.ndarray:
    """A number per word: of its first ``prefix`` bytes, or of the whole word (0)."""
    if prefix == 0:
        return words.hashes()
    padded = np.concatenate([words.bytes, np.full(prefix, 32, np.uint8)])
    out = np.zeros(len(words.starts), np.uint64)
    for k in range(prefix):
        inside = words.starts + k < words.ends
        out = out << np.uint64(8) | np.where(inside, padded[words.starts + k], 32).astype(np.uint64)
    return out


def seed_marks(words: Words, toxic: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Tokens that best explain why their documents are toxic.

    Words and beginnings that toxic documents have far more often than others share
    each toxic document's label by their strength, and a key's strength is what it has
    got from all documents; so rare words that merely stand beside frequent toxic ones
    lose their part.
    """
    mark = np.zeros(len(words.starts), bool)
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    keys, docs, numbers, total = [], [], [], 0
    for prefix in _PREFIXES if len(mark) else ():
        values, number = np.unique(_keys(words, prefix), return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * words.n_texts + words.doc)
        of, doc = pairs // words.n_texts, pairs % words.n_texts
        in_toxic = np.bincount(of[toxic[doc]], minlength=len(values))
        in_clean = np.bincount(of[~toxic[doc]], minlength=len(values))
        lift = (in_toxic / n_toxic) / ((in_clean + 0.5) / n_clean)
        good = (in_toxic >= 3) & (lift >= 8)
        rank = np.where(good, np.cumsum(good) - 1 + total, -1)
        use = good[of] & toxic[doc]
        keys.append(rank[of[use]])
        docs.append(doc[use])
        numbers.append(rank[number])
        total += int(good.sum())
    if not total:
        return mark
    key, doc = np.concatenate(keys), np.concatenate(docs)
    count = np.bincount(key, minlength=total)
    strength = count.astype(float)
    for _ in range(rounds):
        weight = strength[key]
        share = weight / np.bincount(doc, weights=weight, minlength=words.n_texts)[doc]
        strength = np.bincount(key, weights=share, minlength=total)
    strong = (strength >= 0.05 * count) & (strength >= 0.7)
    for number in numbers:
        mark |= (number >= 0) & strong[number] & toxic[words.doc]
    return mark


def _chains(words: Words, mark: np.ndarray, toxic: np.ndarray, seed: int) -> tuple[list, list]:
    """All chains with a marked token, and clean ones up to ``CLEAN_WORDS`` words."""
    rng = np.random.default_rng(seed)
    _, (chain, _) = crf.chain_places(words.counts)
    n = int(chain[-1]) + 1 if len(chain) else 0
    marked = np.bincount(chain[mark], minlength=n) > 0
    first = np.searchsorted(chain, np.arange(n + 1))
    clean = np.flatnonzero(~toxic[words.doc[first[:-1]]]) if n else np.zeros(0, int)
    rng.shuffle(clean)
    sizes = np.cumsum(first[clean + 1] - first[clean]) if len(clean) else np.zeros(0)
    use = np.concatenate([np.flatnonzero(marked), clean[sizes <= CLEAN_WORDS]]).astype(int)
    begins = mark & ~np.concatenate([[False], mark[:-1] & (chain[1:] == chain[:-1])]) if len(mark) else mark
    tag = np.where(mark, np.where(begins, B, I), O)
    return [np.arange(first[k], first[k + 1]) for k in use], [tag[first[k] : first[k + 1]] for k in use]


def _top(model: crf.Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each token's toxicity, and the log-odds of each document's most toxic one."""
    emissions = model.emissions(words)
    gamma = model.marginals(emissions, words.counts)
    p = 1.0 - gamma[:, O].astype(np.float64) if len(gamma) else np.zeros(0)
    top = np.full(words.n_texts, 1e-6)
    if len(p):
        np.maximum.at(top, words.doc, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return p, np.log(top / (1 - top))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the label's log-odds, by damped Newton steps."""
    if not len(y) or y.all() or not y.any():
        return 1.0, 0.0
    weight = np.full(len(y), 1.0 / len(y))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.05), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> ToxicityModel:
    """Fit on a sample of ``labels`` (doc_id, toxic 0 or 1), with the texts of ``docs`` (doc_id, text).

    The sample's ids, ``4 * per_label`` at most, go to the texts.
    """
    ids = drawn(labels.filter(F.col("toxic").isin(0, 1)), "toxic", per_label)
    found = docs.filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    rows = in_order(found.orderBy(F.xxhash64("doc_id", "text")).limit(4 * per_label).collect(), "toxic")
    words = Words([r["text"] for r in rows])
    toxic = np.array([r["toxic"] == 1 for r in rows], dtype=bool)
    mark = seed_marks(words, toxic)
    model = crf.fit(words, *_chains(words, mark, toxic, 1), ["O", "B", "I"], epochs=3)
    if mark.any():
        p, _ = _top(model, words)
        again = (p >= TOKEN_THRESHOLD) & toxic[words.doc]
        if again.any():
            model = crf.fit(words, *_chains(words, again, toxic, 2), ["O", "B", "I"], epochs=3)
    _, top = _top(model, words)
    return ToxicityModel(model, *_logistic(top, toxic))


def score_texts(model: ToxicityModel, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text, and its offending spans in code points (ends exclusive)."""
    scores = np.zeros(len(texts))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in grouped(texts):
        words = Words(texts[a:b])
        p, top = _top(model.field, words)
        scores[a:b] = 1 / (1 + np.exp(-np.clip(model.slope * top + model.shift, -30, 30)))
        hits = np.flatnonzero(p >= TOKEN_THRESHOLD)
        if not len(hits):
            continue
        points = words.code_points()
        previous = -2
        for k in hits.tolist():
            doc = int(words.doc[k])
            base = points[words.text_starts[doc]]
            own, span = spans[a + doc], (int(points[words.starts[k]] - base), int(points[words.ends[k]] - base))
            if own and k == previous + 1:
                own[-1] = (own[-1][0], span[1])
            else:
                own.append(span)
            previous = k
    return scores, spans


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds tox_score and tox_spans (array of start, end) to every row of ``docs``, from ``text`` alone.

    A null text counts as empty; without words the score is that of no toxic token.
    All rows and columns stay, repeated ones too; columns of these names are replaced.
    """
    names = ("tox_score", "tox_spans")
    kept = docs.drop(*names)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                scores, spans = score_texts(own.value, [t or "" for t in batch.column("text").to_pylist()])
                found = [[{"start": s, "end": e} for s, e in x] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(scores), pa.array(found, kind)], [*batch.schema.names, *names]
                )

    span = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))
    return map_rows(kept, run, wider(kept.schema, tox_score="double", tox_spans=span))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every row of ``docs``: doc_id, held_out, score, predicted, spans.

    Learns from ``labels`` (doc_id, toxic) whose id isn't held out (remainder 0 of 5).
    Repeated labels of an id count once, a disputed one as toxic; a null id is neither
    held out nor learned from.  A null text counts as empty, and has no spans.  Rows that
    repeat each have their row; other columns are left out, whatever their names; no rows
    of ``docs``, no result, and without labels a score says only that nothing was learned.
    """
    held = remainder("doc_id", 5) == 0
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(docs.select("doc_id", "text"), known)
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    said = F.array_join(
        F.transform("tox_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return predict(rows, model).select(
        "doc_id",
        "held_out",
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
        said.alias("spans"),
    )
