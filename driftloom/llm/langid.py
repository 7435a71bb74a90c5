"""Language of code-switched text, word by word, with a conditional random field.

Words carry their document's language as training labels.  Training chains are
spliced from spans of several documents, so that transitions between languages are
learned as well.  A document's language is the one with the largest sum of marginals
over its words; the score is that sum's share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm import crf
from driftloom.llm.common import limit_threads, map_rows, quoted, unused, wider
from driftloom.llm.words import Words, grouped

#: Documents of each language that a model is fitted on, about.  Every language is learned.
TRAIN_PER_LANGUAGE = 300
#: Words of the training chains that are spliced from the sample: of all languages, and of each at most and at least.
TRAIN_WORDS, MOST_TRAIN_WORDS, LEAST_TRAIN_WORDS = 240_000, 60_000, 2_000
UNDETERMINED = "und"


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def drawn(known: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, the same on every run; never more than twice as many of all.

    Rows of ``known`` are taken by a hash of their doc_id against the label's share.  So
    the sample is bounded by the number of labels, of which a model has a row of weights each.
    """
    sizes = known.groupBy(label).count().orderBy(label).collect()
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1.0, per_label / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    # in an order, as a doc_id that repeats very often is drawn as a whole
    order = F.xxhash64(*(F.col(f"`{c}`") for c in known.columns))
    return known.filter(draw < share).orderBy(order).limit(2 * per_label * len(sizes))


def in_order(rows: list, label: str) -> list:
    return sorted(rows, key=lambda r: (str(r[label]), r["doc_id"] is not None, r["doc_id"], r["text"]))


def spliced_chains(words: Words, tag_of_doc: np.ndarray, n_labels: int, per_label: int, seed: int = 11) -> tuple[list, list]:
    """Chains of word numbers: spans of 4 to 60 words from documents of random labels."""
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero((tag_of_doc == k) & (words.counts > 0)) for k in range(n_labels)]
    present = [k for k in range(n_labels) if len(by_label[k])]
    chains, tags, total = [], [], 0
    while present and total < per_label * len(present):
        chain, tag, size = [], [], 0
        label = rng.choice(present)
        while size < crf.CHAIN:
            doc = int(rng.choice(by_label[label]))
            n = int(min(rng.integers(4, 61), words.counts[doc], crf.CHAIN - size))
            a = int(words.firsts[doc] + rng.integers(0, words.counts[doc] - n + 1))
            chain.append(np.arange(a, a + n))
            tag.append(np.full(n, label))
            size += n
            if rng.random() < 0.3:
                label = rng.choice(present)
        chains.append(np.concatenate(chain))
        tags.append(np.concatenate(tag))
        total += size
    return chains, tags


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> crf.Model:
    """Fit on a sample of the rows of ``docs`` (doc_id, text, lang) with a text and a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = in_order(drawn(known, "lang", per_language).collect(), "lang")
    labels = sorted({r["lang"] for r in rows})
    words = Words([r["text"] for r in rows])
    tag_of_doc = np.array([labels.index(r["lang"]) for r in rows], dtype=np.int64)
    per_label = max(LEAST_TRAIN_WORDS, min(MOST_TRAIN_WORDS, TRAIN_WORDS // max(1, len(labels))))
    chains, tags = spliced_chains(words, tag_of_doc, len(labels), per_label)
    return crf.fit(words, chains, tags, labels)


def label_texts(model: crf.Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of switches between languages, of each text."""
    n, k = len(texts), len(model.labels)
    best, score, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    for a, b in grouped(texts) if k else ():
        words = Words(texts[a:b])
        gamma = model.marginals(model.emissions(words), words.counts)
        if not len(gamma):
            continue
        sums = np.stack([np.bincount(words.doc, weights=gamma[:, j], minlength=b - a) for j in range(k)], axis=1)
        found = words.counts > 0
        top = sums.argmax(axis=1)
        best[a:b] = np.where(found, top, -1)
        score[a:b] = np.where(found, sums[np.arange(b - a), top] / np.maximum(words.counts, 1), 0.0)
        word = gamma.argmax(axis=1)
        changed = (word[1:] != word[:-1]) & (words.doc[1:] == words.doc[:-1])
        switches[a:b] = np.bincount(words.doc[1:][changed], minlength=b - a)
    lettered = [any(map(str.isalpha, t)) for t in texts]
    names = [model.labels[j] if j >= 0 and has else UNDETERMINED for j, has in zip(best, lettered, strict=True)]
    return names, np.where([x != UNDETERMINED for x in names], np.clip(score, 0, 1), 0.0), switches


ADDED = ("lang_pred", "lang_score", "lang_switches")


def predict(docs: DataFrame, model: crf.Model, names: Sequence[str] = ADDED) -> DataFrame:
    """Adds lang_pred, lang_score, lang_switches to every row of ``docs``, from ``text`` alone.

    A null text, one without letters, or a model without labels gives ``und`` with
    score 0.  All rows and columns stay, repeated ones too; columns of the three
    ``names`` are replaced.
    """
    kept = docs.drop(*names)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                lang, score, switches = label_texts(own.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(switches)],
                    [*batch.schema.names, *names],
                )

    schema = wider(kept.schema, **dict(zip(names, ("string", "double", "long"), strict=True)))
    return map_rows(kept, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows whose id isn't held out (remainder 2 of 4) and whose lang is known.
    A null id is neither held out nor learned from.  A null or empty text, and any text
    where nothing could be learned, is ``und`` with score 0.  Rows that repeat each have
    their row; other columns are left out, whatever their names; no rows, no result.
    """
    held = remainder("doc_id", 4) == 2
    model = fit(docs.select("doc_id", "text", "lang").filter(~held))
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_switches")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) whose words are mostly of one language.

    Rows whose text is null, has no letters, or whose best language has less than
    ``least`` of the words go; without a labelled row all do.  Repeated rows stay
    together; all columns stay as they are, whatever their names.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    names = [unused(n, docs.columns) for n in ADDED]
    lang, score, _ = quoted(names)
    found = predict(docs, model, names)
    return found.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*quoted(docs.columns))
