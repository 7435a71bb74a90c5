"""Stupid-backoff language-model scores, from counts over the whole corpus.

S(w | context) is the n-gram's relative frequency where it occurs at least
``min_count`` times in the corpus, else ``alpha`` times S of the shorter context; of a
single word its share of all words.  A document's score is the mean logarithm.

The counts are a table of n-gram hashes.  Documents are gathered to units of a bounded
number of characters, and a unit's exploded n-grams are rows: each distinct one once, with its
number there, so that a frequent n-gram is one row of a unit, however often it occurs.
Spark deals the rows by hash, sums their numbers per hash and joins the sums to the rows, by
a window.  N-grams of ``min_count`` and more, and all single words, go back to
their units; others are told by their absence.  There the logarithms are summed per
document.  All this grows in proportion to the corpus: rows are n-grams, and nothing goes over
pairs of units and partitions.

The shorter n-grams are counted first.  One of the full length occurs ``min_count`` times only
if it does so without its first word and without its last one, so only those where both do are
rows; the others back off without being counted.  How much the logarithm changes where such
an n-gram doesn't back off depends on its words alone, so that its count is all that goes back.

Hashes are worked on in ``SLICES`` ranges, one after another, and units in ``SHARES`` shares when
their counts come back, so that the files of an exchange are those of one range or share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import Steps, bound_batches, limit_threads, whole_text
from driftloom.llm.words import Words, mix

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Characters of a unit (one document at least); ranges of hashes that are counted, and shares of units that are scored, one after another.
UNIT_CHARS, SLICES, SHARES = 8_000_000, 2, 4
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def gram_keys(word: np.ndarray, position: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for 1 to ``order`` words.

    ``word`` are the words' hashes and ``position`` their places in their documents.
    Where a document has no such n-gram, the hash is 0.
    """
    out = [mix(word + np.uint64(1))]
    for n in range(2, order + 1):
        total = np.full(len(word), np.uint64(n))
        for j in range(n):
            before = n - 1 - j
            total += np.concatenate([np.zeros(before, np.uint64), word])[: len(word)] * np.uint64(_ODD[j % 5])
        out.append(np.where(position >= n - 1, mix(total), np.uint64(0)))
    return out


_UNIT = "unit long, doc_ids array<long>, counts binary, words binary, ids binary"


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    parts = [Words(texts[a : a + 512], digits=True) for a in range(0, len(texts), 512)]
    return np.concatenate([w.hashes() for w in parts]), np.concatenate([w.counts for w in parts])


def _to_unit(unit: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    h, counts = _word_hashes(texts)
    distinct, number = np.unique(h, return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([unit], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([pack_numbers(counts.astype(np.uint32))], pa.binary()),
            pa.array([pack_numbers(_differences(distinct))], pa.binary()),
            pa.array([pack_numbers(number.astype(np.uint32))], pa.binary()),
        ],
        [f.split()[0] for f in _UNIT.split(", ")],
    )


def _share(unit: int) -> int:
    """Which of the ``SHARES`` shares of units one belongs to."""
    return ((unit >> 32) + (unit & 0xFFFFFFFF)) % SHARES


def _units(batches: Iterator[pa.RecordBatch], share: int | None = None) -> Iterator[tuple[int, list, list[str]]]:
    """The units of a partition, with ids and texts; only those of one share where that is given."""
    limit_threads()
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    texts: list[str] = []
    asked = lambda: share is None or _share(part << 32 | seq) == share
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(text) > UNIT_CHARS:
                    if asked():
                        yield part << 32 | seq, ids, texts
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(text)
                size += len(text) + 1
    if texts and asked():
        yield part << 32 | seq, ids, texts


def _gather(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    for unit, ids, texts in _units(batches, share):
        yield _to_unit(unit, ids, texts)


def _grams_of_unit(counts: bytes, words: bytes, ids: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each document, and the n-grams' hashes by order."""
    count = unpack_numbers(counts, np.uint32).astype(np.int64)
    distinct = np.cumsum(unpack_numbers(words, np.uint64), dtype=np.uint64)
    number = unpack_numbers(ids, np.uint32)
    word = distinct[number] if len(number) else np.zeros(0, np.uint64)
    return count, gram_keys(word, _positions(count), order)


def _positions(count: np.ndarray) -> np.ndarray:
    """Each word's place in its document."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _lows(slices: int) -> np.ndarray:
    """Where each range of hashes begins."""
    return np.array([(k << 64) // slices for k in range(slices)], np.uint64)


#: Bits of an n-gram's place among the distinct ones of its unit, order and range.
_PLACE = 40
_GRAM = "h long, unit long, at long, n long"


def _range(slices: int, k: int) -> tuple[np.uint64, np.uint64]:
    """The least and the greatest hash of range ``k``."""
    high = _lows(slices)[k + 1] - np.uint64(1) if k + 1 < slices else np.uint64(0xFFFFFFFFFFFFFFFF)
    return _lows(slices)[k], high


def _gram_rows(unit: int, grams: np.ndarray, at: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(grams), 1 << 16):
        part = slice(a, a + (1 << 16))
        columns = [grams[part].view(np.int64), np.full(len(grams[part]), unit, np.int64), at[part], number[part].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "unit", "at", "n"])


def _explode(order: int, slices: int, k: int):
    """Rows of the distinct n-grams of each unit whose hashes are in range ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = _range(slices, k)
        for unit, _, texts in _units(batches):
            word, count = _word_hashes(texts)
            for n, keys in enumerate(gram_keys(word, _positions(count), order)):
                own = keys[(keys >= low) & (keys <= high) & (keys != 0)]
                grams, number = np.unique(own, return_counts=True)
                at = np.arange(len(grams)) | (n * slices + k) << _PLACE
                yield from _gram_rows(unit, grams, at, number)

    return run


def _explode_longest(slices: int, k: int):
    """Rows of each unit's distinct n-grams of the full length that may be frequent, of range ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit_threads()
        low, high = _range(slices, k)
        for batch in batches:
            for row in batch.to_pylist():
                grams = np.cumsum(unpack_numbers(row["grams"], np.uint64), dtype=np.uint64)
                own = slice(np.searchsorted(grams, low), np.searchsorted(grams, high, side="right"))
                at = np.arange(own.start, own.stop)
                yield from _gram_rows(row["unit"], grams[own], at, unpack_numbers(row["n"], np.uint32)[own])

    return run


def score_words(
    by_order: list[np.ndarray], count_of: list[np.ndarray], alpha: float, min_count: int
) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of S for each word, but for the share of single words, and which words back off to that.

    ``count_of`` has the corpus counts of ``by_order``'s n-grams.  A single word's S lacks
    the division by the number of all words.
    """
    size = len(by_order[0])
    score = np.full(size, -np.inf)
    open_ = np.ones(size, bool)
    penalty = np.zeros(size)
    for n in range(len(by_order), 1, -1):
        exists = by_order[n - 1] != 0
        good = open_ & exists & (count_of[n - 1] >= min_count)
        at = np.flatnonzero(good)
        context = count_of[n - 2][at - 1]  # the n-gram without its last word ends a word earlier
        score[at] = penalty[at] + np.log(count_of[n - 1][at] / context)
        open_ &= ~good
        penalty[open_ & exists] += np.log(alpha)
    score[open_] = penalty[open_] + np.log(count_of[0][open_])
    return score, open_


_SUMS = "doc_id long, n_words long, n_single long, sum_log double"


def _counts_of(by_order: list[np.ndarray], slices: int, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Corpus counts of a unit's n-grams by order, 0 where nothing has come back."""
    where, place = at >> _PLACE, at & ((1 << _PLACE) - 1)
    out = []
    for k, keys in enumerate(by_order):
        distinct, number = np.unique(keys, return_inverse=True)
        none = int(len(distinct) > 0 and distinct[0] == 0)  # no n-gram ends there
        begins = np.searchsorted(distinct[none:], _lows(slices)) + none
        counts = np.zeros(len(distinct))
        own = where // slices == k
        counts[begins[where[own] % slices] + place[own]] = n[own]
        if k == 0 and len(distinct) and not counts[none:].all():
            raise ValueError("the documents differ between two readings; store them first")
        out.append(counts[number])
    return out


#: A unit's documents, scored by shorter n-grams, and its n-grams of the full length that may be frequent:
#: hashes, numbers, what their logarithm is compared with, the documents' numbers of them, and which they are.
_SCORED = (
    "unit long, doc_ids array<long>, n_words array<long>, n_single array<long>, sum_log array<double>, "
    "grams binary, n binary, loss binary, in_doc binary, number binary"
)
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
_SUM_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
_SCORED_KINDS = [pa.int64(), _LONGS, _LONGS, _LONGS, _DOUBLES, *[pa.binary()] * 5]


def _on_units(of_unit: Callable[[dict, np.ndarray, np.ndarray], list], schema: str, kinds: list[pa.DataType]):
    """Columns that ``of_unit`` makes of each unit and the places and numbers that have come back to it."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(units: pa.Table, counted: pa.Table) -> pa.Table:
        limit_threads()
        at, n = (counted.column(c).to_numpy() for c in ("at", "n"))
        out = [[pa.array(x, k) for x, k in zip(of_unit(row, at, n), kinds, strict=True)] for row in units.to_pylist()]
        return pa.concat_tables([pa.table(c, names) for c in out or [[pa.array([], k) for k in kinds]]])

    return run


def _by_doc(count: np.ndarray, *of_word: np.ndarray) -> list[np.ndarray]:
    """Sums per document of what its words, ``count`` each, have."""
    doc = np.repeat(np.arange(len(count)), count)
    return [np.bincount(doc, weights=x, minlength=len(count)).astype(np.float64) for x in of_word]


def _score_words(slices: int, alpha: float, min_count: int):
    """The documents' sums by single words."""

    def of_unit(row: dict, at: np.ndarray, n: np.ndarray) -> list:
        count, by_order = _grams_of_unit(row["counts"], row["words"], row["ids"], 1)
        sums, singles = _by_doc(count, *score_words(by_order, _counts_of(by_order, slices, at, n), alpha, min_count))
        return [row["doc_ids"], count, singles.astype(np.int64), sums]

    return _on_units(of_unit, _SUMS, _SUM_KINDS)


def _score_shorter(order: int, slices: int, alpha: float, min_count: int):
    """Scores by n-grams of less than ``order`` words (2 at least), and the n-grams of ``order`` that may be frequent."""

    def of_unit(row: dict, at: np.ndarray, n: np.ndarray) -> list:
        count, by_order = _grams_of_unit(row["counts"], row["words"], row["ids"], order)
        longest, shorter = by_order[-1], by_order[:-1]
        count_of = _counts_of(shorter, slices, at, n)
        logs, single = score_words(shorter, count_of, alpha, min_count)
        logs[longest != 0] += np.log(alpha)
        sums, singles = _by_doc(count, logs, single)
        frequent = count_of[-1] >= min_count
        # the n-gram without its last word ends a word earlier
        rows = np.flatnonzero((longest != 0) & frequent & np.concatenate([[False], frequent])[: len(frequent)])
        grams, number, times = np.unique(longest[rows], return_inverse=True, return_counts=True)
        loss = np.zeros(len(grams))
        loss[number] = np.log(count_of[-1][rows - 1]) + logs[rows]
        in_doc = np.bincount(np.repeat(np.arange(len(count)), count)[rows], minlength=len(count))
        blobs = [_differences(grams), times.astype(np.uint32), loss, in_doc.astype(np.uint32), number.astype(np.uint32)]
        lists = [row["doc_ids"], count, singles.astype(np.int64), sums]
        return [[row["unit"]], *([x] for x in lists), *([pack_numbers(x)] for x in blobs)]

    return _on_units(of_unit, _SCORED, _SCORED_KINDS)


def _score_longest(order: int):
    """The documents' sums, where numbers of n-grams of ``order`` words have come back."""

    def of_unit(row: dict, at: np.ndarray, n: np.ndarray) -> list:
        loss, number, in_doc = (unpack_numbers(row[c], k) for c, k in (("loss", np.float64), ("number", np.uint32), ("in_doc", np.uint32)))
        gain, found = np.zeros(len(loss)), np.zeros(len(loss))
        gain[at] = np.log(n) - loss[at]
        found[at] = order == 2  # before, the word backed off to a single one
        gains, founds = _by_doc(in_doc.astype(np.int64), gain[number], found[number])
        return [row["doc_ids"], row["n_words"], np.array(row["n_single"], np.int64) - founds.astype(np.int64), row["sum_log"] + gains]

    return _on_units(of_unit, _SUMS, _SUM_KINDS)


def _count_rows(grams: DataFrame, kept: Column) -> DataFrame:
    """Each n-gram's row with its number in the whole corpus, where ``kept`` holds."""
    return grams.select("unit", "at", F.sum("n").over(Window.partitionBy("h")).alias("n")).filter(kept)


def _of_share(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.pmod(F.shiftright("unit", 32) + F.col("unit").bitwiseAND(0xFFFFFFFF), F.lit(SHARES)) == k)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """Score every whole ``text`` of ``docs``: doc_id, n_words, sum_log, score (mean log S).

    Words are runs of letters and digits, case folded.  A null text counts as empty; a
    text without words has sum 0 and a null score.  Rows that repeat, also a doc_id,
    count and are scored each for itself.  Other columns are left out, whatever their
    names; no rows, no result.  ``docs`` is read again for each range and must say the same
    each time, in the same partitions, as tables do; otherwise it is an error.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    steps = Steps(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    single, frequent = F.shiftright("at", _PLACE) < SLICES, F.col("n") >= min_count
    shorter = max(order - 1, 1)
    counted = _together(
        [steps.store(_count_rows(rows.mapInArrow(_explode(shorter, SLICES, k), _GRAM), single | frequent), "counts") for k in range(SLICES)]
    )
    run, kind = (_score_words(SLICES, alpha, min_count), _SUMS) if order == 1 else (_score_shorter(order, SLICES, alpha, min_count), _SCORED)
    scored = []
    for k in range(SHARES):
        units = rows.mapInArrow(lambda batches, k=k: _gather(batches, k), _UNIT)
        both = units.groupBy("unit").cogroup(_of_share(counted, k).groupBy("unit"))
        scored.append(steps.store(both.applyInArrow(run, kind), "scored"))
    steps.drop(counted)
    if order > 1:
        longest = _together(scored).select("unit", "grams", "n")
        counted = _together(
            [steps.store(_count_rows(longest.mapInArrow(_explode_longest(SLICES, k), _GRAM), frequent), "counts") for k in range(SLICES)]
        )
        for k, units in enumerate(scored):
            both = units.drop("grams", "n").groupBy("unit").cogroup(_of_share(counted, k).groupBy("unit"))
            scored[k] = steps.store(both.applyInArrow(_score_longest(order), _SUMS), "sums")
            steps.drop(units)
        steps.drop(counted)
    sums = _together(scored)
    total = sums.agg(F.sum("n_words")).first()[0] or 1
    log = F.col("sum_log") - F.col("n_single") * float(np.log(total))
    return sums.select(
        "doc_id", "n_words", log.alias("sum_log"), F.when(F.col("n_words") > 0, log / F.col("n_words")).alias("score")
    )
