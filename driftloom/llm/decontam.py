"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every passage of every training text is a query.  Passages are windows of words, three
times as long as the longest item and one such length apart, so a copy of an item lies
whole in one of them, also where edits have made it twice as long.  An item's score is
that of BM25 over the item's own terms that the passage has, as a share of the item's
score against itself.  All items at their thresholds or above are retrieved and verified
by the overlap of their five-word shingles, for question and answer, with the passage
and as much text again as an item's length on both sides.

An item's threshold is the least score that an overlap of 0.8 can leave it: a word can't
be missing without a shingle of its own missing, the one that ends or begins with it on
the side of what is left; so no more words are missing than shingles may be, and at worst
those of the largest impacts.

The terms are split as in MaxScore: frequent ones, which together can't bring any item
above half its threshold, don't generate candidates; block-max WAND runs over the
others with the threshold less that half, and the score is completed for what it finds.
Windows whose largest possible score is too small are left out by arithmetic on arrays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftloom.llm.common import limit_threads, map_rows, stored, whole_text, wider
from driftloom.llm.neardup import SHINGLE, THRESHOLD
from driftloom.llm.words import Words, grouped, mix

K1, B = 1.2, 0.75
BLOCK = 64
#: Items of fewer words than a shingle leak where they are a text's only words.
LEAST_WORDS = SHINGLE
#: Characters of items that one index holds; more items make more indexes.
INDEX_CHARS = 32 << 20
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = len(h) - size + 1
    if size < 1 or n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += h[j : j + n] * np.uint64(_ODD[j])
    return mix(total)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at the last question mark that something follows, else before the last sentence."""
    text = text.strip()
    at = text.rfind("?", 0, len(text) - 1)
    if at < 0:
        ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text)]
        at = ends[-1] - 1 if ends else len(text)
    return text[: at + 1], text[at + 1 :]


@dataclass
class Item:
    id: int
    #: Impact of each term, as a share of the item's score against itself.
    impacts: dict[int, float]
    #: Shingles of the whole, the question, the answer, and their size in words.
    parts: list[tuple[int, np.ndarray]] = field(default_factory=list)
    #: Share of its own score below which the item can't be verified.
    least: float = 1.0

    def set_least(self) -> None:
        missing = [int(len(wanted) * (1 - THRESHOLD) + 1e-9) for _, wanted in self.parts]
        largest = sorted(self.impacts.values(), reverse=True)
        # some word is left, whatever is missing
        self.least = max(1.0 - sum(largest[: max(missing[0], missing[1] + missing[2])]), largest[-1]) - 1e-9


@dataclass
class Index:
    items: list[Item]
    #: Sorted hashes of the terms that generate candidates, and their largest impacts.
    terms: np.ndarray
    most: np.ndarray
    #: Per such term: item numbers, impacts as shares of the item's threshold, last item and largest impact of each block.
    postings: list[tuple[list[int], list[float], list[int], list[float]]]
    #: Threshold, as a share, for the terms that generate candidates.
    rest: float
    step: int
    #: Items too short for shingles, by their number of words and the hash of these.
    short: dict[tuple[int, int], list[int]]

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms >> np.uint64(44)).astype(np.int64)] = True


def build_index(rows: list[tuple[int, str]]) -> Index:
    """An index of the items (id, text)."""
    words = Words([t for _, t in rows], digits=True)
    h = words.hashes()
    kept = [k for k in range(len(rows)) if words.counts[k] >= LEAST_WORDS]
    own = {k: h[words.firsts[k] : words.firsts[k] + words.counts[k]] for k in kept}
    df: dict[int, int] = {}
    for k in kept:
        for t in np.unique(own[k]).tolist():
            df[t] = df.get(t, 0) + 1
    n = len(kept)
    mean = np.mean([len(own[k]) for k in kept]) if kept else 1.0
    items = []
    for k in kept:
        terms, tf = np.unique(own[k], return_counts=True)
        norm = K1 * (1 - B + B * len(own[k]) / mean)
        raw = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in zip(terms.tolist(), tf.tolist(), strict=True)}
        total = sum(raw.values())
        item = Item(rows[k][0], {t: x / total for t, x in raw.items()})
        question, answer = split_item(rows[k][1])
        for part in (rows[k][1], question, answer):
            hashes = Words([part], digits=True).hashes()
            size = min(SHINGLE, len(hashes))
            item.parts.append((size, np.unique(grams(hashes, size))))
        item.set_least()
        items.append(item)
    short: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero((words.counts > 0) & (words.counts < LEAST_WORDS)).tolist():
        n = int(words.counts[k])
        short.setdefault((n, int(grams(h[words.firsts[k] : words.firsts[k] + n], n)[0])), []).append(rows[k][0])
    # frequent terms leave the candidate search while no item can owe them half its threshold
    owed, frequent = np.zeros(len(items)), set()
    where: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        for t in item.impacts:
            where.setdefault(t, []).append(k)
    for t in sorted(df, key=lambda t: (-df[t], t)):
        if df[t] < 2:
            break
        more = np.array([items[k].impacts[t] / items[k].least for k in where[t]])
        if (owed[where[t]] + more).max() <= 0.5:
            owed[where[t]] += more
            frequent.add(t)
    terms = np.array(sorted(set(df) - frequent), dtype=np.uint64)
    postings = []
    for t in terms.tolist():
        impacts = [items[k].impacts[t] / items[k].least for k in where[t]]
        blocks = range(0, len(impacts), BLOCK)
        postings.append(
            (where[t], impacts, [where[t][min(b + BLOCK, len(impacts)) - 1] for b in blocks], [max(impacts[b : b + BLOCK]) for b in blocks])
        )
    most = np.array([max(p[1]) for p in postings])
    longest = max((len(own[k]) for k in kept), default=1)
    return Index(items, terms, most, postings, 1.0 - float(owed.max(initial=0.0)), max(32, longest), short)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[int]:
    """Items whose impacts over ``terms`` (numbers of index terms) add up to ``threshold``."""
    found = []
    # a cursor: current item, position, term
    cursors = [[index.postings[t][0][0], 0, t] for t in terms]
    end = len(index.items)
    slack = threshold - 1e-9

    def seek(cursor: list, item: int) -> None:
        own = index.postings[cursor[2]][0]
        cursor[1] = bisect_left(own, item, cursor[1])
        cursor[0] = own[cursor[1]] if cursor[1] < len(own) else end

    while True:
        cursors.sort()
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            if c[0] >= end:
                break
            total += index.most[c[2]]
            if total >= slack:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, until = 0.0, end
        for c in cursors[: pivot + 1]:
            _, _, last, largest = index.postings[c[2]]
            block = bisect_left(last, item)
            if block < len(last):
                bound += largest[block]
                until = min(until, last[block] + 1)
        if bound < slack:
            if pivot + 1 < len(cursors):
                until = min(until, cursors[pivot + 1][0])
            until = max(until, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < until:
                    seek(c, until)
        elif cursors[0][0] == item:
            score = sum(index.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
            if score >= slack:
                found.append(item)
            for c in cursors[: pivot + 1]:
                seek(c, item + 1)
        else:
            for c in cursors[: pivot + 1]:
                if c[0] < item:
                    seek(c, item)


def _windows(words: Words, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and the one after the last of each passage of three steps, and its text."""
    per_text = np.where(words.counts > 0, np.maximum(1, -(-(words.counts - 2 * step) // step)), 0)
    doc = np.repeat(np.arange(words.n_texts), per_text)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = words.firsts[doc] + k * step
    return begin, np.minimum(begin + 3 * step, words.firsts[doc] + words.counts[doc]), doc


def find_leaks(index: Index, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
    """Verified leaks: text number, item id, score, overlap of item, question and answer.

    An item counts once in a text, with its best passage.
    """
    best: dict[tuple[int, int], tuple] = {}
    for a, b in grouped(texts) if index.items or index.short else ():
        words = Words(texts[a:b], digits=True)
        h = words.hashes()
        for doc in np.flatnonzero((words.counts > 0) & (words.counts < LEAST_WORDS)).tolist() if index.short else ():
            n = int(words.counts[doc])
            for item_id in index.short.get((n, int(grams(h[words.firsts[doc] : words.firsts[doc] + n], n)[0])), ()):
                best[a + doc, item_id] = (1.0,) * 4
        if not index.items:
            continue
        likely = np.flatnonzero(index.filter[(h >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(index.terms, h[likely])
        term[term == len(index.terms)] = 0
        real = index.terms[term] == h[likely]
        at, term = likely[real], term[real]
        gain = np.zeros(len(h) + 1)
        gain[at + 1] = index.most[term]
        sums = np.cumsum(gain)
        begin, end, doc = _windows(words, index.step)
        for w in np.flatnonzero(sums[end] - sums[begin] >= index.rest - 1e-9).tolist():
            lo, hi = np.searchsorted(at, (begin[w], end[w]))
            own = np.unique(term[lo:hi]).tolist()
            items = block_max_wand(index, own, index.rest)
            if not items:
                continue
            have = set(h[begin[w] : end[w]].tolist())
            first = words.firsts[doc[w]]
            low, high = max(begin[w] - index.step, first), min(end[w] + index.step, first + words.counts[doc[w]])
            for k in items:
                item = index.items[k]
                score = sum(x for t, x in item.impacts.items() if t in have)
                if score < item.least:
                    continue
                shares = []
                for size, wanted in item.parts:
                    got = grams(h[low:high], size)
                    shares.append(float(np.isin(wanted, got).mean()) if len(wanted) else 1.0)
                whole, question, answer = shares
                if whole >= THRESHOLD or (question >= THRESHOLD and answer >= THRESHOLD):
                    key = (a + int(doc[w]), item.id)
                    best[key] = max(best.get(key, (0.0,) * 4), (score, whole, question, answer))
    return [(*key, *value) for key, value in best.items()]


def indexes(benchmark: DataFrame) -> tuple[int, Iterator[Index]]:
    """Indexes of all items of ``benchmark`` (item_id, text), each of a bounded size: how many, and one after another.

    Items are dealt to indexes by a hash, as many as their characters need.
    """
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + int(size // INDEX_CHARS)

    def build() -> Iterator[Index]:
        for k in range(shards):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text").collect()
            yield build_index([(r["item_id"], r["text"]) for r in rows])

    return shards, build()


def _pass(docs: DataFrame, index: Index, run: Callable, schema: StructType, last: bool) -> DataFrame:
    """One pass of an index over ``docs``.  Of several, each ends before the next index is broadcast."""
    own = docs.sparkSession.sparkContext.broadcast(index)
    out = map_rows(docs, lambda batches: run(own.value, batches), schema)
    if not last:
        out = stored(out, "leaks")
        own.destroy()
    return out


_LEAKS = wider(
    StructType(), doc_id="long", item_id="long", score="double", overlap="double", question_overlap="double", answer_overlap="double"
)


def _leak_rows(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            found = find_leaks(index, batch.column("text").to_pylist())
            ids = batch.column("doc_id").to_pylist()
            columns = list(zip(*((ids[x[0]], *x[1:]) for x in found), strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _LEAKS.names
            )


def _clean_rows(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            clean = np.ones(len(texts), bool)
            clean[[x[0] for x in find_leaks(index, texts)]] = False
            yield batch.filter(pa.array(clean))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text) in every whole ``text`` of ``docs``, a row per text and item.

    Null and empty texts and items have none; an item of fewer than five words leaks
    where a text has just these words.  Rows that repeat are searched each for itself; a
    null doc_id stays null; items of one text are all reported.  Other columns are left
    out, whatever their names; no rows or no items, no result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    shards, built = indexes(benchmark)
    return reduce(DataFrame.union, (_pass(rows, index, _leak_rows, _LEAKS, shards == 1) for index in built))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak.

    Null and empty texts stay, and so do repeated rows; all columns stay as they are,
    whatever their names.  Without items all rows stay.
    """
    shards, built = indexes(benchmark)
    for k, index in enumerate(built):
        docs = _pass(docs, index, _clean_rows, wider(docs.schema), k == shards - 1)
    return docs
