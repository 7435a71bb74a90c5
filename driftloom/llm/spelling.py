"""Spelling variants: words one edit apart, by Aho-Corasick automata over halves of words.

A word of m code points has two segments, its first m // 2 and the rest.  Of two words one
edit apart, each has a segment that stands untouched at the same end of the other one.  An
automaton shard holds the segments of some words, dealt by the segment, so a word is only
scanned by the shards that can hold a segment of its ends: at most two lengths at each end.
A match counts at offset 0 for first segments and at the word's end for second ones, if the
lengths differ by one at most; then the rest is compared.  Where many words share a segment
and a length, the rests are looked up by what is left of them without one code point, so
work grows with the words and not with their pairs; segments of very many words are
dealt to several shards.

Words are counted over the whole corpus first: texts as bytes, boundaries from tables, equal
slices grouped by xxhash, one row per distinct word and unit of texts.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Steps, bound_batches, limit_threads, whole_text
from driftloom.llm.slices import as_strings, distinct, runs, units

#: Code points and occurrences of a word; how many times as frequent its form is.
MIN_LENGTH, MIN_COUNT, TIMES = 6, 5, 5
#: Runs of which 1 in ``SLIP`` loses a code point.
SLIP = 199
#: Bytes of a unit of texts; words of a shard; words of one segment in a shard; rests compared one by one.
UNIT_BYTES, SHARD_WORDS, SEGMENT_WORDS, FEW = 8_000_000, 20_000, 5_000, 16
#: Bytes of runs whose checksums are made side by side; longer ones are made alone.
_SIDE_BY_SIDE = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: Fixed value: the first byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each slice, going on from ``before``, the crc32 of what precedes it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    long_ = int((sizes > _SIDE_BY_SIDE).sum())
    out = np.empty(len(starts), np.uint32)
    for k in order[:long_]:
        out[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(before[k]))
    short = order[long_:]
    state, at, size = ~before[short], starts[short], sizes[short]
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, side="left"))  # those with more than j bytes
        state[:k] = _CRC[(state[:k] ^ raw[at[:k] + j]) & 0xFF] ^ state[:k] >> np.uint32(8)
    out[short] = ~state
    return out


def _count_words(raw: np.ndarray, offsets: np.ndarray, ids: list) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of one unit that are long enough, and how often they occur."""
    raw = _LOWER[raw]
    inside = _LETTER[raw] | (raw == _LEAD)
    inside[1:] |= raw[:-1] == _LEAD
    starts, ends = runs(inside, offsets[:-1][np.diff(offsets) > 0])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    slips = checksums(raw, starts, ends, before[doc]) if len(starts) else np.zeros(0, np.uint32)
    hit = slips % SLIP == 0
    leads = np.concatenate([[0], np.cumsum(raw == _LEAD)])
    long_ = (ends - starts) - (leads[ends] - leads[starts]) >= MIN_LENGTH
    own = ~hit & long_
    first, number = distinct(raw, starts[own], ends[own])
    words, counts = as_strings(raw, starts[own][first], ends[own][first]), np.bincount(number, minlength=len(first))
    slipped: Counter[str] = Counter()
    for a, b, h in zip(starts[hit].tolist(), ends[hit].tolist(), slips[hit].tolist(), strict=True):
        run = raw[a:b].tobytes().decode()
        at = h % len(run)
        if len(run) > MIN_LENGTH:
            slipped[run[:at] + run[at + 1 :]] += 1
    return pa.concat_arrays([words, pa.array(slipped, pa.string())]), np.concatenate([counts, np.array(list(slipped.values()), np.int64)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for raw, offsets, others in units(batches, "body", UNIT_BYTES):
        words, counts = _count_words(raw, offsets, others["doc_id"])
        yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], ["word", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether unlike ``a`` and ``b`` differ by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class Rests:
    """Words that share a segment and a length, with what they have beside the segment."""

    def __init__(self) -> None:
        self.all: list[tuple[str, str, int]] = []  # rest, word, n
        self.tables: dict[int, dict] = {}

    def _table(self, longer: int) -> dict:
        """By what a rest of the same length (0), of one more (1) or of one less (-1) shares with these."""
        if longer not in self.tables:
            table = defaultdict(list)
            for entry in self.all:
                rest = entry[0]
                keys = [rest] if longer == 1 else enumerate_cuts(rest) if longer == 0 else {cut for _, cut in enumerate_cuts(rest)}
                for key in keys:
                    table[key].append(entry)
            self.tables[longer] = table
        return self.tables[longer]

    def near(self, rest: str, longer: int) -> Iterator[tuple[str, int]]:
        """Words whose rests are one edit from ``rest``, which has ``longer`` code points more than theirs."""
        if len(self.all) <= FEW:
            yield from ((word, n) for own, word, n in self.all if own != rest and one_edit(own, rest))
            return
        table = self._table(longer)
        keys = [rest] if longer == -1 else enumerate_cuts(rest) if longer == 0 else {cut for _, cut in enumerate_cuts(rest)}
        for key in keys:
            yield from ((word, n) for own, word, n in table.get(key, ()) if own != rest)


def enumerate_cuts(rest: str) -> list[tuple[int, str]]:
    return [(k, rest[:k] + rest[k + 1 :]) for k in range(len(rest))]


_NEAR = "word string, n_near long, best struct<low:bigint,form:string>"


def near_words(members: list[tuple[str, int, str, int]], words: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """Word, number of near words, the largest n among these and the first word that has it.

    ``members`` are (segment, side, word, n), sides 0 and 1; each pair is found once: by the
    second segment only if the first one doesn't stand at the word's start.
    """
    held: dict[str, tuple[dict, dict]] = {}
    for segment, side, word, n in members:
        by_length = held.setdefault(segment, ({}, {}))[side]
        rest = word[len(segment) :] if side == 0 else word[: len(word) - len(segment)]
        by_length.setdefault(len(word), Rests()).all.append((rest, word, n))
    automaton = ahocorasick.Automaton()
    for segment, lengths in held.items():
        automaton.add_word(segment, (len(segment), lengths))
    if not held:
        return
    automaton.make_automaton()
    for word in words:
        size, count, most, form = len(word), 0, -1, ""
        for end, (length, (firsts, seconds)) in automaton.iter(word):
            at_start, at_end = end + 1 == length, end + 1 == size
            for longer in (-1, 0, 1):
                found: list[tuple[str, int]] = []
                if at_start and size - longer in firsts:
                    found += firsts[size - longer].near(word[length:], longer)
                if at_end and size - longer in seconds:
                    half = (size - longer) // 2
                    found += (x for x in seconds[size - longer].near(word[: size - length], longer) if x[0][:half] != word[:half])
                for other, n in found:
                    count += 1
                    if n > most or n == most and other < form:
                        most, form = n, other
        if count:
            yield word, count, most, form


def _scan(members: pa.Table, words: pa.Table) -> pa.Table:
    limit_threads()
    rows = list(zip(*(members.column(n).to_pylist() for n in ("segment", "side", "word", "n")), strict=True))
    found = list(near_words(rows, words.column("asked").to_pylist()))
    best = pa.array([{"low": -n, "form": form} for _, _, n, form in found], pa.struct([("low", pa.int64()), ("form", pa.string())]))
    return pa.table([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), best], ["word", "n_near", "best"])


def _segments(word: Column, lengths: list[Column]) -> Column:
    """(side, segment) of a word's ends: what a word of each of ``lengths`` may have there."""
    size = F.length(word)
    firsts = [F.struct(F.lit(0).alias("side"), F.substring(word, F.lit(1), F.floor(m / 2).cast("int")).alias("segment")) for m in lengths]
    seconds = [
        F.struct(F.lit(1).alias("side"), F.substring(word, size - F.ceil(m / 2).cast("int") + 1, F.ceil(m / 2).cast("int")).alias("segment"))
        for m in lengths
    ]
    return F.array_distinct(F.array(*firsts, *seconds))


def _near(words: DataFrame, total: int) -> DataFrame:
    """word, n_near and best (of largest n, then first in order; low is -n) of words that have near ones."""
    shards = 1 + total // SHARD_WORDS
    size = F.length("word")
    members = words.select("word", "n", F.explode(_segments(F.col("word"), [size])).alias("s")).select("word", "n", "s.side", "s.segment")
    asked = words.select("word", F.explode(_segments(F.col("word"), [size - 1, size, size + 1])).alias("s")).select("word", "s.side", "s.segment")
    hot = members.groupBy("side", "segment").agg(F.count("*").alias("size")).filter(F.col("size") > SEGMENT_WORDS)
    parts = F.coalesce(F.ceil(F.col("size") / SEGMENT_WORDS), F.lit(1)).cast("long")
    members = members.join(hot, ["side", "segment"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts))
    asked = asked.join(hot, ["side", "segment"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    shard = F.pmod(F.xxhash64("side", "segment", "part"), F.lit(shards)).alias("shard")
    members = members.select(shard, "segment", "side", "word", "n")
    asked = asked.select(shard, F.col("word").alias("asked")).distinct()
    found = members.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_scan, _NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """Words of the corpus with their forms: word, form, root (strings), n, n_near, form_n (longs).

    Words are maximal runs of letters of ASCII and U+00C0 to U+00FF, A to Z in lower case; one
    run in ``SLIP``, by the checksum of document and run, loses a code point.  Those of
    ``MIN_LENGTH`` code points that occur ``MIN_COUNT`` times are kept.  A word's form is its
    near word of largest n (of equal ones the first in code-point order) if that is ``TIMES`` as
    frequent; its root is where forms end.  Null texts have no words; a null ``doc_id`` is
    nothing before the colon; rows that repeat count each for itself.  Other columns are left
    out, whatever their names; no rows, no result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    steps = Steps(spark, "spelling")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("body"))
    counted = rows.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    words = steps.store(counted, "words")
    near = steps.store(words.join(_near(words, words.count()), "word", "left"), "near")
    form_n = -F.col("best.low")
    is_form = F.coalesce(form_n >= TIMES * F.col("n"), F.lit(False))
    formed = near.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, form_n).alias("form_n")
    )
    roots = steps.store(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        # each round follows twice as many forms; counts grow fivefold with each, so few rounds do
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.store(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps.drop(roots)
        roots = longer.select("word", "root")
        if not longer.filter("moved").take(1):
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
