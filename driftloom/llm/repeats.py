"""Repeated passages by longest-previous-factor arrays over the suffixes of a whole corpus.

A byte is repeated if a string of ``WINDOW`` bytes that covers it also starts elsewhere,
in this document or another.  Strings never cross documents.

Suffixes are brought together without a suffix array of the whole corpus.  Of the
``WINDOW - GRAM + 1`` grams in a window, the one of least hash (the first of these) is the
window's anchor, so equal windows have equal anchors at equal distances.  A document is
cut into its anchors' pieces: an anchor and the windows that it stands for, about one in
75 bytes.  Anchors whose gram occurs once end there.  Of the others, pieces that are equal
throughout are one class; where the pieces of a gram aren't all equal, one text of each
class goes to the suffix array of its gram.  There previous and next smaller positions in
suffix order give each window's longest earlier factor, and greater ones its longest
later factor.

A gram of very many unlike pieces is split before: the windows of the first half of
distances and those of the second each share a longer string, by which they are grouped
anew, up to groups of one whole window, which need no suffix array.

Grams and classes are compared by two unlike hashes of 64 bits, and bytes decide inside
suffix arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Steps, bound_batches, limit_threads, whole_text
from driftloom.llm.words import mix

#: Bytes of a repeated string, and of the grams among which its anchor is chosen.
WINDOW, GRAM = 200, 50
#: Classes of a gram that meet in one suffix array; classes of one task's suffix arrays.
GROUP, BUCKET = 1500, 4096
#: Bytes that are hashed together.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]
ANCHOR = "d long, t long, h long, c long, at long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(b, PIECE + 1) for b in _BASES]
_INVERSES = [_powers(pow(b, -1, 1 << 64), PIECE + 1) for b in _BASES]


def _sums(raw: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[which][raw] * _POWERS[which][: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size, out = 1, keys
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of some texts' bytes: first window, anchor and last window, the gram's and the piece's hash.

    ``raw`` has the texts one after another (``PIECE`` bytes at most), ``ends`` where they end.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = _sums(raw, 0)
    grams = mix((sums[gram:] - sums[:-gram]) * _INVERSES[0][: len(sums) - gram])
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(keys, window - gram + 1) & _PLACE).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - begins - window + 1, 0)
    inside = np.zeros(len(place) + 1, np.int8)
    some = counts > 0
    np.add.at(inside, begins[some], 1)
    np.add.at(inside, begins[some] + counts[some], -1)
    valid = np.cumsum(inside[:-1]).astype(bool)
    fresh = valid.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    fresh[begins[some]] = True
    lo = np.flatnonzero(fresh)
    stop = valid.copy()
    stop[:-1] &= fresh[1:] | ~valid[1:]
    hi = np.flatnonzero(stop)
    at = place[lo]
    own = _sums(raw, 1)
    whole = (own[hi + window] - own[lo]) * _INVERSES[1][lo]
    shape = ((at - lo) << 8 | (hi - lo)).astype(np.uint64)
    return lo, at, hi, grams[at], mix(whole + shape * np.uint64(_BASES[0]))


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and its offsets."""
    column = batch.column(name)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``PIECE`` bytes together at most; a longer one alone."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + PIECE, side="right")) - 1
        end = max(end, start + 1)
        yield start, end
        start = end


def _long(raw: np.ndarray) -> list[np.ndarray]:
    """``anchors`` of one text of more than ``PIECE`` bytes: each part begins with the last piece of the one before, which may go on."""
    out, begin = [], 0
    while True:
        part = raw[begin : begin + PIECE]
        found = list(anchors(part, np.array([len(part)])))
        last = begin + PIECE >= len(raw)
        keep = len(found[0]) if last else len(found[0]) - 1
        out.append([x[:keep] + begin if k < 3 else x[:keep] for k, x in enumerate(found)])
        if last:
            return [np.concatenate([o[k] for o in out]) for k in range(5)]
        begin += int(found[0][-1])


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for batch in batches:
        raw, offsets = _texts(batch, "body")
        d, t = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d", "t"))
        for a, b in _blocks(offsets):
            own, begin = raw[offsets[a] : offsets[b]], offsets[a]
            if len(own) > PIECE:
                found = _long(own)
            else:
                found = anchors(own, offsets[a + 1 : b + 1] - begin)
            lo, at, hi, h, c = found
            doc = np.searchsorted(offsets, lo + begin, side="right") - 1
            start = lo + begin - offsets[doc]
            packed = start << 16 | (at - lo) << 8 | (hi - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (d[doc], t[doc], h.view(np.int64), c.view(np.int64), packed)], [f.split()[0] for f in ANCHOR.split(", ")]
            )


def _start(at: Column) -> Column:
    return F.shiftrightunsigned(at, 16)


def _left(at: Column) -> Column:
    return F.shiftrightunsigned(at, 8).bitwiseAND(255)


def _span(at: Column) -> Column:
    return at.bitwiseAND(255)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d and t (which name a document by its id and text), body (its bytes)."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("t"),
        text.cast("binary").alias("body"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the pieces that each document is asked for."""
    for batch in batches:
        raw, offsets = _texts(batch, "body")
        out: list[list] = [[], [], [], [], [], []]
        for k, (d, t, asked) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("d", "t", "asked")), strict=True)):
            body = raw[offsets[k] : offsets[k + 1]].tobytes()
            for x in asked:
                start, span = x["at"] >> 16, x["at"] & 255
                for o, v in zip(out, (x["h"], x["c"], d, t, x["at"], body[start : start + span + WINDOW]), strict=True):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary() if k == 5 else pa.int64()) for k, o in enumerate(out)], ["h", "c", "d", "t", "at", "piece"])


def suffix_ranks(raw: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the strings of 8, 16, ... and of ``length`` bytes at each place, by doubling.

    Ends are padded with zeros.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for j in range(8):
        value = value << np.uint64(8) | padded[j : j + n]
    size, rank = 8, np.unique(value, return_inverse=True)[1].astype(np.int64)
    out = [(size, rank)]
    while size < length:
        step = min(size, length - size)
        after = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        size, rank = size + step, np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        out.append((size, rank))
    return out


def common_prefixes(order: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """LCP array of suffixes in ``order``, capped at the length of the last ranks; the first is 0."""
    a, b, most = order[:-1], order[1:], ranks[-1][0]
    same = np.zeros(len(a), np.int64)
    whole = ranks[-1][1][a] == ranks[-1][1][b]
    for size, rank in reversed([r for r in ranks if r[0] & (r[0] - 1) == 0]):
        at = [np.minimum(x + same, len(rank) - 1) for x in (a, b)]
        same += size * (rank[at[0]] == rank[at[1]])
    return np.concatenate([[0], np.where(whole, most, np.minimum(same, most - 1))])


def _toward(position: np.ndarray, lcp: np.ndarray, floor: int) -> np.ndarray:
    """Common prefix with the nearest smaller position before, in suffix order; 0 below ``floor``."""
    link, low = np.arange(len(position)) - 1, lcp.copy()
    link[low < floor] = -1
    while True:
        open_ = np.flatnonzero(link >= 0)
        far = open_[position[link[open_]] > position[open_]]
        if not len(far):
            return np.where(link >= 0, low, 0)
        via = link[far]
        low[far] = np.minimum(low[far], low[via])
        link[far] = np.where(low[far] < floor, -1, link[via])


def longest_previous(position: np.ndarray, lcp: np.ndarray, floor: int = 1) -> np.ndarray:
    """Longest-previous-factor array: what each suffix shares with one of a smaller position.

    ``position`` and ``lcp`` are in suffix order.  The longest is shared with the previous
    or the next smaller position in that order.  Lengths below ``floor`` are 0.
    """
    if not len(position):
        return np.zeros(0, np.int64)
    before = _toward(position, lcp, floor)
    back = np.concatenate([[0], lcp[:0:-1]])
    return np.maximum(before, _toward(position[::-1], back, floor)[::-1])


_VERDICT = "h long, c long, d long, t long, lo long, hi long"


def _factors(keep: str):
    """Windows of each piece that occur elsewhere too (earlier, if the first copy is kept), from one suffix array."""

    def run(table: pa.Table) -> pa.Table:
        limit_threads()
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        raw, offsets = _texts(batch, "piece")
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        at, r0, r1, d, t, h, c = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "r0", "r1", "d", "t", "h", "c"))
        start, left, span = at >> 16, (at >> 8) & 255, at & 255
        first, last = np.maximum(0, r0 + left), np.minimum(span, r1 + left)
        counts = last - first + 1
        row = np.repeat(np.arange(len(at)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
        ranks = suffix_ranks(raw, WINDOW)
        suffix = offsets[row] + offset
        order = np.argsort(ranks[-1][1][suffix], kind="stable")
        place = np.empty(len(row), np.int64)
        place[np.lexsort((start[row] + offset, t[row], d[row]))] = np.arange(len(row))
        lcp, position = common_prefixes(suffix[order], ranks), place[order]
        shared = longest_previous(position, lcp, WINDOW) >= WINDOW
        if keep == "none":
            shared |= longest_previous(-position, lcp, WINDOW) >= WINDOW
        hit = np.zeros(len(row), bool)
        hit[order] = shared
        joins = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
        lo = np.flatnonzero(hit & ~np.concatenate([[False], joins]))
        hi = np.flatnonzero(hit & ~np.concatenate([joins, [False]]))
        own = row[lo]
        names = [f.split()[0] for f in _VERDICT.split(", ")]
        return pa.table([h[own], c[own], d[own], t[own], start[own] + offset[lo], start[own] + offset[hi]], names)

    return run


def _suffix_arrays(steps: Steps, pieces: DataFrame, keep: str) -> list[DataFrame]:
    """Verdicts over all ``pieces`` (g: what the pieces of a group share; r0 to r1: the windows' distances from the anchor)."""
    out, work = [], pieces
    while True:
        sizes = work.groupBy("h", "g").agg(F.count("*").alias("size")).filter("size > 1")
        sized = steps.store(work.join(sizes, ["h", "g"]), "sized")
        if work is not pieces:
            steps.drop(work)
        few = sized.filter(F.col("size") <= GROUP)
        buckets = 1 + few.count() // BUCKET
        met = few.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        names = ["h", "c", "d", "t", "at", "r0", "r1", "piece", "bucket"]
        out.append(steps.store(met.select(names).groupBy("bucket").applyInArrow(_factors(keep), _VERDICT), "verdicts"))
        many = sized.filter(F.col("size") > GROUP)
        if not many.take(1):
            steps.drop(sized)
            return out
        # single windows are decided by what they share; wider ranges are halved
        one = many.filter("r0 = r1")
        where = F.struct("d", "t", "at")
        earliest = one.groupBy("h", "g").agg(F.min(where).alias("earliest"))
        begin = _start(F.col("at")) + F.col("r0") + _left(F.col("at"))
        decided = one if keep == "none" else one.join(earliest, ["h", "g"]).filter(where > F.col("earliest"))
        out.append(steps.store(decided.select("h", "c", "d", "t", begin.alias("lo"), begin.alias("hi")), "verdicts"))
        middle = F.floor((F.col("r0") + F.col("r1")) / 2).cast("long")
        halves = F.array(
            F.struct(F.col("r0").alias("r0"), middle.alias("r1")), F.struct((middle + 1).alias("r0"), F.col("r1").alias("r1"))
        )
        low = -_left(F.col("at"))
        finer = (
            many.filter("r0 < r1")
            .select("g", "h", "c", "d", "t", "at", "piece", F.explode(halves).alias("half"))
            .select("g", "h", "c", "d", "t", "at", "piece", "half.r0", "half.r1")
            .filter((low <= F.col("r1")) & (low + _span(F.col("at")) >= F.col("r0")))
        )
        core = F.substring("piece", (F.col("r1") - low + 1).cast("int"), (F.col("r0") - F.col("r1") + WINDOW).cast("int"))
        work = steps.store(finer.withColumn("g", F.xxhash64("h", "r0", core)), "finer")
        steps.drop(sized)


def find(docs: DataFrame, keep: str = "first") -> DataFrame:
    """Repeated spans of every row: doc_id, body (its bytes), spans (start, end; bytes, maximal, in order).

    ``keep`` is "first" (windows that have occurred before, in the order of doc_id, nulls
    first, and place; the first copy stays) or "none" (windows that occur elsewhere at
    all).  A null text counts as empty and has no spans, like any below ``WINDOW`` bytes.
    Rows that repeat count each for themselves with "none"; with "first", rows equal in
    ``doc_id`` and text are one document and keep the same bytes.  A null ``doc_id`` stays
    null.  Other columns are left out, whatever their names; no rows, no result.  ``docs`` is
    read again by several steps and must say the same each time, as tables do.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    bound_batches(spark)
    steps = Steps(spark, "repeats")
    keyed = _keyed(docs)
    rows = keyed.select("d", "t", "body").mapInArrow(_to_anchors, ANCHOR)
    where = F.struct("d", "t", "at")
    sums = [F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")]
    if keep == "first":
        sums.append(F.min(where).alias("earliest"))
    heads = steps.store(rows.groupBy("h").agg(*sums).filter("n > 1").drop("n"), "heads")
    met = steps.store(rows.join(heads, "h"), "candidates")
    steps.drop(heads)
    again = (lambda df: df) if keep == "none" else (lambda df: df.filter(where > F.col("earliest")))
    spans = [again(met.filter("not mixed"))]
    mixed = met.filter("mixed").select("d", "t", "h", "c", "at")
    classes = steps.store(mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(where).alias("earliest")), "classes")
    spans.append(again(mixed.join(classes.filter("n > 1"), ["h", "c"])))
    asked = classes.groupBy(F.col("earliest.d").alias("d"), F.col("earliest.t").alias("t")).agg(
        F.collect_list(F.struct("h", "c", F.col("earliest.at").alias("at"))).alias("asked")
    )
    bodies = keyed.groupBy("d", "t").agg(F.first("body").alias("body"))
    pieces = steps.store(bodies.join(asked, ["d", "t"]).mapInArrow(_cut, "h long, c long, d long, t long, at long, piece binary"), "pieces")
    whole = pieces.withColumns({"g": F.col("h"), "r0": F.lit(GRAM - WINDOW).cast("long"), "r1": F.lit(0).cast("long")})
    verdicts = _suffix_arrays(steps, whole, keep)
    steps.drop(pieces)
    ranges = [s.select("d", "t", _start(F.col("at")).alias("lo"), (_start(F.col("at")) + _span(F.col("at"))).alias("hi")) for s in spans]
    ranges += [v.select("d", "t", "lo", "hi") for v in verdicts]
    united = ranges[0]
    for r in ranges[1:]:
        united = united.union(r)
    lists = united.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    joined = keyed.join(lists, ["d", "t"], "left")
    # ranges of windows, in order of their starts, become spans of bytes
    start = lambda x: F.struct(x["lo"].alias("start"), (x["hi"] + WINDOW).alias("end"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select("doc_id", "body", F.coalesce(F.transform("ranges", start), none).alias("ranges")).mapInArrow(
        _merge, "doc_id long, body binary, spans array<struct<start:bigint,end:bigint>>"
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ranges = batch.column("ranges")
        flat = ranges.flatten()
        start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        counts = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        # the furthest end so far, in each row: rows are lifted above one another
        lift = row * (1 + (int(end.max()) if len(end) else 0))
        reach = np.maximum.accumulate(end + lift)
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (start[1:] + lift[1:] > reach[:-1])
        lo = np.flatnonzero(fresh)
        hi = np.append(lo[1:] - 1, len(row) - 1)[: len(lo)]
        own = np.bincount(row[lo], minlength=len(counts))
        values = pa.StructArray.from_arrays([pa.array(start[lo]), pa.array(reach[hi] - lift[lo])], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), spans.cast(kind)], ["doc_id", "body", "spans"])


def remove(found: DataFrame) -> DataFrame:
    """What ``find`` returns, with kept: the bytes outside the spans, one after another.

    Bytes may be parts of characters, as spans are of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "spans", "kept"])

    return found.mapInArrow(run, "doc_id long, body binary, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """Sizes and checksums, as the query returns them."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove(found).select(
        "doc_id",
        F.length("body").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: What the query returns over ``documents``, in DuckDB SQL: every window of every text.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT id, i, md5(b[i + 1 : i + {WINDOW}]) AS h FROM (SELECT id, b, unnest(range(0, octet_length(b)::BIGINT - {WINDOW - 1})) AS i FROM d)),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT id, i, i > coalesce(lag(i) OVER (PARTITION BY id ORDER BY i) + {WINDOW}, -1) AS fresh FROM w SEMI JOIN c USING (h)),
s AS (SELECT id, i, sum(fresh::INT) OVER (PARTITION BY id ORDER BY i) AS no FROM g),
p AS (SELECT id, no, min(i) AS a, max(i) + {WINDOW} AS e FROM s GROUP BY ALL),
k AS (SELECT id, a, e, coalesce(lag(e) OVER (PARTITION BY id ORDER BY a), 0) AS before FROM p),
q AS (SELECT id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS kept
  FROM k JOIN d USING (id) GROUP BY id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1 : octet_length(b)::BIGINT]))) AS kept_sha256 FROM d LEFT JOIN q USING (id)"""
