"""Packing of documents into fixed windows by non-negative least squares.

Documents are cut into full windows and one shorter tail.  The tails' lengths form
a histogram ``h`` (fewer entries than the window has tokens, whatever the corpus).
Shallow combinations of lengths (pairs, and triples with one length on a grid)
that fill a window exactly are the columns of ``A``; ``min |A x - h|, x >= 0`` says
how often to use each.  Rounded down to what is there and topped up greedily, the
counts give every tail of a length a place by its rank alone.  What no combination
takes is laid end to end, length after length, and cut at window bounds.  So a
place is a closed formula of (length, rank), and no task sees more than its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.bpe import DEFAULT_TOKENIZER, encoder
from driftloom.llm.common import stored, whole_text

PIECE_SCHEMA = (
    "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, "
    "part int, full boolean, rank long, row long, tail_ids binary"
)
#: Steps of the least-squares solver.
SOLVER_STEPS = 400


def combinations(window: int, grid: int = 64) -> np.ndarray:
    """Rows of three lengths, zeros after the last, that add up to ``window``."""
    half = np.arange(1, window // 2 + 1)
    pairs = np.stack([window - half, half, np.zeros_like(half)], axis=1)
    triples = [
        (a, b, c)
        for a in range(grid, window, grid)
        for b in range(1, (window - a) // 2 + 1)
        if (c := window - a - b) > 0
    ]
    found = np.sort(np.array(triples, dtype=np.int64).reshape(-1, 3), axis=1)[:, ::-1]
    return np.concatenate([pairs, np.unique(found, axis=0)])


def solve_counts(hist: np.ndarray, combos: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - hist|: accelerated projected gradient."""
    size = len(hist)
    h = hist.astype(float)
    h[0] = 0.0
    use = np.zeros(size)
    np.add.at(use, combos[combos > 0], 1.0)
    lipschitz = 3.0 * max(use.max(), 1.0)  # a row sum of A'A is at most this
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        got = np.bincount(combos.ravel(), weights=np.repeat(y, 3), minlength=size)
        got[0] = 0.0
        gap = got - h
        new = np.maximum(0.0, y - gap[combos].sum(axis=1) / lipschitz)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_windows(hist: np.ndarray, window: int) -> tuple[list[tuple], list[tuple], int]:
    """Places for all tails, from the histogram of their lengths.

    Returns ``(segments, stream, n_windows)``.  A segment (length, lo, hi, window,
    copies, offset) gives the tails of that length with lo <= rank < hi the windows
    from ``window`` on, ``copies`` to a window, the first at ``offset``.  A stream
    entry (length, lo, hi, position) lays its tails end to end from ``position``.
    """
    combos = combinations(window)
    left = hist.astype(np.int64).copy()
    left[0] = 0
    share = solve_counts(left, combos)
    segments: list[tuple] = []
    used = np.zeros_like(left)
    windows = 0

    def take(combo: np.ndarray, most: int) -> None:
        nonlocal windows
        lengths, copies = np.unique(combo[combo > 0], return_counts=True)
        n = int(min([most, *(left[lengths] // copies)]))
        if n <= 0:
            return
        offset = 0
        for length, k in zip(lengths[::-1].tolist(), copies[::-1].tolist(), strict=True):
            lo = int(used[length])
            segments.append((length, lo, lo + n * k, windows, k, offset))
            used[length] += n * k
            left[length] -= n * k
            offset += length * k
        windows += n

    order = np.argsort(-share, kind="stable")
    for j in order[share[order] >= 0.5]:
        take(combos[j], int(share[j] + 0.5))
    for j in order:  # what rounding left, greedily
        if left[combos[j][0]] and left[combos[j][1]]:
            take(combos[j], int(left.max()))
    stream, position = [], 0
    for length in np.flatnonzero(left)[::-1].tolist():
        lo, n = int(used[length]), int(left[length])
        stream.append((length, lo, lo + n, position))
        position += n * length
    return segments, stream, windows


def _cut(window: int, end_id: int, tokenizer: str, specials_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        codec, end = encoder(tokenizer, specials_as_text), np.array([end_id], dtype="<u4").tobytes()
        fulls, row, ranks = 0, 0, np.zeros(window, dtype=np.int64)
        width = 4 * window
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[tuple] = []
                for doc, ids in zip(
                    batch.column("doc_id").to_pylist(),
                    codec.encode(batch.column("text").to_pylist()),
                    strict=True,
                ):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, len(ids), width):
                        own = ids[a : a + width]
                        full, size = len(own) == width, len(own) // 4
                        if full:
                            rank, fulls = fulls, fulls + 1
                        else:
                            rank = int(ranks[size])
                            ranks[size] += 1
                        out.append((doc, a // 4, size, zlib.crc32(own), n, part, full, rank, row, None if full else own))
                        row += 1
                names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, tokenizer: str = DEFAULT_TOKENIZER, specials_as_text: bool = False) -> DataFrame:
    """Pack every whole ``text`` of ``docs`` into sequences of ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Only the last sequence is shorter than ``window``; its
    reader pads it.  Empty and null texts are the end id alone.  Rows that repeat
    (also a ``doc_id``) are packed each for itself; a null ``doc_id`` stays null.
    Other columns are left out.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    pieces = stored(rows.mapInArrow(_cut(window, end_id, tokenizer, specials_as_text), PIECE_SCHEMA), "pieces")

    counts = stored(pieces.groupBy("part", "full", "length").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(window, dtype=np.int64)
    n_full = 0
    for r in counts.groupBy("full", "length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        if r["full"]:
            n_full = r["n"]
        else:
            hist[r["length"]] = r["n"]
    segments, stream, n_combined = plan_windows(hist, window)

    earlier = Window.partitionBy("full", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    # they grow with the corpus, a row per part and length: the same plan at every size
    narrow = pieces.drop("tail_ids").join(bases.hint("merge"), ["part", "full", "length"])
    ranked = narrow.withColumn("rank", F.col("rank") + F.col("base")).drop("base")

    result = ("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens")
    at_full = ranked.filter("full").select(*result, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = ranked.filter("not full").drop("full")

    # both tables have at most a few rows per combination of lengths
    table = spark.createDataFrame(segments, "l int, lo long, hi long, window long, copies int, at int")
    inside = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    k = F.col("rank") - F.col("lo")
    at_segment = tails.join(F.broadcast(table), inside).select(
        *result,
        (F.lit(n_full) + F.col("window") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("copies").cast("long")) * F.col("length")).cast("long").alias("offset"),
    )

    base = n_full + n_combined
    table = spark.createDataFrame(stream, "l int, lo long, hi long, position long")
    streamed = tails.join(F.broadcast(table), inside).withColumn(
        "position", F.col("position") + (F.col("rank") - F.col("lo")) * F.col("length")
    )
    streamed = streamed.withColumn("offset", F.pmod("position", F.lit(window).cast("long"))).withColumn(
        "sequence_id", F.lit(base).cast("long") + F.floor(F.col("position") / window)
    )
    fits = F.col("offset") + F.col("length") <= window
    at_stream = streamed.filter(fits).select(*result, "sequence_id", "offset")
    cut = streamed.filter(~fits).select(
        "part", "row", "sequence_id", "offset", (F.lit(window) - F.col("offset")).cast("int").alias("head")
    )
    both = pieces.filter("not full").join(cut, ["part", "row"])
    halves = both.select(
        "doc_id",
        "doc_tokens",
        F.explode(
            F.array(
                F.struct(
                    F.col("start").alias("start"),
                    F.col("head").alias("length"),
                    F.expr("substring(tail_ids, 1, 4 * head)").alias("ids"),
                    F.col("sequence_id").alias("sequence_id"),
                    F.col("offset").alias("offset"),
                ),
                F.struct(
                    (F.col("start") + F.col("head")).alias("start"),
                    (F.col("length") - F.col("head")).alias("length"),
                    F.expr("substring(tail_ids, 1 + 4 * head)").alias("ids"),
                    (F.col("sequence_id") + 1).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"),
                ),
            )
        ).alias("p"),
    ).select(
        "doc_id",
        "p.start",
        F.col("p.length").cast("long").alias("length"),
        F.crc32("p.ids").alias("ids_crc32"),
        "doc_tokens",
        "p.sequence_id",
        "p.offset",
    )
    return at_full.unionByName(at_segment).unionByName(at_stream).unionByName(halves)


def padding(lengths: list[int], window: int) -> int:
    """Padding tokens of sequences with these lengths: none at a power of two."""
    return sum(window - n for n in lengths if n & (n - 1))


def is_gapless(pieces: list[tuple[int, int]]) -> bool:
    """Whether (offset, length) pieces of one sequence follow each other from 0."""
    ordered = sorted(pieces)
    return bool(ordered) and ordered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(ordered))
