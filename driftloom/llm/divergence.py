"""How far the sources of a language are from each other and from the language, by their words.

Terms are runs of letters and of bytes from 0x80 on.  A lookup table over the concatenated
UTF-8 bytes of many texts finds their boundaries; equal slices are grouped by xxhash and
compared byte by byte; counts per (lang, source, term) leave a task once for each unit of
texts.  Spark adds them up per term, keeps the terms of enough documents, and deals these
to buckets.  A bucket of a language is a CSR matrix, sources by terms, from which divergences
are summed with ``reduceat``: for each source that stands as the other one, over the
entries alone; terms that a source lacks have one share and are added as a whole.

With p and q as whole shares of ``SCALE``, one more than floor, a term's divergence is
floor((p - q)^2 / q).  All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import Steps, bound_batches, limit_threads
from driftloom.llm.slices import as_strings, distinct, runs, units

#: Documents of its language that a term needs; ranks that the report of terms has.
MIN_DOCUMENTS, TOP = 3, 200
SCALE = 1_000_000_000
#: Bytes of a unit (one text at least), and terms of a bucket.
UNIT_BYTES, BUCKET_TERMS = 8_000_000, 50_000
#: Numbers that are worked on at once.
BLOCK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_COUNT = "lang string, source string, term string, n long, documents long"


def count_terms(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one unit: group, start and end of a term's slice, occurrences, documents."""
    starts, ends = runs(_LETTER[raw], offsets[:-1][np.diff(offsets) > 0])
    first, number = distinct(raw, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pair, n = np.unique(number * len(group) + doc, return_counts=True)
    term, where = pair // max(len(group), 1), group[pair % max(len(group), 1)] if len(pair) else pair
    groups = int(group.max()) + 1 if len(group) else 1
    key, at = np.unique(term * groups + where, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    documents = np.bincount(at, minlength=len(key)).astype(np.int64)
    own = first[key // groups] if len(key) else key
    return key % groups, starts[own], ends[own], total, documents


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for raw, offsets, others in units(batches, "body", UNIT_BYTES):
        raw = _LOWER[raw]
        codes: dict[tuple[str, str], int] = {}
        group = np.array([codes.setdefault(x, len(codes)) for x in zip(others["lang"], others["source"], strict=True)], np.int64)
        where, start, end, n, documents = count_terms(raw, offsets, group)
        names = list(codes)
        columns = [pa.DictionaryArray.from_arrays(pa.array(where, pa.int64()), pa.array([x[k] for x in names], pa.string())).cast(pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, as_strings(raw, start, end), pa.array(n), pa.array(documents)], [f.split()[0] for f in _COUNT.split(", ")])


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly; ``count`` is below ``total``."""
    up = count + 1
    if len(up) and int(up.max()) > (1 << 63) // SCALE - 1:
        whole, rest = np.divmod(up, total)
        for _ in range(9):  # SCALE has nine zeros: one digit after another
            digit, rest = np.divmod(rest * 10, total)
            whole = whole * 10 + digit
        return 1 + whole
    return 1 + up * SCALE // total


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def segment_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix; empty rows are 0."""
    out = np.zeros(len(indptr) - 1, np.int64)
    full = np.diff(indptr) > 0
    if full.any():
        out[full] = np.add.reduceat(values, indptr[:-1][full])
    return out


def pair_sums(indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, terms: int, total: np.ndarray) -> Iterator[np.ndarray]:
    """For each source as the other one: divergences of all sources from it, over all terms.

    A CSR matrix of counts, sources by ``terms``; ``total`` is N + V of each source.
    """
    sizes = np.diff(indptr)
    row = np.repeat(np.arange(len(sizes)), sizes)
    p, none = shares(data, total[row]), shares(np.zeros(len(sizes), np.int64), total)
    for t in range(len(sizes)):
        own = slice(indptr[t], indptr[t + 1])
        q = np.full(terms, none[t])
        q[indices[own]] = p[own]
        met = q[indices]
        # where a source lacks the term: all terms as if it lacked them, but for those that it has
        out = segment_sums(_gap(p, met) - _gap(none[row], met), indptr)
        out += (terms - sizes[t]) * _gap(none, none[t])
        step = max(1, BLOCK // max(1, len(sizes)))
        for a in range(indptr[t], indptr[t + 1], step):
            out += _gap(none[:, None], p[None, a : min(a + step, indptr[t + 1])]).sum(1)
        yield out


def _order(column: pa.Array) -> np.ndarray:
    return pc.sort_indices(column.cast(pa.binary())).to_numpy()


_ROW = "lang string, source string, part string, item string, value long"


def _bucket(top: int):
    """Both reports of one bucket of terms of one language, as parts of sums and of ranks."""

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        limit_threads()
        groups = groups.combine_chunks()
        sources = groups.column("source").combine_chunks()
        by_name = _order(sources)
        sources = sources.take(pa.array(by_name))
        lang, v, all_n = (groups.column(n)[0].as_py() for n in ("lang", "v", "lang_n"))
        total = groups.column("n").to_numpy()[by_name] + v
        size = len(sources)
        names, out = [f.split()[0] for f in _ROW.split(", ")], []

        def rows(source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> None:
            k = len(value)
            columns = [pa.array([lang] * k, pa.string()), sources.take(pa.array(source, pa.int64())), pa.array([part] * k, pa.string()), item, pa.array(value, pa.int64())]
            out.append(pa.table(columns, names))

        count = terms.num_rows
        if count:
            terms = terms.combine_chunks()
            terms = terms.take(pa.array(_order(terms.column("term").combine_chunks())))
            entries = terms.column("entries").combine_chunks()
            flat = entries.flatten()
            term = np.repeat(np.arange(count), entries.value_lengths().to_numpy())
            code = pc.index_in(flat.field(0), value_set=sources).to_numpy()
            n = flat.field(1).to_numpy()
            order = np.lexsort((term, code))
            row, indices, data = code[order], term[order], n[order]
            indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))])
        else:
            indptr, indices, data = np.zeros(size + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if v:
            pairs = pair_sums(indptr, indices, data, count, total) if count else iter([])
        else:
            pairs = (np.zeros(size, np.int64) for _ in range(size))
        for t, sums in enumerate(pairs):
            others = np.delete(np.arange(size), t)
            rows(others, "pair", pa.array([sources[t].as_py()] * len(others), pa.string()), sums[others])
        if count:
            of_lang = np.bincount(indices, weights=data, minlength=count) if all_n < 1 << 53 else None
            of_lang = np.zeros(count, np.int64) if of_lang is None else of_lang.astype(np.int64)
            if all_n >= 1 << 53:
                np.add.at(of_lang, indices, data)
            p, q = shares(data, total[row]), shares(of_lang, all_n + v)[indices]
            high = np.flatnonzero(p > q)
            value = _gap(p[high], q[high])
            best = np.lexsort((indices[high], -value, row[high]))
            own = row[high][best]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            best = best[place < top]
            rows(row[high][best], "term", terms.column("term").combine_chunks().take(pa.array(indices[high][best])), value[best])
        kinds = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in _ROW.split(", ")])
        return pa.concat_tables(out).cast(kinds) if out else kinds.empty_table()

    return run


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Divergences of sources: lang, source, part, item, value, rank.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that the source has more of than its language.  Ranks go by value, then by the item's
    bytes.  Null text, lang and source count as empty ones.  A group without terms is
    compared like any other; one that is its language's only source has no pairs.  Rows that
    repeat count each for itself, ties in value are ranked by item, and no rows give no
    result.  Other columns are left out, whatever their names.  The pairs of a language grow
    with the square of its sources, as every pair is asked for.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    steps = Steps(spark, "divergence")
    said = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("lang", "source")}
    rows = docs.select(*(c.alias(n) for n, c in said.items()), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    counts = rows.mapInArrow(_counts, _COUNT).repartition("lang", "term")
    summed = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = (
        summed.groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("entries"))
        .filter(F.col("documents") >= min_documents)
        .drop("documents")
    )
    kept = steps.store(kept, "terms")
    own = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    known = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["n"])).alias("lang_n"))
    groups = (
        rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(known, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    )
    groups = steps.store(groups, "groups")
    buckets = 1 + kept.count() // BUCKET_TERMS
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    copied = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    parts = steps.store(dealt.groupBy("lang", "bucket").cogroup(copied.groupBy("lang", "bucket")).applyInArrow(_bucket(top), _ROW), "parts")
    steps.drop(kept, groups)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


#: The audit of ``documents`` in DuckDB SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP}"""
