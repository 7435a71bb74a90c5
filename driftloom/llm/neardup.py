"""Near duplicates by BagMinHash: sketch, band, verify, connect.

A text is the multiset of its five-word shingles; similarity is the weighted Jaccard
coefficient, sum of smaller over sum of larger multiplicities.

*Sketch.*  Each shingle owns Poisson processes over discretised weights: one on
[0, 1) and one on each [2^k, 2^(k+1)).  A process's points have a time, a weight level
uniform in its range and a register.  A text of multiplicity w sees the points below
level w, in order of time and only as far as its registers need; a register keeps its
first point.  Two texts' registers agree with the probability of their similarity.

*Band.*  Texts of one shingle multiset are one node, named by 128 bits of its content.
Nodes that share a band of registers meet in a bucket.  First each node is compared with
the largest hub of its buckets, which joins most of a large group of copies.  In the
buckets that still hold several components, the strays (nodes outside the largest hub's
component) meet all members, in blocks of bounded size.  A block first compares
registers and lets go of nodes without a likely partner.  The others get their texts;
the block decides the pairs that agree enough by their exact multisets, most alike
first, and passes over pairs that its links already connect.  So each pair of a bucket whose
registers agree enough is decided or within one component, nothing is capped, and what
leaves a block is at most one link for each of its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import is_empty, limit_threads, quoted, stored, unused, whole_text
from driftloom.llm.words import Words, grouped, mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Registers' agreement below which a pair can't be similar: over 5 deviations off.
LEAST_AGREEMENT = 0.6
#: Nodes, and characters of their texts, that a block has of members and of strays, about.
BLOCK, BLOCK_CHARS = 2048, 16 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A hash per five-word shingle, and how many each text has.

    A text of fewer words has one shingle, of all its words; one without words none.
    """
    h = words.hashes()
    counts = np.where(words.counts > 0, np.maximum(words.counts - SHINGLE + 1, 1), 0)
    begins = np.repeat(words.firsts, counts)
    at = begins + np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.repeat(words.firsts + words.counts, counts)
    total = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    for j in range(SHINGLE):
        total += np.where(at + j < ends, padded[at + j], np.uint64(0)) * _ODD[j]
    return mix(total), counts


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_min_hash(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (doc, register) of weighted sets: numbers below 2**24.

    ``keys`` are the elements' hashes, ``weights`` whole numbers from 1; ``doc`` ascends.
    Documents without elements have the register -1.
    """
    out = np.full((n_docs, m), -1, np.int64)
    todo = np.unique(doc)
    total = np.bincount(doc, weights=weights, minlength=n_docs)
    reach = 4.0
    while len(todo):
        use = np.isin(doc, todo, assume_unique=False) if len(todo) < n_docs else slice(None)
        key, weight, of = keys[use], weights[use], doc[use]
        horizon = np.full(n_docs, np.inf)
        horizon[todo] = (np.log(m) + reach) / total[todo]
        # strips of levels: [0, 1), [1, 2), [2, 4), [4, 8) ... below the weight
        strips = np.where(weight > 1, 2 + np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64), 1)
        item = np.repeat(np.arange(len(key)), strips)
        strip = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
        low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
        width = np.where(strip > 0, low, 1.0)
        seed = mix(key[item] + (strip.astype(np.uint64) + np.uint64(1)) * _ODD[1])
        of, top = of[item], weight[item].astype(np.float64)
        scale = 1.0 / (width * m)
        limit = horizon[of]
        time = np.zeros(len(item))
        registers = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
        step = 0
        while len(seed):
            draw = mix(seed + np.uint64((2 * step + 1) * int(_ODD[2]) & (1 << 64) - 1))
            time = time - np.log(_uniform(draw)) * scale
            live = time < limit
            if not live.all():
                seed, of, top, scale, limit, time = (x[live] for x in (seed, of, top, scale, limit, time))
                low, width, draw = low[live], width[live], draw[live]
                if not len(seed):
                    break
            mark = mix(draw + _ODD[3])
            level = low + np.floor(_uniform(mix(mark + _ODD[4])) * width * (1 - 2.0**-53))
            seen = level < top
            slot = (mark >> np.uint64(40)).astype(np.int64) * m >> 24
            value = (time / limit * 2.0**39).astype(np.uint64) << np.uint64(24) | (mark & np.uint64(0xFFFFFF))
            np.minimum.at(registers, of[seen] * m + slot[seen], value[seen])
            step += 1
        table = registers.reshape(n_docs, m)[todo]
        full = (table != np.iinfo(np.uint64).max).all(axis=1)
        out[todo[full]] = (table[full] & np.uint64(0xFFFFFF)).astype(np.int64)
        todo = todo[~full]
        reach *= 2
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band (doc, band)."""
    bands = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _ODD[0]
    for k in range(ROWS):
        total = mix(total ^ (bands[:, :, k] + np.uint64((k + 1) * int(_ODD[1]) & (1 << 64) - 1)))
    return total.view(np.int64)


_SKETCH = "doc long, h1 long, h2 long, chars long, node binary, size long, bands array<long>, sig binary"


def sketch_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two content hashes, the number of shingles, and registers, of each text."""
    k1, k2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    sizes = np.zeros(len(texts), np.int64)
    registers = np.full((len(texts), REGISTERS), -1, np.int64)
    for start, end in grouped(texts):
        for a in range(start, end, 2048):
            b = min(a + 2048, end)
            words = Words(texts[a:b], digits=True)
            h, counts = shingle_hashes(words)
            if not len(h):
                continue
            sizes[a:b] = counts
            doc = np.repeat(np.arange(b - a), counts)
            # sums over the multiset: equal for equal multisets, in any order
            begins = np.append(0, np.cumsum(counts))
            for k, odd in ((k1, _ODD[3]), (k2, _ODD[4])):
                sums = np.append(np.uint64(0), np.cumsum(mix(h ^ odd), dtype=np.uint64))
                k[a:b] = mix(sums[begins[1:]] - sums[begins[:-1]] + counts.astype(np.uint64))
            keys = np.sort(doc.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12))
            first = np.append(True, keys[1:] != keys[:-1])
            at = np.flatnonzero(first)
            weights = np.diff(np.append(at, len(keys)))
            keys = keys[at]
            own = (keys >> np.uint64(52)).astype(np.int64)
            registers[a:b] = bag_min_hash(keys << np.uint64(12), weights, own, b - a)
    return k1, k2, sizes, registers


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each register is kept: unlike registers agree by chance in 1 of 256, which only adds pairs to verify."""
    limit_threads()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            k1, k2, sizes, registers = sketch_texts(batch.column("text").to_pylist())
            plain = registers[:, 0] < 0  # no words: its text's own hashes name it
            content = np.stack([np.where(plain, batch.column(h), k.view(np.int64)) for h, k in (("h1", k1), ("h2", k2))], axis=1)
            bands = band_keys(registers)
            offsets = np.where(plain, 0, BANDS).cumsum()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc", "h1", "h2", "chars")),
                    pa.array([x.tobytes() for x in content], pa.binary()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.append(0, offsets).astype(np.int32)), pa.array(bands[~plain].ravel())),
                    pa.array([r.tobytes() for r in registers.astype(np.uint8)], pa.binary()),
                ],
                [f.split()[0] for f in _SKETCH.split(", ")],
            )


def _likely(sig: np.ndarray, size: np.ndarray, own_sig: np.ndarray, own_size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be similar, by registers and sizes, and the registers in which they differ."""
    off = (sig != own_sig).sum(axis=1)
    low, high = np.minimum(size, own_size), np.maximum(size, own_size)
    return (off <= REGISTERS * (1 - LEAST_AGREEMENT) + 1e-9) & (low >= THRESHOLD * high - 1e-6), off


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_signatures(batch.column(c)) for c in ("sig_a", "sig_b"))
        good, _ = _likely(a, batch.column("size_a").to_numpy(), b, batch.column("size_b").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(good))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return float(similarities(a, [b])[0])


def similarities(own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard coefficients of a multiset (sorted hashes, counts) with others."""
    h, n = own
    keys, counts = (np.concatenate(x) for x in zip(*others, strict=True))
    of = np.repeat(np.arange(len(others)), [len(x[0]) for x in others])
    both = np.zeros(len(others), np.int64)
    if len(h) and len(keys):
        at = np.searchsorted(h, keys)
        at[at == len(h)] = 0
        met = h[at] == keys
        both = np.bincount(of[met], weights=np.minimum(counts[met], n[at[met]]), minlength=len(others)).astype(np.int64)
    either = n.sum() + np.bincount(of, weights=counts, minlength=len(others)).astype(np.int64) - both
    return both / np.maximum(either, 1)


def _multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    h, _ = shingle_hashes(Words([text], digits=True))
    return np.unique(h, return_counts=True)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose multisets are similar; hubs come in runs, so the last few are remembered."""
    limit_threads()
    last: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def of(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in last:
            if len(last) >= 64:
                last.clear()
            last[node] = _multiset(text)
        return last[node]

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
        ok = [weighted_jaccard(of(a, s), of(b, t)) >= THRESHOLD for a, b, s, t in rows]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): node, component (its smallest node).

    Labels go to neighbours' minima and then to their labels' labels, until nothing
    changes: about the logarithm of the longest path in rounds.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        )
        near = labels.join(heard, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = near.join(far, "component", "left").select(
            "node",
            F.least("component", F.coalesce("further", "component")).alias("component"),
            (F.least("component", F.coalesce("further", "component")) < F.col("old")).alias("changed"),
        )
        moved = stored(moved, "labels")
        labels = moved.drop("changed")
        if is_empty(moved.filter("changed")):
            return labels


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b): each node and, of its buckets' largest hubs, the one it shares most buckets with.

    A hub meets many others in its buckets; the text that copies were made from meets
    the most of them.
    """
    hubs = buckets.groupBy("band").agg(F.max(F.struct("hub", "node"))["node"].alias("b"))
    met = buckets.join(hubs, "band").filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    return met.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))


def _blocks(members: DataFrame, data: DataFrame) -> DataFrame:
    """Blocks (band, i, j) of nodes to compare: node, component, stray, and the columns of ``data``.

    In each bucket with several components, the strays are those that aren't in its
    largest hub's.  Pairs of different components have a stray, so strays against all
    members are all of them.  Members are dealt to blocks i and strays to blocks j; every
    member meets every stray in one block.  ``members`` has band, node, chars, hub, component.
    """
    main = members.groupBy("band").agg(
        F.max(F.struct("hub", "node", "component"))["component"].alias("main"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
    )
    open_ = members.join(main.filter("least < most").select("band", "main"), "band").withColumn("stray", F.col("component") != F.col("main"))
    share = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_CHARS)).cast("int")
    sizes = open_.groupBy("band").agg(
        share(F.count("*"), F.sum("chars")).alias("n_i"),
        share(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("chars")).otherwise(0))).alias("n_j"),
    )
    rows = open_.join(sizes, "band").select("band", "node", "component", "stray", "n_i", "n_j").join(data, "node")
    at = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    own = ("node", "component", *(c for c in data.columns if c != "node"))
    against = rows.select("band", at("n_i", 1).alias("i"), every("n_j").alias("j"), *own, F.lit(False).alias("stray"))
    strays = rows.filter("stray").select("band", every("n_i").alias("i"), at("n_j", 2).alias("j"), *own, F.lit(True).alias("stray"))
    return against.unionByName(strays)


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


class _Block:
    """What tells a block's likely pairs: strays and members of unlike components that meet here first."""

    def __init__(self, rows: pa.Table) -> None:
        stray = rows.column("stray").to_numpy(zero_copy_only=False)
        self.strays, self.members = np.flatnonzero(stray), np.flatnonzero(~stray)
        self.component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        self.size, self.sig = rows.column("size").to_numpy(), _signatures(rows.column("sig"))
        bands = pa.compute.list_flatten(rows.column("bands")).to_numpy().reshape(-1, BANDS)
        self.earlier = bands[:, : int((bands[0] == rows.column("band")[0].as_py()).argmax())]

    def partners(self, x: int) -> np.ndarray:
        """Members that may be similar to a stray, the most alike first."""
        others = self.members[self.component[self.members] != self.component[x]]
        good, off = _likely(self.sig[others], self.size[others], self.sig[x], self.size[x])
        good &= ~(self.earlier[others] == self.earlier[x]).any(axis=1)
        return others[good][np.argsort(off[good], kind="stable")]


def likely_rows(rows: pa.Table) -> np.ndarray:
    """Which rows of a block have a likely partner in it."""
    block, out = _Block(rows), np.zeros(len(rows), bool)
    for x in block.strays.tolist():
        partners = block.partners(x)
        out[partners] = True
        out[x] = len(partners) > 0
    return out


def block_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links (row numbers) of a block's strays with its members, as many as its components need.

    Of each stray's likely partners in other components, the most alike are decided
    first.  Partners that a link connects to the stray are passed over, and so are
    pairs that meet in an earlier band, as they are decided there.
    """
    block, text = _Block(rows), rows.column("text")
    component = block.component
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    links: list[tuple[int, int]] = []

    def of(row: int) -> tuple[np.ndarray, np.ndarray]:
        if row not in sets:
            sets[row] = _multiset(text[row].as_py())
        return sets[row]

    for x in block.strays.tolist():
        left = block.partners(x)
        while len(left):
            few, left = left[:16], left[16:]
            alike = similarities(of(x), [of(y) for y in few.tolist()]) >= THRESHOLD
            for y in few[alike].tolist():
                if component[y] != component[x]:
                    links.append((x, y))
                    component[component == component[y]] = component[x]
            if alike.any():
                left = left[component[left] != component[x]]
    return links


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks of (band, i, j), whose rows follow each other."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        band, i, j = (table.column(c).to_numpy() for c in ("band", "i", "j"))
        new = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        begins = [0, *new.tolist()]
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(begins[-1])
    if rest is not None:
        yield rest


def _keep_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for block in _each_block(batches):
        yield from block.filter(pa.array(likely_rows(block))).to_batches()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit_threads()
    for block in _each_block(batches):
        if found := block_links(block):
            node = block.column("node").combine_chunks()
            ends = [node.take(pa.array(list(x), pa.int64())) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _links(buckets: DataFrame, data: DataFrame) -> DataFrame:
    """Component of every node with a link: node, component.  ``buckets``: band, node, chars, hub; ``data``: node, size, bands, sig, text."""
    of = lambda c, *names: data.select(F.col("node").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in names))
    starred = _hub_pairs(buckets).join(of("a", "sig", "size"), "a").join(of("b", "sig", "size"), "b")
    likely = starred.select("a", "b", "sig_a", "sig_b", "size_a", "size_b").mapInArrow(_agreement, "a binary, b binary")
    pairs = stored(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.join(of("a", "text"), "a").join(of("b", "text"), "b").select("a", "b", "text_a", "text_b")
    links = stored(both.mapInArrow(_verify, "a binary, b binary"), "links")
    known = components(links)
    members = buckets.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = _blocks(members, data.drop("text"))
    likely = stored(_dealt(blocks).mapInArrow(_keep_likely, blocks.schema), "likely")
    texts = likely.join(of("node", "text").withColumnRenamed("text_node", "text"), "node")
    more = stored(_dealt(texts).mapInArrow(_decide, "a binary, b binary").distinct(), "links")
    return known if is_empty(more) else components(links.union(more))


def _labelled(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its class: doc, h1, h2 (hashes of its text), component."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), *_text_hashes(text), F.length(text).cast("long").alias("chars"))
    sketched = stored(rows.mapInArrow(_sketch, _SKETCH), "sketches")
    columns = ("size", "bands", "sig")
    nodes = sketched.groupBy("node").agg(F.min(F.struct("h1", "h2", "chars")).alias("h"), *(F.first(c).alias(c) for c in columns))
    nodes = stored(nodes.select("node", "h.*", *columns), "nodes")
    bands = nodes.select("node", "chars", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(bands.join(shared, "band"), "buckets")
    hubs = buckets.groupBy("node").agg(F.sum("n").alias("hub"))
    buckets = stored(buckets.join(hubs, "node").select("band", "node", "chars", "hub"), "buckets")
    # the data of nodes in buckets; it grows with the corpus, so the plan is the same at every size
    wanted = nodes.join(hubs.select("node").hint("merge"), "node", "left_semi").hint("merge")
    texts = rows.select("h1", "h2", "text").join(wanted, ["h1", "h2"])
    data = texts.groupBy("node").agg(*(F.first(c).alias(c) for c in (*columns, "text")))
    known = _links(buckets, stored(data, "node-data"))
    labelled = sketched.select("doc", "h1", "h2", "node").join(known, "node", "left")
    return stored(labelled.select("doc", "h1", "h2", F.coalesce("component", "node").alias("component")), "labelled")


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")


def classes(docs: DataFrame) -> DataFrame:
    """Near-duplicate class of every row of ``docs``: doc_id, class_id.

    ``class_id`` is the smallest doc_id of the class.  Where rows of unlike texts share
    a doc_id and so two classes would share their smallest one, or a class has only
    null ones, it is a negative number drawn from the class's content.  Texts with equal
    shingle multisets are alike; texts without words are alike only where they are equal
    (a null text counts as empty).  Rows that repeat each have their row, and a null
    doc_id stays null.  Other columns are left out, whatever their names; no rows, no result.
    """
    labelled = _labelled(docs)
    firsts = labelled.groupBy("component").agg(F.min("doc").alias("first"))
    owners = firsts.groupBy("first").agg(F.min("component").alias("owner"))
    own = -F.xxhash64("component").bitwiseAND((1 << 62) - 1) - 1
    ids = firsts.join(owners, "first", "left").select(
        "component", F.when(F.col("component") == F.col("owner"), F.col("first")).otherwise(own).alias("class_id")
    )
    return labelled.join(ids, "component").select(F.col("doc").alias("doc_id"), "class_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest doc_id.

    Null ids come last; rows of unlike texts stay, also where they share a doc_id, and
    of rows that repeat one stays.  A null text counts as empty.  All columns stay as
    they are, whatever their names; no rows, no result.
    """
    labelled = _labelled(docs)
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "h1", "h2")
    key = unused("key", docs.columns)
    named = lambda doc, *hashes: F.concat_ws(":", doc.cast("string"), *(h.cast("string") for h in hashes))
    kept = labelled.groupBy("component").agg(F.min(row).alias("r"))
    kept = kept.select(named(F.col("r.doc"), F.col("r.h1"), F.col("r.h2")).alias(key))
    own = named(F.col("doc_id").cast("long"), *_text_hashes(whole_text()))
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).select(*quoted(docs.columns))
