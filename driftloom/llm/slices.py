"""Slices of byte buffers: boundaries from lookup tables, grouping by xxhash and exact bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def short_hashes(rows: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of a matrix of bytes, of fewer than 32 columns."""
    n, size = rows.shape
    out = np.full(n, _P5 + np.uint64(size), np.uint64)
    lanes = np.ascontiguousarray(rows)
    at = 0
    while size - at >= 8:
        lane = np.ascontiguousarray(lanes[:, at : at + 8]).view("<u8").ravel()
        out ^= _turned(lane * _P2, 31) * _P1
        out = _turned(out, 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        lane = np.ascontiguousarray(lanes[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
        out ^= lane * _P1
        out = _turned(out, 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        out ^= lanes[:, k].astype(np.uint64) * _P5
        out = _turned(out, 11) * _P1
    for bits, prime in ((33, _P2), (29, _P3)):
        out = (out ^ out >> np.uint64(bits)) * prime
    return out ^ out >> np.uint64(32)


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slice of each distinct one, and the number of each slice's distinct one.

    Slices of one length are grouped by XXH64 and then compared with the first of their
    group, byte by byte; only where a hash stands for unlike slices are bytes sorted.
    """
    sizes = ends - starts
    number = np.zeros(len(starts), np.int64)
    if not len(starts):
        return number, number
    firsts: list[np.ndarray] = []
    known = 0
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        own, size = order[a:b], int(sizes[order[a]])
        rows = np.lib.stride_tricks.sliding_window_view(raw, size)[starts[own]] if size else np.zeros((len(own), 0), np.uint8)
        if size < 32:
            keys = short_hashes(rows)
        else:
            keys = np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), np.uint64, len(rows))
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        if size and (rows != rows[first[group]]).any():
            _, first, group = np.unique(np.ascontiguousarray(rows).view(f"V{size}").ravel(), return_index=True, return_inverse=True)
        number[own] = known + group
        firsts.append(own[first])
        known += len(first)
    return np.concatenate(firsts), number


def as_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow column."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, ends - starts)
    data = np.ascontiguousarray(raw[places]) if len(places) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def runs(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs; a run never goes on where a text begins."""
    first = np.zeros(len(inside) + 1, bool)
    first[begins] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def units(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, list]]]:
    """Rows gathered to about ``most`` bytes (one text at least): their bytes, where texts begin and end, other columns."""
    bodies: list[bytes] = []
    others: dict[str, list] = {}
    size = 0

    def whole() -> tuple[np.ndarray, np.ndarray, dict[str, list]]:
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        return np.frombuffer(b"".join(bodies), np.uint8), offsets, others

    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        columns = {n: batch.column(n).to_pylist() for n in names}
        for k, body in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
            if bodies and size + len(body) > most:
                yield whole()
                bodies, others, size = [], {}, 0
            bodies.append(body)
            size += len(body)
            for n in names:
                others.setdefault(n, []).append(columns[n][k])
    if bodies:
        yield whole()
