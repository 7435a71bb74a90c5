"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` carries 8-bit samples as access units in packetised elementary packets of
one private stream, under a program association and a program map table.  Each
unit has a presentation time stamp; the first packet of each has a clock
reference, and every few units one is a random-access point.  ``demux`` reads any
single stream of this kind: it follows the tables to the stream, checks the
continuity counters of the tables' and the stream's packets, passes over packets that
were sent twice, and reassembles the units.

The streams are a binary Parquet column; beside it, time stamps and byte offsets of
the random-access points let a reader seek without the rest of the stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stored, whole_text

#: Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD
CLOCK = 90_000
#: Payload lengths are a positive multiple of this.
ALIGN = 64
#: Samples of an access unit, samples a second, units between random-access points.
UNIT, RATE, RAP_EVERY = 8_192, 8_000, 4
#: Units between repetitions of the tables.
TABLES_EVERY = 16


@lru_cache(maxsize=64)
def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    return head + _crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    stream = bytes([PRIVATE_STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
    pmt = _section(0x02, 1, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0]) + stream)
    return pat, pmt


def _pes_head(pts: int, size: int) -> bytes:
    length = size + 8
    return bytes(
        [0, 0, 1, PRIVATE_STREAM_ID, length >> 8 & 255, length & 255, 0x80, 0x80, 5]
        + [0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1]
    )


def _adaptation(size: int, pcr: int, random_access: bool) -> bytes:
    """An adaptation field of ``size`` bytes (8 at least) with a clock reference."""
    base = pcr & 0x1FFFFFFFF
    own = bytes([size - 1, 0x10 | 0x40 * random_access])
    own += bytes([base >> 25, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
    return own.ljust(size, b"\xff")


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload`` unchanged."""
    pat, pmt = _tables()
    out: list[bytes] = []
    counter = tables = 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        if unit % TABLES_EVERY == 0:
            out += [_table_packet(PAT_PID, pat, tables), _table_packet(PMT_PID, pmt, tables)]
            tables += 1
        data = payload[at : at + UNIT]
        pts = at * CLOCK // RATE
        pes = _pes_head(pts, len(data)) + data
        first = min(len(pes), PACKET - 4 - 8)
        head = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter & 15])
        out.append(head + _adaptation(PACKET - 4 - first, pts, unit % RAP_EVERY == 0) + pes[:first])
        counter += 1
        rest = len(pes) - first
        whole, last = divmod(rest, PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), dtype=np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), first).reshape(whole, PACKET - 4)
            out.append(packets.tobytes())
            counter += whole
        if last:
            spare = PACKET - 4 - last
            head = bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter & 15, spare - 1])
            out.append(head + (b"\x00".ljust(spare - 1, b"\xff") if spare > 1 else b"") + pes[len(pes) - last :])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What ``demux`` found."""

    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    #: Byte offsets of the packets that begin random-access points.
    random_access: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    programs: int = 0
    stream_type: int = -1


def _table_section(packet: bytes) -> bytes:
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    size = 3 + ((packet[at + 1] & 15) << 8 | packet[at + 2])
    section = packet[at : at + size]
    if len(section) < size or _crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a table's checksum is wrong")
    return section


def demux(media: bytes) -> Stream:
    """Read back the first elementary stream of the first program."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not len(packets) or (packets[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't begin with the sync byte")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    found = Stream()

    pats = np.flatnonzero(pids == PAT_PID)
    if not len(pats):
        raise ValueError("no program association table")
    pat = _table_section(packets[pats[0]].tobytes())
    entries = [pat[k : k + 4] for k in range(8, len(pat) - 4, 4)]
    programs = [(e[2] & 0x1F) << 8 | e[3] for e in entries if e[:2] != b"\0\0"]
    found.programs = len(programs)
    maps = np.flatnonzero(pids == programs[0])
    pmt = _table_section(packets[maps[0]].tobytes())
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    found.stream_type, stream_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]

    again = np.zeros(len(packets), bool)
    for pid in {PAT_PID, programs[0], stream_pid}:
        at = np.flatnonzero((pids == pid) & (control & 1 == 1))
        steps = np.diff((packets[at, 3] & 15).astype(np.int32)) & 15
        # a packet may be sent twice; what differs is its clock reference at most
        twice = np.flatnonzero(steps == 0)
        twice = twice[(packets[at[twice], 12:] == packets[at[twice + 1], 12:]).all(axis=1)]
        again[at[twice + 1]] = True
        found.continuity_errors += int((steps != 1).sum()) - len(twice)

    at_stream = np.flatnonzero((pids == stream_pid) & ~again)
    own = packets[at_stream]
    field_bytes = np.where(own[:, 3] & 0x20, own[:, 4].astype(np.int32) + 1, 0)
    begins = 4 + field_bytes
    starts_unit = (own[:, 1] & 0x40) != 0
    marked = starts_unit & (field_bytes > 1) & ((own[:, 5] & 0x40) != 0)
    found.random_access = (at_stream[marked] * PACKET).tolist()
    carried = own[np.arange(PACKET)[None, :] >= begins[:, None]].tobytes()
    ends = np.cumsum(PACKET - begins)
    units = (ends - (PACKET - begins))[starts_unit].tolist() + [len(carried)]
    payload: list[bytes] = []
    for a, b in zip(units[:-1], units[1:], strict=True):
        pes = carried[a:b]
        if pes[:3] != b"\0\0\1":
            raise ValueError("an elementary packet doesn't begin with its start code")
        if pes[7] & 0x80:
            p = pes[9:14]
            found.pts.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        size = pes[4] << 8 | pes[5]
        payload.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
    found.payload = b"".join(payload)
    return found


def to_payload(text: str) -> tuple[bytes, int]:
    """A text as 8-bit samples, and how many of them are its own."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(ALIGN, -(-len(raw) // ALIGN) * ALIGN)
    return raw.ljust(size, b"\0"), len(raw)


_STORED = "doc_id long, n_bytes long, media binary, pts array<long>, random_access array<long>"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            sizes, media, pts, raps = [], [], [], []
            for text in batch.column("text").to_pylist():
                payload, n = to_payload(text)
                stream = mux(payload)
                units = range(0, len(payload), UNIT)
                sizes.append(n)
                media.append(stream)
                pts.append([k * CLOCK // RATE for k in units])
                raps.append(demux_offsets(len(payload)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array(pts, pa.list_(pa.int64())),
                    pa.array(raps, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_bytes", "media", "pts", "random_access"],
            )


def demux_offsets(payload_bytes: int) -> list[int]:
    """Byte offsets of the random-access points of ``mux``'s stream."""
    out, packets = [], 0
    for unit, at in enumerate(range(0, payload_bytes, UNIT)):
        packets += 2 * (unit % TABLES_EVERY == 0)
        if unit % RAP_EVERY == 0:
            out.append(packets * PACKET)
        pes = 14 + min(UNIT, payload_bytes - at)
        packets += 1 + max(0, -(-(pes - (PACKET - 12)) // (PACKET - 4)))
    return out


def store_media(docs: DataFrame) -> DataFrame:
    """Store every whole ``text`` of ``docs`` as a transport stream and return what is stored.

    A null text counts as empty and has one unit of zeros.  Rows that repeat, also a
    ``doc_id``, are stored each for itself; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return stored(rows.mapInArrow(_store, _STORED), "media", parquet__block_size=32 << 20)


_DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def features(stream: Stream) -> str:
    """Counts from the stream's tables and a few statistics of its samples."""
    samples = np.frombuffer(stream.payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum())
    zero_crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    return (
        f"programs={stream.programs};units={len(stream.pts)};random_access={len(stream.random_access)};"
        f"last_pts={stream.pts[-1]};continuity_errors={stream.continuity_errors};"
        f"mean={samples.mean():.4f};entropy={entropy:.4f};crossings={zero_crossings}"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            stream = demux(media)
            payload = stream.payload
            out.append(
                (
                    doc,
                    n,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-ALIGN:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    features(stream),
                )
            )
        names = [f.split()[0] for f in _DIGESTS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def media_digests(media: DataFrame) -> DataFrame:
    """Checksums and a feature string per stored stream, from its bytes read back.

    Equal texts have equal values; rows that repeat, and a null ``doc_id``, each have
    their row; no streams, no result.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, _DIGESTS)


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, samples = [], []
        for part, begin, end in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "end")), strict=True):
            stream = demux(part) if part else Stream()
            units = [k for k, pts in enumerate(stream.pts) if pts < end and pts + UNIT * CLOCK // RATE > begin]
            first.append(stream.pts[units[0]] if units else None)
            samples.append(stream.payload[units[0] * UNIT : (units[-1] + 1) * UNIT] if units else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(first, pa.int64()), pa.array(samples, pa.binary())], ["doc_id", "first_pts", "samples"])


def seek(media: DataFrame, begin_seconds: float, end_seconds: float) -> DataFrame:
    """The access units that are presented between two times: doc_id, first_pts, samples.

    ``media`` is what ``store_media`` returns.  The stored time stamps tell the units, and the
    stored offsets the random-access points before the first and after the last of them; only
    the tables and the packets between these points leave the column.  A time beyond a
    stream's end gives null and no samples.  Rows that repeat, and a null ``doc_id``, each have
    their row.
    """
    begin, end = round(begin_seconds * CLOCK), round(end_seconds * CLOCK)
    length = UNIT * CLOCK // RATE
    before = F.size(F.filter("pts", lambda t: t + length <= begin))
    upto = F.size(F.filter("pts", lambda t: t < end))
    start = F.element_at("random_access", F.least(F.floor(before / RAP_EVERY) + 1, F.size("random_access")).cast("int"))
    after = F.ceil(upto / RAP_EVERY) + 1
    stop = F.when(after <= F.size("random_access"), F.element_at("random_access", F.least(after, F.size("random_access")).cast("int"))).otherwise(F.length("media"))
    # the tables come first; those of a random-access point stand before it
    tables = F.substring("media", F.lit(1), F.lit(2 * PACKET))
    between = F.substring("media", (start + 1).cast("int"), (stop - start).cast("int"))
    part = F.when(before < upto, F.concat(tables, between))
    asked = media.select("doc_id", part.alias("part"), F.lit(begin).alias("begin"), F.lit(end).alias("end"))
    return asked.mapInArrow(_sought, "doc_id long, first_pts long, samples binary")
