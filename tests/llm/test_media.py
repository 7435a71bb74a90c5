import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import media_ts
from driftloom.llm.registry import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40_000), st.integers(0, 255))
def test_round_trip(size, seed):
    payload = bytes((seed + 7 * k) % 256 for k in range(size))
    media = media_ts.mux(payload)
    stream = media_ts.demux(media)
    assert stream.payload == payload
    assert (stream.continuity_errors, stream.programs, stream.stream_type) == (0, 1, 6)
    units = -(-size // media_ts.UNIT)
    assert stream.pts == [k * media_ts.UNIT * media_ts.CLOCK // media_ts.RATE for k in range(units)]
    assert stream.random_access == media_ts.demux_offsets(size)


def test_a_lost_packet_is_noticed():
    media = media_ts.mux(b"abcd" * 5000)
    lost = media[: 188 * 10] + media[188 * 11 :]
    assert media_ts.demux(lost).continuity_errors == 1


def _packets(media):
    return [media[k : k + 188] for k in range(0, len(media), 188)]


def test_packets_may_be_sent_twice():
    payload = b"abcd" * 5000
    packets = _packets(media_ts.mux(payload))
    twice = b"".join(p * 2 if k in (2, 5, 40) else p for k, p in enumerate(packets))
    stream = media_ts.demux(twice)
    assert (stream.payload, stream.continuity_errors) == (payload, 0)
    assert media_ts.demux(b"".join([*packets[:6], packets[5], packets[5], *packets[6:]])).continuity_errors == 0


def test_a_lost_unit_leaves_the_others():
    payload = bytes(range(256)) * 128
    packets = _packets(media_ts.mux(payload))
    starts = [k for k, p in enumerate(packets) if p[1] & 0x40 and ((p[1] & 0x1F) << 8 | p[2]) == media_ts.STREAM_PID]
    lost = b"".join(packets[: starts[1]] + packets[starts[2] :])
    stream = media_ts.demux(lost)
    unit = media_ts.UNIT
    assert stream.payload == payload[:unit] + payload[2 * unit :] and len(stream.pts) == len(starts) - 1
    assert stream.continuity_errors == ((starts[2] - starts[1]) % 16 != 0)


def test_the_first_of_two_programs():
    packets = _packets(media_ts.mux(b"abcd" * 100))
    both = media_ts._section(0, 1, bytes([0, 1, 0xF0, 0x00, 0, 2, 0xF0, 0x01]))
    other = packets[-1][:1] + bytes([0x01, 0x77]) + packets[-1][3:]
    stream = media_ts.demux(b"".join([media_ts._table_packet(0, both, 0), packets[1], other, *packets[2:], other]))
    assert (stream.programs, stream.payload, stream.continuity_errors) == (2, media_ts.demux(b"".join(packets)).payload, 0)


def test_time_stamps_have_33_bits():
    for pts in (0, 2**32 + 12345, 2**33 - 1, 2**33 + 5):
        head = media_ts._pes_head(pts, 4) + b"data"
        packets = _packets(media_ts.mux(b"abcd"))
        body = media_ts._adaptation(184 - len(head), pts, True) + head
        assert media_ts.demux(b"".join(packets[:2]) + packets[2][:4] + body).pts == [pts % 2**33]


def test_damage_is_an_error():
    media = media_ts.mux(b"abcd" * 50)
    for bad in (media[:-1], b"x" + media[1:], media[:10] + b"\x55" + media[11:], b""):
        with pytest.raises(ValueError):
            media_ts.demux(bad)


def _want(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def _check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == _want(texts[r.doc_id])


def test_op7_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_media_ts"](spark, sf_dir).collect()
    _check(rows, docs)
    of = {}
    for r in rows:
        of.setdefault(docs[r.doc_id], set()).add(tuple(r)[1:])
    assert all(len(x) == 1 for x in of.values())


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op7_odd(request, which):
    docs = request.getfixturevalue(which)
    rows = media_ts.media_digests(media_ts.store_media(docs)).collect()
    _check(rows, {r.doc_id: r.text for r in docs.collect()})


def test_seeking_reads_from_a_random_access_point(spark):
    """Stored stamps and offsets lead to the units of a time, from a part of the stream."""
    import numpy as np
    from driftloom.llm import media_ts

    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (10, 8192, 100_000, 200_001)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = media_ts.store_media(docs)
    unit = media_ts.UNIT
    for begin, end in ((0.0, 0.5), (5.0, 5.1), (4.2, 17.0), (20.0, 1000.0), (3.072, 3.072 + 1e-4)):
        got = {r.doc_id: r for r in media_ts.seek(media, begin, end).collect()}
        for k, text in enumerate(texts):
            payload, _ = media_ts.to_payload(text or "")
            units = [u for u in range(-(-len(payload) // unit)) if u * unit / 8000 < end and (u + 1) * unit / 8000 > begin]
            want = b"".join(payload[u * unit : (u + 1) * unit] for u in units)
            assert bytes(got[k].samples) == want
            assert got[k].first_pts == (units[0] * unit * 90_000 // 8000 if units else None)
