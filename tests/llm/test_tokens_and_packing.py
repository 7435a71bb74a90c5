import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import packing, token_files
from driftloom.llm.bpe import encoder
from driftloom.llm.common import shared_path
from driftloom.llm.registry import QUERIES


def _library(texts, end, specials_as_text=False):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = specials_as_text
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" \n\tab'sé\u0085\u001c1.　", max_size=25)), max_size=4))
def test_ids_equal_the_librarys(texts):
    own = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder().encode(texts)]
    assert own == [x[:-1] for x in _library(texts, 0)]


@pytest.mark.parametrize("specials_as_text", [False, True])
def test_strings_of_special_tokens(specials_as_text):
    texts = ["<|endoftext|>", "a<|endoftext|> b", "é <|endoftext|><|endoftext|>", "<|endoftext", "你<|endoftext|>"]
    own = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder(specials_as_text=specials_as_text).encode(texts)]
    assert own == [x[:-1] for x in _library(texts, 0, specials_as_text)]


def test_op2_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for r, ids in zip(rows, _library([r.text for r in rows], 2), strict=True):
        want[r.doc_id] = (start, len(ids), _crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_files"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op2_odd(spark, request, which):
    docs = request.getfixturevalue(which)
    path = shared_path(spark, "t")
    token_files.write_token_files(docs, path)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    texts = [r.text for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))]
    assert [r.tokens for r in rows] == _library(texts, 2)
    assert [r.start for r in rows] == [int(x) for x in np.cumsum([0] + [r.n_tokens for r in rows])[:-1]]


def test_files_can_be_read_in_part(spark, monkeypatch):
    """Dictionary and delta encodings, bounded row groups and pages, page indexes; a range of ids reads few rows."""
    import pyarrow.parquet as pq

    monkeypatch.setitem(token_files.WRITER, "parquet.block.size", str(1 << 20))
    monkeypatch.setitem(token_files.WRITER, "parquet.page.row.count.limit", "500")
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary, 60))) for k in range(20_000)], "doc_id long, text string")
    path = shared_path(spark, "t")
    token_files.write_token_files(docs, path)
    files = sorted(f.path for f in _files(spark, path))
    groups = 0
    for name in files:
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            by_name = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert group.total_byte_size < 3 << 20
            assert "RLE_DICTIONARY" in by_name["tokens"].encodings
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(by_name["doc_id"].encodings)
            assert all(c.has_column_index and c.has_offset_index for c in (by_name["doc_id"], by_name["n_tokens"]))
            assert by_name["doc_id"].statistics.has_min_max
        assert any("DELTA_BINARY_PACKED" in meta.row_group(g).column(c).encodings for g in range(meta.num_row_groups) for c in (0, 2, 3))
    assert groups > len(files)
    few = spark.read.schema(token_files.FILE_SCHEMA).parquet(path).filter("doc_id between 9000 and 9009")
    assert few.count() == 10
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,9000), LessThanOrEqual(doc_id,9009)]" in plan
    meta = spark.read.schema(token_files.FILE_SCHEMA).parquet(path).agg({"n_tokens": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in meta


def _files(spark, path):
    import os

    return [e for e in os.scandir(path.removeprefix("file://")) if e.name.endswith(".parquet")]


def test_a_frequent_id_goes_to_several_files(spark):
    rows = [(7, f"text {k} of one id") for k in range(3000)] + [(k, "other") for k in range(20)]
    path = shared_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are
    try:
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = token_files.read_token_files(spark, path)
    assert read.filter("doc_id = 7").select("file_no").distinct().count() > 1
    got = sorted(read.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert [r.start for r in got] == [int(x) for x in np.cumsum([0] + [r.n_tokens for r in got])[:-1]]


def _check_packing(texts, rows, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, ids in zip(texts, _library(texts.values(), 0), strict=True):
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), _crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert all(packing.is_gapless(p) for p in by_sequence.values())
    lengths = [sum(n for _, n in p) for p in by_sequence.values()]
    assert max(lengths, default=0) <= window
    assert packing.padding(lengths, window) < window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_op8_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    _check_packing({r.doc_id: r.text for r in docs}, QUERIES["op8_packing_nnls"](spark, sf_dir).collect())


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing_docs"])
def test_op8_odd(request, which):
    docs = request.getfixturevalue(which)
    _check_packing({r.doc_id: r.text for r in docs.collect()}, packing.pack(docs).collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=64, max_size=64))
def test_plan_places_every_tail_once(hist):
    hist = np.array([0, *hist[1:]])
    segments, stream, windows = packing.plan_windows(hist, 64)
    placed = np.zeros(64, dtype=int)
    for length, lo, hi, *_ in sorted([*segments, *stream]):
        assert placed[length] == lo
        placed[length] = hi
    assert (placed == hist).all()
    filled = defaultdict(int)
    for length, lo, hi, window, copies, _ in segments:
        for w in range(window, window + (hi - lo) // copies):
            filled[w] += copies * length
    assert len(filled) == windows and set(filled.values()) <= {64}


def test_solver_finds_an_exact_mix():
    combos = packing.combinations(64)
    want = np.zeros(64)
    want[20], want[44], want[32] = 300, 300, 100
    x = packing.solve_counts(want, combos, steps=3000)
    got = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=64)
    assert np.abs(got[1:] - want[1:]).max() < 8
