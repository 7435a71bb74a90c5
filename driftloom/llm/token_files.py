"""Token-ID output: Parquet files of id lists that can be read in part.

Layout of a token file set: one row per document in ascending ``doc_id`` order,
file ``file_no`` holding what follows file ``file_no - 1``.  Columns: ``doc_id``,
``file_no``, ``start_in_file`` (ids of the documents before it in its file),
``n_tokens``, ``tokens`` (list of ids).  Ids are dictionary-encoded, integers
beside them delta-encoded; row groups are small and every page has its minimum
and maximum in the page index, so a range of ``doc_id`` or a metadata column is
read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.bpe import DEFAULT_TOKENIZER, encoder
from driftloom.llm.common import bound_batches, whole_text

FILE_SCHEMA = "doc_id long, file_no int, start_in_file long, n_tokens long, tokens array<int>"
#: Bytes of a row group, rows of a page: what a selective read must decode at least.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
WRITER = {
    "compression": "snappy",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.page.write-checksum.enabled": "true",
}


def _encode_part(end_id: int, tokenizer: str, specials_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        codec, end = encoder(tokenizer, specials_as_text), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [x + end for x in codec.encode(batch.column("text").to_pylist())]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.full(len(ids), part, dtype=np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                    ],
                    ["doc_id", "file_no", "start_in_file", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])

    return run


def write_token_files(
    docs: DataFrame, path: str, end_id: int = 2, tokenizer: str = DEFAULT_TOKENIZER, specials_as_text: bool = False
) -> None:
    """Encode every whole ``text`` of ``docs`` and write a token file set to ``path``.

    The texts are dealt by ranges of ``doc_id`` before they are encoded: a text is
    smaller than its ids.  Empty and null texts have the end id alone.  Rows that
    repeat a ``doc_id`` all stay, in an order that their texts give; a frequent or null
    one is dealt to several files by them.  A null ``doc_id`` comes first.  Other columns
    of ``docs`` are left out, whatever their names; no rows, no result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ids = dealt.mapInArrow(_encode_part(end_id, tokenizer, specials_as_text), FILE_SCHEMA)
    writer = ids.write
    for key, value in WRITER.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file set, with ``start``: all ids before each one.

    ``start`` needs the metadata columns only; a filter on ``doc_id`` reaches the page index.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "file_no").withColumn("start", F.col("base") + F.col("start_in_file"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)
        offsets = lists.offsets.to_numpy()
        raw = memoryview(values).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("file_no"),
                batch.column("start_in_file"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(np.array(crcs, dtype=np.int64)),
            ],
            ["doc_id", "file_no", "start_in_file", "n_tokens", "ids_crc32"],
        )


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file set: doc_id, start, n_tokens, ids_crc32, as read back.

    Rows that repeat, and a null ``doc_id``, each have their row; a set of no documents has none.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, file_no int, start_in_file long, n_tokens long, ids_crc32 long"
    read = rows.select("doc_id", "file_no", "start_in_file", "tokens").mapInArrow(_checksums, schema)
    return read.join(bases, "file_no").select(
        "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
