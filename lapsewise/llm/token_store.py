"""Token-id files: Parquet with one list column of ids and narrow metadata columns.

Rows stand in ascending doc_id order, over all files and in each. The ids are
dictionary-encoded (a vocabulary fits one dictionary page), the metadata
columns delta-encoded; row groups, pages and rows of a page are bounded, and
the page indexes let a reader fetch the metadata, or a few documents' ids, alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import slices, texts_of
from lapsewise.llm.vocab import read_vocabulary, vocabulary

END_ID = 2
SCHEMA = "doc_id long, part long, start_in_part long, n_tokens long, ids array<int>"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",             # delta encodings where there is no dictionary
    "parquet.block.size": str(32 << 20),        # bytes of a row group
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "4096",
    "parquet.dictionary.page.size": str(1 << 20),
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "start_in_part", "n_tokens")},
}


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = END_ID, text: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the files to ``out``.

    One shuffle of the texts, by ranges of doc_id (null first; equal ids in
    text order). part is the file's place in that order, start_in_part the
    ids of the part's documents before a document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = vocabulary(shared.value), TaskContext.get().partitionId(), 0
        close = np.array([end_id], np.uint32)
        for batch in slices(batches, 256):
            ids = [np.concatenate([words.encode(t), close]) for t in texts_of(batch.column(1))]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(start + offsets[:-1]),
                 pa.array(size), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(offsets[-1])

    ordered = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(run, SCHEMA).write.options(**WRITER).parquet(out)


def _bases(files: DataFrame) -> DataFrame:
    """part, base (ids in the parts before it): one row a file, so it may be broadcast."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
                       .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start (ids of all documents before it), n_tokens; reads no ids.

    The only collected or broadcast rows are one for each file.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    return (files.select("doc_id", "part", "start_in_part", "n_tokens").join(_bases(files), "part")
            .select("doc_id", "part", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            stops = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                 pa.array(np.diff(stops).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SCHEMA).parquet(path)
    return (files.select("doc_id", "part", "start_in_part", "ids")
            .mapInArrow(run, "doc_id long, part long, start_in_part long, n_tokens long, ids_crc32 long")
            .join(_bases(files), "part")
            .select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens",
                    "ids_crc32"))
