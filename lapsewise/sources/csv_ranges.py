"""Quoted CSV read in byte ranges (S-1, S-3): values may hold quotes and line breaks.

A line break inside quotes does not end a record, so whether a range begins
inside a value hangs on all quotes before it. Instead of reading the file in
one task, every range is read twice, in parallel:

1. its quotes are counted; the parities' running sum over the ranges of a file
   (a row a range) says which of them begin inside a value;
2. with that state its lines are joined into records. A record belongs to the
   range of its first byte: what a range has of a record begun before it, and
   the open record at its end, at most two rows a range, are put together in a
   small step of their own.

The records are then parsed by Spark's CSV expression. Quotes stand around whole
values and are doubled inside; a bare quote in an unquoted value is not CSV.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Kinds of rows that a range gives.
WHOLE, OPEN, REST, CLOSING = "whole", "open", "rest", "closing"
PARTS = "file string, block long, kind string, n long, text string"


def assemble(lines: Iterable[tuple[str, int, bool, str]]) -> Iterator[tuple[str, int, str, int, str]]:
    """(file, block, kind, n, text) from the lines of ranges in order: (file, block, whether it begins
    inside a value, line). n counts a range's records that begin in it, empty lines aside.

    whole: a record; open: the beginning of one that goes on in the next range; rest / closing:
    lines of a record begun before, without and with its end.
    """
    here, held, inside, begun, n = None, [], False, False, 0

    def left() -> Iterator[tuple]:
        if held:
            yield (*here, OPEN if begun else REST, n, "\n".join(held))

    for file, block, starts_inside, line in lines:
        if (file, block) != here:
            yield from left()
            here, held, inside, begun, n = (file, block), [], starts_inside, not starts_inside, 0
        held.append(line)
        if line.count('"') % 2:
            inside = not inside
        if not inside:
            text = "\n".join(held)
            text = text[:-1] if text.endswith("\r") else text
            if not begun:
                yield (*here, CLOSING, n, text)
            elif text:
                yield (*here, WHOLE, n, text)
                n += 1
            held, begun = [], True
    yield from left()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where the line's range begins), in the order of the file inside a partition."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ranges_of(lines: DataFrame) -> DataFrame:
    """file, block, inside: whether the range begins inside a quoted value. One row a range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
            .withColumn("inside", F.coalesce(F.sum(F.col("quotes") % 2).over(before) % 2 == 1, F.lit(False)))
            .drop("quotes"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, text: the records of a CSV file or folder; n = 0 in block 0 is a file's header."""
    lines = lines_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        made = []
        for row in assemble(rows()):
            made.append(row)
            if len(made) == 4096:
                yield batch_of(made)
                made = []
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        file, block, kind, n, text = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(block, pa.int64()), pa.array(kind),
                                           pa.array(n, pa.int64()), pa.array(text)],
                                          names=["file", "block", "kind", "n", "text"])

    # a row a range, some hundred bytes; broadcast also because it keeps the lines in their order
    states = F.broadcast(ranges_of(lines).select(F.col("file").alias("f"), F.col("block").alias("b"), "inside"))
    parts = (lines.join(states, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
             .select("file", "block", "inside", "value").mapInArrow(run, PARTS))
    # at most two rows a range: the pieces of records that cross its edges
    crossing = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", (F.col("kind") == OPEN).cast("int"))
    begun = F.when(F.col("kind") == OPEN, F.col("block"))
    put = (crossing.withColumn("owner", F.last(begun, ignorenulls=True).over(order))
           .groupBy("file", "owner").agg(
               F.max(F.when(F.col("kind") == OPEN, F.col("n"))).alias("n"),
               F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))
           .select("file", F.col("owner").alias("block"), "n",
                   F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text")))
    return parts.where(F.col("kind") == WHOLE).select("file", "block", "n", "text").unionByName(put)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV file with a header, as text, read in as many tasks as it has ranges.

    The same rows as Spark's reader with ``multiLine`` and doubled quotes gives
    (in any order): empty lines are skipped, an empty unquoted value is null, and
    where a file's lines end in CR LF a break inside quotes is read as LF.
    """
    # the header alone: Spark reads the first record for it
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    found = records(spark, path).where(~((F.col("block") == 0) & (F.col("n") == 0)))
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    parsed = found.select(F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), {
        "escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
