"""Small helpers shared by the operators: narrow inputs, folds, Arrow batches, word arrays.

Conventions of every operator here: only the named columns are read, so extra
or clashing columns do no harm; a null text counts as the empty text unless
the operator says otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lapsewise.session import scratch_path

#: Bytes of text that the vectorised helpers treat at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus`` (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for null."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that working memory stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes (a longer text stands alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def map_texts(docs: DataFrame, keep: list[str], fields: str,
              make: Callable[[], Callable[[list[bytes]], list]], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` plus ``fields`` (DDL), computed from the whole texts.

    ``make()`` runs once a task and returns the function from texts to one
    array for each field. One scan, no shuffle; a task holds a few hundred
    rows of text at a time.
    """
    kept = [docs.schema[c] for c in keep]
    added = list(StructType.fromDDL(fields))
    schema = StructType(kept + added)
    arrow = to_arrow_schema(schema)
    carried = [F.col(c) for c in keep] + [F.col(text).alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in slices(batches):
            texts = texts_of(batch.column(len(keep)))
            for a, b in chunked(texts):
                made = of(texts[a:b])
                own = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(len(keep))]
                own += [pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(own, schema=arrow)

    return docs.select(*carried).mapInArrow(run, schema)


# -- words as arrays -----------------------------------------------------------------------------

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_U = np.uint64
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = max(n, CHUNK_BYTES * 2) if n <= CHUNK_BYTES * 2 else n
        up, down = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)
        if size > CHUNK_BYTES * 2:          # one very long text: do not keep such tables
            return up, down
        _POW.update(up=up, down=down)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts.

    buf: the texts joined by newlines; start, end: byte range of each word;
    doc: index of its text; first: index of each text's first word (one more
    entry than texts); hash: 64-bit hash of the word's bytes.
    """

    def __init__(self, texts: list[bytes], lower: bool, hashes: bool = True):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        space = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.space = space
        self.first = np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hashes:
            up, self._down = _power_table(len(self.buf) + 1)
            self._total = np.concatenate([np.zeros(1, np.uint64),
                                          np.cumsum(_BYTE_CODE[self.buf] * up[: len(self.buf)])])
            self.hash = self.part_hash(self.start, self.end)

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes."""
        return mix((self._total[end] - self._total[start]) * self._down[start]
                   + (end - start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text index) of every run of ``n`` words inside one text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(k, np.uint64)
        for i in range(n):
            acc = acc * _U(_MULTIPLIER) + self.hash[i:i + k]
        keep = self.doc[:k] == self.doc[n - 1:]
        return mix(acc[keep]), self.doc[:k][keep]


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    """Whether a text has a letter; numerals (Roman, fractions, in circles) are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))
