"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token sequences of a text spell the same bytes, so each is a row of end
offsets. Offsets where a token of both ends are shared cuts; they are found by
divide and conquer: in a window of A's tokens the first common end from the
middle on is located by bisecting the two rows of ends in turn, then both
halves go on alone (what lies between the middle and the cut has none). A
window without a cut is done; what lies between neighbouring cuts is a leaf
group. All windows of a few hundred texts take their steps together, so the
recursion is a loop over levels.

Links are the pairs of an A and a B token of one group. How many documents
hold an id pair linked is counted over the corpus; the counts come back to the
documents in two ways: the most frequent pairs (HEAD of them, 16 bytes each)
by broadcast, all others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import chunked, drop_written, slices, texts_of, written
from lapsewise.llm.vocab import read_vocabulary, vocabulary

#: Bytes of text whose tokens are aligned together.
CHUNK = 1 << 18
#: Pairs of one group that are written out one by one; a larger group is counted by its distinct ids.
WIDE = 1 << 16
#: Id pairs whose counts are broadcast.
HEAD = 1 << 19
#: Bits of a B id in a packed pair.
SHIFT = 32


class Pieces:
    """A sentencepiece model's ids and the bytes each stands for; a text's ids begin with a space of its own."""

    def __init__(self, blob: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.bytes_of = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i)
                                 else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Indices into ``ends_a`` (ascending) of the common ends inside the windows [low, high).

    ends_a, ends_b: strictly ascending; each window lies before a common end.
    """
    found = []
    while len(low):
        middle = (low + high) // 2
        at, stop = middle.copy(), high
        cut = np.full(len(low), -1)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            own = ends_a[at[open_]]
            other = ends_b[np.searchsorted(ends_b, own)]        # the first end of B from there on
            same = other == own
            cut[open_[same]] = at[open_[same]]
            open_, other = open_[~same], other[~same]
            at[open_] = np.searchsorted(ends_a, other)          # and the first of A from that on
            open_ = open_[at[open_] < stop[open_]]
        hit = cut >= 0
        found.append(cut[hit])
        low, high = np.concatenate([low, cut[hit] + 1]), np.concatenate([middle, stop[hit]])
        some = low < high
        low, high = low[some], high[some]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 … size - 1, with room for a separator, and their number."""
    width = len(str(size - 1))
    text = [str(i).encode() for i in range(size)]
    table = np.frombuffer(b"".join(t.ljust(width + 1) for t in text), np.uint8).reshape(size, width + 1)
    return table, np.fromiter(map(len, text), np.int64, size)


class Aligner:
    def __init__(self, vocabulary_a: bytes, model_b: bytes):
        self.a, self.b = vocabulary(vocabulary_a), Pieces(model_b)
        self._bytes_a = [self.a.bytes_of.get(i, b"") for i in range(self.a.size)]
        self._length_a = np.fromiter(map(len, self._bytes_a), np.int64, self.a.size)
        self._length_b = np.fromiter(map(len, self.b.bytes_of), np.int64, len(self.b.bytes_of))
        self._table, self._width = _digits(max(self.a.size, len(self.b.bytes_of)))

    def tokens(self, texts: list[bytes]) -> tuple[list, list]:
        """Ids of both tokenizers; none where one of them does not spell the space and the text."""
        a, b = [], []
        for t, ids_b in zip(texts, self.b.encode([t.decode() for t in texts]), strict=True):
            ids_a = self.a.encode_plain(b" " + t) if t else []
            spelled = b" " + t
            if not t or b"".join([self._bytes_a[i] for i in ids_a]) != spelled \
                    or b"".join([self.b.bytes_of[i] for i in ids_b]) != spelled:
                ids_a, ids_b = [], []
            a.append(ids_a)
            b.append(ids_b)
        return a, b

    def align(self, texts: list[bytes]) -> list[list]:
        """One list for each text: n_a, n_b, n_groups, n_links, groups_sha256, pairs, links.

        pairs: the distinct linked id pairs, packed as a << SHIFT | b, ascending; links: how often each.
        """
        a, b = self.tokens(texts)
        size_a = np.fromiter(map(len, a), np.int64, len(a))
        size_b = np.fromiter(map(len, b), np.int64, len(b))
        none = [0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if not size_a.sum():
            return [none for _ in texts]
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in xs]) for xs in (a, b))
        ends_a, ends_b = np.cumsum(self._length_a[ids_a]), np.cumsum(self._length_b[ids_b])
        last_a = np.cumsum(size_a)
        real = np.flatnonzero(size_a)
        cuts = shared_cuts(ends_a, ends_b, (last_a - size_a)[real], (last_a - 1)[real])
        cuts = np.sort(np.concatenate([cuts, (last_a - 1)[real]]))      # a text's end is common
        stop_a, stop_b = cuts + 1, np.searchsorted(ends_b, ends_a[cuts]) + 1
        in_a, in_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        doc = np.searchsorted(last_a, cuts, "right")                   # of each group
        n_groups = np.bincount(doc, minlength=len(texts))
        n_links = np.bincount(doc, in_a * in_b, len(texts)).astype(np.int64)
        keys, times = self._pairs(ids_a, ids_b, in_a, in_b, stop_a, stop_b, doc)
        bounds = np.searchsorted(keys[0], np.arange(len(texts) + 1))
        lines = self._lines(ids_a, ids_b, in_a, in_b, stop_a, stop_b, np.flatnonzero(np.diff(doc, append=-1)))
        line = iter(lines)
        out = []
        for i in range(len(texts)):
            if not size_a[i]:
                out.append(none)
                continue
            part = slice(bounds[i], bounds[i + 1])
            out.append([int(size_a[i]), int(size_b[i]), int(n_groups[i]), int(n_links[i]),
                        hashlib.sha256(next(line)).hexdigest(), keys[1][part], times[part]])
        return out

    @staticmethod
    def _pairs(ids_a, ids_b, in_a, in_b, stop_a, stop_b, doc):
        """((doc, pair) of the distinct linked pairs, ascending), and their numbers of links."""
        links = in_a * in_b
        narrow = np.flatnonzero(links <= WIDE)
        n = links[narrow]
        group = np.repeat(narrow, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        per = in_b[group]
        i = (stop_a - in_a)[group] + k // per
        j = (stop_b - in_b)[group] + k % per
        docs, pairs, times = [doc[group]], [ids_a[i] << SHIFT | ids_b[j]], [np.ones(len(i), np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            some_a, times_a = np.unique(ids_a[stop_a[g] - in_a[g]:stop_a[g]], return_counts=True)
            some_b, times_b = np.unique(ids_b[stop_b[g] - in_b[g]:stop_b[g]], return_counts=True)
            pairs.append((some_a[:, None] << SHIFT | some_b[None, :]).ravel())
            times.append((times_a[:, None] * times_b[None, :]).ravel())
            docs.append(np.full(len(pairs[-1]), doc[g]))
        docs, pairs, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((pairs, docs))
        docs, pairs, times = docs[order], pairs[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])]))
        return (docs[new], pairs[new]), np.add.reduceat(times, new)

    def _lines(self, ids_a, ids_b, in_a, in_b, stop_a, stop_b, last: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` for each text; ``last``: its last group."""
        n_a, n_b = len(ids_a), len(ids_b)
        # A's tokens come after B's of all groups before, B's after A's of their own group too
        place_a = np.arange(n_a) + np.repeat(stop_b - in_b, in_a)
        place_b = np.arange(n_b) + np.repeat(stop_a, in_b)
        ids = np.empty(n_a + n_b, np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        sign = np.full(n_a + n_b, ord(","), np.uint8)
        sign[place_a[stop_a - 1]] = ord("|")
        sign[place_b[stop_b - 1]] = ord(";")
        width = self._width[ids]
        cells = self._table[ids]
        cells[np.arange(len(ids)), width] = sign
        flat = cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes()
        end = np.cumsum(width + 1)[place_b[stop_b - 1][last]].tolist()
        return [flat[x:y - 1] for x, y in zip([0, *end[:-1]], end, strict=True)]


FIELDS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
          ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())),
          ("links", pa.list_(pa.int64()))]
SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, links array<long>")
_KEPT: dict[bytes, Aligner] = {}


def _aligner(vocabulary_a: bytes, model_b: bytes) -> Aligner:
    key = hashlib.sha256(vocabulary_a + model_b).digest()
    if key not in _KEPT:
        _KEPT[key] = Aligner(vocabulary_a, model_b)
    return _KEPT[key]


def groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Each document's alignment: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links
    (its distinct linked id pairs, packed, and how often each is linked). One scan, no shuffle."""
    files = docs.sparkSession.sparkContext.broadcast((read_vocabulary(path_a), read_vocabulary(path_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in slices(batches):
            texts, keys = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for x, y in chunked(texts, CHUNK):
                made = aligner.align(texts[x:y])
                columns = [keys[x:y], *map(list, zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)],
                                                 names=[n for n, _ in FIELDS])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether it is the highest of its A id, ties included)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("pair").alias("count"))
    of_a = Window.partitionBy("a")      # at most as many rows as B has ids
    return (counts.withColumn("a", F.shiftright("pair", SHIFT))
            .withColumn("best", F.col("count") == F.max("count").over(of_a)).drop("a"))


def _weighed(aligned: DataFrame, head) -> DataFrame:
    """key, n_best and count_sum of the links whose pair is in ``head``; rest and rest_links: all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = head.value
        for batch in slices(batches):
            pairs, links = batch.column(1), batch.column(2)
            flat = pairs.flatten().to_numpy()
            times = links.flatten().to_numpy()
            n = pairs.value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            edge = np.concatenate([[0], np.cumsum(n)])

            def of_doc(value: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(value)])[edge])

            own = np.where(hit, times, 0)
            total = of_doc(own * count[at] if len(known) else own)
            top = of_doc(own * best[at] if len(known) else own)
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(top), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(flat[~hit])),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(times[~hit]))],
                names=["key", "n_best", "count_sum", "rest", "rest_links"])

    return aligned.select("key", "pairs", "links").mapInArrow(
        run, "key long, n_best long, count_sum long, rest array<long>, rest_links array<long>")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level BPE file, applied to a space and the text; path_b: a
    sentencepiece model, which adds that space itself. Null and empty texts,
    and those that one of the two does not spell byte by byte, have no tokens:
    zeros and an empty groups_sha256. Repeated rows each count as a document;
    a null doc_id is kept; an empty table gives an empty result; no other
    column is read.

    The alignments are written once (a text's distinct pairs, not its links).
    The ``head`` most frequent pairs are collected (16 bytes each) and shared
    with the tasks; pairs beyond them are joined with their counts. Those are
    spread over fewer documents than any pair of the head, so no key is hot.
    """
    spark = docs.sparkSession
    aligned = written(groups(docs, path_a, path_b, text).withColumn("key", F.monotonically_increasing_id()),
                      "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    most = counts.orderBy(F.col("count").desc(), "pair").limit(head).toArrow()
    order = np.argsort(most.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(
        most.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
    weighed = written(_weighed(aligned, shared), "weighed")
    rest = (weighed.where(F.size("rest") > 0)
            .select("key", F.explode(F.arrays_zip("rest", "rest_links")).alias("r"))
            .select("key", F.col("r.rest").alias("pair"), F.col("r.rest_links").alias("links"))
            .join(counts, "pair")
            .groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("links") * F.col("count")).alias("more_sum")))
    sums = weighed.select("key", "n_best", "count_sum").unionByName(
        rest.select("key", F.col("more_best").alias("n_best"), F.col("more_sum").alias("count_sum")))
    out = written(aligned.drop("pairs", "links").join(
        sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "key")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
    for done in (aligned, counts, weighed):
        drop_written(done)
    return out
