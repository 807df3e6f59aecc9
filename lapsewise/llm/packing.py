"""Packing: order-preserving dynamic programming over cut positions.

The documents of a partition stand one after the other; the program chooses
where sequences end. Cuts may fall behind a document (free), behind a sentence
(a small penalty), or, where neither is near, anywhere (a larger one). It
minimises padding plus penalties. With f(i) the least cost of everything up to
cut i, a sequence from j to i costs LENGTH - (i - j), so the best j in reach is
the minimum of f(j) + j over a sliding window, which a monotone queue keeps; a
second queue covers two sequences with one cut anywhere between them.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lapsewise.llm.common import slices, texts_of
from lapsewise.llm.vocab import read_vocabulary, vocabulary

#: Ids of a sequence, and the id behind each document.
LENGTH, END_ID = 1024, 0
#: Penalties in padding ids: a cut behind a sentence, a cut anywhere, and each sequence.
SENTENCE, ANYWHERE, EACH = 2, 6, 1
#: Documents are packed in runs of about so many ids (a run ends where its plan does).
RUN = 1 << 18


def sentence_ends(bytes_of: dict[int, bytes], size: int) -> np.ndarray:
    """Which ids end a sentence: those that end with . ! ? or hold a line break."""
    out = np.zeros(size, bool)
    for i, w in bytes_of.items():
        out[i] = w[-1:] in (b".", b"!", b"?") or b"\n" in w
    return out


def padding(n: int, length: int) -> int:
    """Padding of a sequence of n ids: up to ``length``, none at a power of two."""
    return 0 if n & (n - 1) == 0 else length - n


def cuts(position: np.ndarray, penalty: np.ndarray, length: int = LENGTH, anywhere: int = ANYWHERE,
         each: int = EACH) -> list[int]:
    """Ends of the sequences of least cost.

    position: ascending cut positions, the last one the end of all (0 is the
    start); penalty: of a cut there. Gaps over ``length`` get cuts anywhere.
    """
    gap = np.diff(position, prepend=0)
    if (gap > length).any():
        more = [np.arange(p - g + length, p, length) for p, g in zip(position[gap > length], gap[gap > length])]
        more = np.concatenate(more)
        order = np.argsort(np.concatenate([position, more]), kind="stable")
        position = np.concatenate([position, more])[order]
        penalty = np.concatenate([penalty, np.full(len(more), anywhere)])[order]
    pos = [0, *position.tolist()]
    fee = [0, *penalty.tolist()]
    fee[-1] = 0
    # powers of two need no padding: where such a step back is a cut, it is a candidate
    whole = np.array(pos)
    back = {}
    power = length // 4
    while power < length:
        at = np.searchsorted(whole, whole - power)
        for i in np.flatnonzero(whole[at] == whole - power).tolist():
            back.setdefault(i, []).append(int(at[i]))
        power *= 2
    best, came = [0], [(0, False)]
    near: deque[tuple[int, int]] = deque()      # (f(j) + j, j): one sequence from j
    far: deque[tuple[int, int]] = deque()       # two sequences from j, the first one full
    behind = 0                                  # first j that is not in ``far`` yet
    for i in range(1, len(pos)):
        p = pos[i]
        value = best[i - 1] + pos[i - 1]
        while near and near[-1][0] >= value:
            near.pop()
        near.append((value, i - 1))
        while pos[near[0][1]] < p - length:
            near.popleft()
        while pos[behind] < p - length:
            value = best[behind] + pos[behind]
            while far and far[-1][0] >= value:
                far.pop()
            far.append((value, behind))
            behind += 1
        while far and pos[far[0][1]] < p - 2 * length:
            far.popleft()
        cost, from_j, two = near[0][0] + length - p + each, near[0][1], False
        if far:
            other = far[0][0] + 2 * length - p + anywhere + 2 * each
            if other < cost:
                cost, from_j, two = other, far[0][1], True
        for j in back.get(i, ()):
            if best[j] + each < cost:
                cost, from_j, two = best[j] + each, j, False
        best.append(cost + fee[i])
        came.append((from_j, two))
    out, i = [], len(pos) - 1
    while i:
        out.append(pos[i])
        j, two = came[i]
        if two:
            out.append(pos[j] + length)
        i = j
    return out[::-1]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


def pieces(doc_ids: list, ids: list[np.ndarray], ends: np.ndarray, first: int, length: int,
           with_ids: bool) -> tuple[list[list], int]:
    """Columns of the pieces of some documents (ids with the end id), and the next sequence id."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    base = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(ids)
    is_end = np.flatnonzero(ends[flat]) + 1
    position = np.unique(np.concatenate([is_end, base[1:]]))
    penalty = np.where(np.isin(position, base[1:], assume_unique=False), 0, SENTENCE)
    stop = np.array(cuts(position, penalty, length), np.int64)
    edge = np.unique(np.concatenate([stop, base[1:]]))
    start = np.concatenate([[0], edge[:-1]])
    doc = np.searchsorted(base, start, "right") - 1
    seq = np.searchsorted(stop, start, "right")
    seq_start = np.concatenate([[0], stop])[seq]
    raw = flat.tobytes()
    out = [[doc_ids[d] for d in doc.tolist()], start - base[doc], edge - start,
           [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), edge.tolist())],
           size[doc], first + seq, start - seq_start]
    if with_ids:
        out.append([flat[a:b].astype(np.int32) for a, b in zip(start.tolist(), edge.tolist())])
    return out, first + len(stop)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pieces of the documents (``doc_id``, text) in sequences of at most ``length`` ids.

    A document is its ids and then ``end_id`` (a null or empty text: that id
    alone). Documents keep the order in which their partition holds them; a
    partition is packed in runs of about RUN ids, so a task's memory is bounded
    and at most one sequence a run is cut short for that. sequence_id is the
    partition's number times 2^33 plus a count, so it is unique, and equal
    again when a lost task runs again. Every row gives at least one piece;
    repeated rows and null ids are packed like others. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        ends = sentence_ends(words.bytes_of, max(words.size, end_id + 1))
        close = np.array([end_id], np.uint32)
        fields = FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
        sequence = TaskContext.get().partitionId() << 33
        doc_ids, ids, held = [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal sequence, doc_ids, ids, held
            columns, sequence = pieces(doc_ids, ids, ends, sequence, length, with_ids)
            doc_ids, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                              names=[n for n, _ in fields])

        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            for key, t in zip(keys, texts_of(batch.column(1)), strict=True):
                own = np.concatenate([words.encode(t), close])
                doc_ids.append(key)
                ids.append(own)
                held += len(own)
                if held >= RUN:
                    yield made()
        if ids:
            yield made()

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
