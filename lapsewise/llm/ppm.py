"""Language-model scores: prediction by partial matching over bytes, next to a unigram base.

The model is a trie of byte contexts of up to ORDER bytes with the counts of
the byte that followed, gathered from all training texts. A text's score is
its code length under it: a byte that the longest known context has not seen
costs an escape (method C), and shorter contexts then leave out the bytes
already excluded. The counts are pretrained and fixed while texts are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import _LOWER, chunked, mix, slices, texts_of, written

#: Bytes of the longest context, and of a segment that is scored in step with others.
ORDER, SEGMENT = 5, 96
#: Bounds of what is sent to every task: contexts of the automaton, and frequent words. All others are joined.
MAX_CONTEXTS, MAX_HEAD = 1 << 16, 1 << 19
#: Context bytes by which the trie is dealt into BUCKETS (shorter contexts go to every task).
SHARED, BUCKETS = 3, 256
#: Distinct grams or words that a task gathers before it passes them on.
FLUSH = 1 << 20


# -- gathering ------------------------------------------------------------------------------------

def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, each behind ORDER NULs and before one (its end); where each text's first
    coded byte is, and how many are coded (its bytes and the end)."""
    gap = b"\0" * ORDER
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    base = np.cumsum(size + ORDER) - size
    return _LOWER[np.frombuffer(gap + (b"\0" + gap).join(texts) + b"\0", np.uint8)], base, size


def grams(texts: list[bytes]) -> np.ndarray:
    """Each coded byte behind the ORDER bytes before it, as a 48-bit code."""
    s, base, size = stream(texts)
    at = np.arange(size.sum()) + np.repeat(base - (np.cumsum(size) - size), size)
    code = s[at - ORDER].astype(np.uint64)
    for k in range(ORDER - 1, -1, -1):
        code = code << np.uint64(8) | s[at - k]
    return code


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram (context and byte), n: over all of every text of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, which = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(which, np.concatenate(counts)).astype(np.int64)

        def batch_of(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in slices(batches):
            texts = texts_of(batch.column(0))
            for a, b in chunked(texts):
                code, n = np.unique(grams(texts[a:b]), return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held >= FLUSH:
                    code, n = merged()
                    codes, counts, held = [code], [n], len(code)
                    if held >= FLUSH // 2:
                        yield batch_of(code, n)
                        codes, counts, held = [], [], 0
        if codes:
            yield batch_of(*merged())

    parts = docs.select(F.col(text)).mapInArrow(run, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary, A-Z lower-cased), n: over all of every text of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in slices(batches):
            for t in texts_of(batch.column(0)):
                seen.update(t.lower().split())
            if len(seen) >= FLUSH:
                yield rows(seen)
                seen = Counter()
        if seen:
            yield rows(seen)

    parts = docs.select(F.col(text)).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, bound: int) -> DataFrame:
    """Rows of ``counts`` (n) from the least power of two on that leaves at most ``bound`` rows."""
    classes = (counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("rows"))
               .orderBy(F.desc("k")).collect())
    least, total = math.inf, 0
    for r in classes:
        total += r["rows"]
        if total > bound:
            break
        least = 1 << int(r["k"])
    return counts.where(F.lit(False) if least == math.inf else F.col("n") >= F.lit(int(least)))


# -- model ----------------------------------------------------------------------------------------

def code_lengths(levels: list[np.ndarray], others: int) -> np.ndarray:
    """log10 probabilities (rows, symbols) from counts in the longest context first, then in shorter
    ones. ``others``: bytes that no context has seen; one column, the last, stands for each of them."""
    rows, symbols = levels[0].shape
    out, paid = np.zeros((rows, symbols)), np.zeros((rows, 1))
    excluded = np.zeros((rows, symbols), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for level in levels:
            c = np.where(excluded, 0, level)
            seen = c > 0
            total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            out = np.where(seen, paid + np.log10(c / (total + kinds)), out)
            paid = paid + np.where(kinds > 0, np.log10(kinds / np.maximum(total + kinds, 1)), 0)
            excluded |= seen
        left = symbols - 1 + others - excluded.sum(1, keepdims=True)
        return np.where(excluded, out, paid - np.log10(np.maximum(left, 1)))


class Model:
    """The trie as an automaton: of every kept context, where each byte leads and what it costs.

    A state stands for the longest kept context that the bytes read end with.
    symbol: byte -> column; the last column but one is any unseen byte, the
    last is no byte (it costs nothing). Where contexts are left out, states
    below ``whole`` (those of less than ORDER bytes) cost nothing here: their
    bytes are open, and ``Rest`` has their costs.
    """

    def __init__(self, order: np.ndarray, gram: np.ndarray, n: np.ndarray, left_out: bool = False):
        """Counts n of each byte behind each kept context: gram holds ``order`` bytes and then that byte."""
        seen = np.unique(gram & 255) if len(gram) else np.zeros(0, np.int64)
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        columns = len(seen) + 1
        contexts = [np.unique(gram[order == k] >> 8) for k in range(ORDER + 1)]
        contexts[0] = np.zeros(1, np.int64)
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        self.after = np.zeros((first[-1], columns + 1), np.int32)
        self.cost = np.zeros((first[-1], columns + 1), np.float32)
        counts = []
        for k, own in enumerate(contexts):
            rows = slice(first[k], first[k + 1])
            mine = order == k
            c = np.zeros((len(own), columns), np.float32)
            c[np.searchsorted(own, gram[mine] >> 8), self.symbol[gram[mine] & 255]] = n[mine]
            counts.append(c)
            up = [np.arange(len(own))]          # rows of the shorter contexts, order k first
            for j in range(k - 1, -1, -1):
                up.append(np.searchsorted(contexts[j], own & ((1 << 8 * j) - 1)))
            for a in range(0, len(own), 2048):
                some = [counts[k - i][u[a:a + 2048]] for i, u in enumerate(up)]
                self.cost[rows][a:a + 2048, :columns] = code_lengths(some, 257 - columns)
            if k:
                self.after[rows] = self.after[first[k - 1] + up[1]]
            if k < ORDER and len(contexts[k + 1]):
                child = contexts[k + 1]
                self.after[first[k] + np.searchsorted(own, child >> 8), self.symbol[child & 255]] = (
                    first[k + 1] + np.arange(len(child)))
        self.whole = int(first[ORDER]) if left_out else 0
        self.cost[:self.whole] = 0

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text with its end, but for open bytes; then these: text and gram.

        Texts are cut into segments that run in step; a segment first reads
        the ORDER bytes before it, which is all that a state depends on.
        """
        out = np.zeros(len(texts))
        open_texts, open_grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        none = self.cost.shape[1] - 1
        for a, b in chunked(texts):
            raw, base, size = stream(texts[a:b])
            s = np.concatenate([self.symbol[raw], np.full(SEGMENT, none)])
            number = -(-size // SEGMENT)
            text = np.repeat(np.arange(b - a), number)
            at = base[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
            left = (base + size)[text] - at
            state = np.zeros(len(at), np.int64)
            for k in range(ORDER, 0, -1):
                state = self.after[state, s[at - k]]
            total = np.zeros(len(at))
            for k in range(SEGMENT):
                symbol = np.where(k < left, s[at + k], none)
                total += self.cost[state, symbol]
                if self.whole:
                    here = np.flatnonzero((state < self.whole) & (k < left))
                    open_texts.append(a + text[here])
                    open_grams.append(at[here] + k)
                state = self.after[state, symbol]
            out[a:b] = np.bincount(text, total, minlength=b - a)
            if self.whole:
                place = np.concatenate(open_grams[-SEGMENT:])
                code = raw[place - ORDER].astype(np.int64)
                for k in range(ORDER - 1, -1, -1):
                    code = code << 8 | raw[place - k]
                open_grams[-SEGMENT:] = [code]
        return out, np.concatenate(open_texts), np.concatenate(open_grams)


class Rest:
    """Costs of single grams from counts of all contexts, of every order.

    A byte seen behind a context is seen behind its suffixes, so what is left
    out at an order is all that the next longer context has seen. Hence a
    context x needs, next to its own total and kinds, those of its suffix
    without what x has seen: by them ``escape`` and ``share`` (top: none left out).
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        """grams[k]: ascending, k bytes and the byte behind them; counts[k]: how often."""
        self.grams, self.counts = grams, counts
        self.contexts, self.suffix, self.top, self.down, self.share, self.all_down = [], [], [], [], [], []
        above = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (g, n) in enumerate(zip(grams, counts, strict=True)):
                own, of = np.unique(g >> 8, return_inverse=True)
                kinds = np.bincount(of, minlength=len(own))
                total = np.bincount(of, n, len(own))
                self.contexts.append(own)
                self.top.append((np.log10(total + kinds), np.log10(kinds)))
                if k:
                    up = np.searchsorted(self.contexts[k - 1], own & ((1 << 8 * (k - 1)) - 1))
                    known = counts[k - 1][np.searchsorted(grams[k - 1], g & ((1 << 8 * k) - 1))]
                    more = above[0][up] - kinds
                    whole = above[1][up] - np.bincount(of, known, len(own)) + more
                    down = np.where(more > 0, np.log10(more / whole), 0)
                    self.suffix.append(up)
                    self.share.append(np.log10(np.maximum(whole, 1)))
                    self.all_down.append(down + self.all_down[k - 1][up])
                else:
                    self.suffix.append(np.zeros(len(own), np.int64))
                    self.share.append(np.zeros(len(own)))
                    self.all_down.append(np.zeros(len(own)))
                above = kinds, total
        self.unseen = -math.log10(max(256 - len(grams[0]), 1))

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram (ORDER bytes and that byte)."""
        out = np.full(len(gram), self.unseen)
        have = np.full(len(gram), -1)           # order of the longest seen context, and its place
        place = np.zeros(len(gram), np.int64)
        todo = np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            key = (gram[todo] >> 8) & ((1 << 8 * k) - 1)
            at, hit = _find(self.contexts[k], key)
            have[todo[hit]], place[todo[hit]] = k, at[hit]
            todo = todo[~hit]
        todo = np.flatnonzero(have >= 0)        # nothing was learnt: any byte, and no escape
        before = np.zeros(len(gram), np.int64)  # place of the context one byte longer than k
        for k in range(ORDER, -1, -1):
            live = todo[have[todo] >= k]
            at, hit = _find(self.grams[k], gram[live] & ((1 << 8 * (k + 1)) - 1))
            done, n = live[hit], self.counts[k][at[hit]]
            first = have[done] == k
            a, b = done[first], done[~first]
            out[a] = np.log10(n[first]) - self.top[k][0][place[a]]
            if k < ORDER:
                x = before[b]
                out[b] += np.log10(n[~first]) - self.share[k + 1][x] - self.all_down[k + 1][x] - self.unseen
            live = live[~hit]
            begin = live[have[live] == k]       # escapes from the longest context, and so on down
            denominator, kinds = self.top[k]
            p = place[begin]
            out[begin] += kinds[p] - denominator[p] + self.all_down[k][p]
            before[live] = place[live]
            place[live] = self.suffix[k][place[live]]
            todo = np.concatenate([todo[have[todo] < k], live])
        return out


def _find(among: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in an ascending array, and which of them are there."""
    if not len(among):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(among, key), len(among) - 1)
    return at, among[at] == key


def bucket_of(gram: np.ndarray) -> np.ndarray:
    shared = (gram >> 8) & ((1 << 8 * SHARED) - 1)
    return (mix(shared.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, of = np.unique(gram, return_inverse=True)
    return own, np.bincount(of, n, len(own))


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The automaton of ``docs``, and the whole trie: every context and byte of every text is counted.

    trie: k, gram (k bytes and the byte behind them), n. The automaton has the
    contexts, of up to ORDER bytes, that occur most often, at most MAX_CONTEXTS
    of them. (With a context its suffixes and prefixes occur at least as often,
    so they are kept too.)
    """
    counts = gram_counts(docs, text)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(
        F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")) for k in range(ORDER + 1)]))
    trie = written(counts.select(levels.alias("x"), "n").groupBy("x.k", "x.gram").agg(F.sum("n").alias("n"))
                   .withColumn("context", F.shiftright("gram", 8)), "trie")
    sizes = trie.groupBy("k", "context").agg(F.sum("n").alias("n"))
    kept = most_frequent(sizes, MAX_CONTEXTS).select("k", "context")
    rows = trie.join(F.broadcast(kept), ["k", "context"], "left_semi").select("k", "gram", "n").toArrow()
    k, gram, n = (rows.column(c).to_numpy() for c in ("k", "gram", "n"))
    left_out = rows.num_rows < trie.count()
    return Model(k.astype(np.int64), gram.astype(np.int64), n.astype(np.float64), left_out), trie


PARTS = "bucket long, kind int, gram binary, n binary, ids array<long>, copies array<long>, logs array<double>"
_PARTS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("gram", pa.binary()), ("n", pa.binary()),
                    ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
                    ("logs", pa.list_(pa.float64()))])


def log_parts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, copy and log: parts of the log10 probability of every row of ``docs`` (doc_id, copy, text).

    The automaton scores what its contexts cover. Open bytes are gathered over
    many texts, dealt by the last bytes of their context and met with the
    counts of all longer contexts that end so; shorter ones, at most 256^SHARED
    grams at any size, are in every task. One row of the shuffle holds the open
    bytes of some texts for a bucket.
    """
    model, trie = fit(train)
    low = trie.where(F.col("k") < SHARED).select("k", "gram", "n").toArrow()
    k, gram, n = (low.column(c).to_numpy() for c in ("k", "gram", "n"))
    short = []
    for order in range(SHARED):
        some = np.flatnonzero(k == order)
        some = some[np.argsort(gram[some])]
        short.append((gram[some].astype(np.int64), n[some].astype(np.float64)))
    shared = docs.sparkSession.sparkContext.broadcast((model, short))

    def dealt(gram: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = bucket_of(gram)
        order = np.lexsort((gram, bucket))
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for some in np.split(order, edge)[1:]:
            yield int(bucket[some[0]]), some

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            gram, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_pylist([
                {"bucket": b, "kind": 0, "gram": gram[some].tobytes(), "n": n[some].tobytes()}
                for b, some in dealt(gram)], _PARTS)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH:
                yield made()
        if held:
            yield made()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        ids: list = []
        copies: list[int] = []
        logs, texts, grams, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal held
            log, text, gram = map(np.concatenate, (logs, texts, grams))
            rows = [{"bucket": copies[0] % BUCKETS, "kind": 1, "ids": ids[:], "copies": copies[:], "logs": log}]
            for b, some in dealt(gram):
                docs_of, of = np.unique(text[some], return_inverse=True)
                rows.append({"bucket": b, "kind": 1, "gram": (of << 48 | gram[some]).tobytes(),
                             "ids": [ids[i] for i in docs_of.tolist()],
                             "copies": [copies[i] for i in docs_of.tolist()]})
            for x in (ids, copies, logs, texts, grams):
                x.clear()
            held = 0
            return pa.RecordBatch.from_pylist(rows, _PARTS)

        for batch in slices(batches):
            log, text, gram = own.scores(texts_of(batch.column(2)))
            logs.append(log)
            texts.append(len(ids) + text)
            grams.append(gram)
            ids += batch.column(0).to_pylist()
            copies += batch.column(1).to_pylist()
            held += len(gram)
            if held >= FLUSH or len(ids) >= 1 << 14:     # a text's number has 15 bits
                yield made()
        if ids:
            yield made()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = shared.value[1]
        bucket, counts, rest = None, [], None
        for batch in slices(batches, 64):
            ids, copies, logs = [], [], []
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, counts, rest = r["bucket"], [], None
                if r["kind"] == 0:
                    counts.append((np.frombuffer(r["gram"], np.int64), np.frombuffer(r["n"], np.int64)))
                    continue
                if r["gram"] is not None:
                    if rest is None:
                        g, n = (np.concatenate([c[i] for c in counts] or [np.zeros(0, np.int64)]) for i in (0, 1))
                        longer = [summed(g & ((1 << 8 * (k + 1)) - 1), n) for k in range(SHARED, ORDER + 1)]
                        rest, counts = Rest(*map(list, zip(*short, *longer))), []
                    code = np.frombuffer(r["gram"], np.int64)
                    asked_of, of = np.unique(code & ((1 << 48) - 1), return_inverse=True)
                    logs.append(np.bincount(code >> 48, rest.costs(asked_of)[of], len(r["ids"])))
                else:
                    logs.append(np.array(r["logs"]))
                ids += r["ids"]
                copies += r["copies"]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int64()),
                                                  pa.array(np.concatenate(logs))], names=["doc_id", "copy", "log"])

    longest = trie.where(F.col("k") == ORDER).select("gram", "n")
    if not model.whole:
        longest = longest.limit(0)
    parts = longest.mapInArrow(counted, PARTS).union(docs.select("doc_id", "copy", "text").mapInArrow(asked, PARTS))
    return (parts.repartition("bucket").sortWithinPartitions("bucket", "kind")
            .mapInArrow(met, "doc_id long, copy long, log double"))


# -- scores ---------------------------------------------------------------------------------------

ROWS = "doc_id long, copy long, word binary, tf long, n_tokens long, n_known long, known_log double"


def score(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``learn`` (on ``doc_id``) marks the training documents. Tokens: words
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens, with exact counts of all training
    tokens: frequent words' counts (at most MAX_HEAD) go to every task, all
    other words meet their counts in a join. Without training documents N, V
    and all counts are 0 and the model is uniform. Null text is empty (one end).
    Repeated rows give repeated results.
    """
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text"))
    train = narrow.where(learn)
    spark = docs.sparkSession
    counts = written(word_counts(train), "words")
    n_docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    total, kinds = sums["n"] + n_docs, sums["v"] + (1 if n_docs else 0)
    offset = math.log10(total + kinds + 1)
    frequent = most_frequent(counts, MAX_HEAD)
    head_rows = frequent.toArrow()
    head = dict(zip(head_rows.column("word").to_pylist(), head_rows.column("n").to_pylist()))
    shared = spark.sparkContext.broadcast(head)
    end_log = math.log10(n_docs + 1) - offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            ids, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = texts_of(batch.column(2))
            out: list[list] = [[] for _ in range(7)]
            for i, t in enumerate(texts):
                words = t.lower().split()
                found = list(map(known.get, words))
                rest = Counter([w for w, c in zip(words, found) if c is None]) if None in found else {}
                have = np.array([c for c in found if c is not None] if rest else found, np.float64)
                base = float(np.log10(have + 1).sum()) - offset * len(have) + end_log
                # a document's own row travels under a key that no word has
                own = [b" %d %d" % (ids[i] or 0, copies[i])], [0], [len(words) + 1], \
                    [len(have) + (1 if n_docs else 0)], [base]
                for column, first, more in zip(out[2:], own, (list(rest), list(rest.values()), *(
                        [[None] * len(rest)] * 3)), strict=True):
                    column += first
                    column += more
                out[0] += [ids[i]] * (1 + len(rest))
                out[1] += [copies[i]] * (1 + len(rest))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)],
                                             names=[f.split()[0] for f in ROWS.split(", ")])

    texts = narrow.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    rows = texts.mapInArrow(run, ROWS)
    rare = counts.select("word", F.col("n").alias("c"))
    joined = rows.join(rare, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    known = F.coalesce("n_known", F.when(c > 0, F.col("tf")).otherwise(F.lit(0)))
    base = F.coalesce("known_log", F.col("tf") * (F.log10(c + 1) - F.lit(offset)))
    parts = joined.select("doc_id", "copy", "n_tokens", known.alias("known"), base.alias("base")).unionByName(
        log_parts(texts, train).select("doc_id", "copy", "log"), allowMissingColumns=True)
    sums = (parts.groupBy("doc_id", "copy")
            .agg(F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"),
                 F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("log").alias("log")))
    return (sums.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base") / F.col("copies")).alias("base_score"),
                    (F.col("log") / F.col("copies")).alias("score")))
