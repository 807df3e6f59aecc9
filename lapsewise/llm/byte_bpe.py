"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

Encoding. A token sequence is the BPE encoding of its bytes exactly when every
two neighbours stay apart if their bytes are encoded alone. So encodings are
the accepting runs of a nondeterministic transducer whose threads walk the
token trie and may start token v after token u only if (u, v) stay apart. It
is determinised while it reads: a state is the set of live threads. No thread
lives longer than the longest token, so the lookahead is bounded and a text
costs time linear in its length.

Decoding. The bytes of the tokens run through the UTF-8 automaton, token by
token, so ids can arrive in pieces and text leaves at character boundaries.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from lapsewise.llm.common import map_texts

#: States that a worker keeps before it starts anew; words over so many bytes run alone.
MAX_STATES, IN_STEP = 1 << 17, 512


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (read on the driver, a few MB at most; sent to the tasks)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def compiled(pattern: str) -> regex.Pattern:
    """The splitting pattern, with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: A character for each class that splitting patterns name: letter, number, white space, none of them.
STAND_INS = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u00a0", "": "\ufdd0"}


def class_changes() -> dict[int, str]:
    """Code points that the library puts in another class than ``regex`` does (whose Unicode tables are of
    another version), with a stand-in of the class that the library has for them.

    The library keeps exactly what its pattern matches, so one call per class tells the class of all code points.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    theirs, ours = dict.fromkeys(every, ""), dict.fromkeys(every, "")
    for name in filter(None, STAND_INS):
        kept = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs.update(dict.fromkeys(bytes(kept.encode_ordinary(every)).decode(), name))
        ours.update(dict.fromkeys(compiled(name).findall(every), name))
    return {ord(c): STAND_INS[name] for c, name in theirs.items() if ours[c] != name}


class Transducer:
    """Encodes the bytes of one match of the pattern.

    A state is the set of live threads (trie node, left context); the left
    context is the token before the node's first byte, or, near the leaves of
    the trie, only the set of tokens below the node that may not follow it, so
    that contexts which no longer differ share a state. Each transition names
    the one token that ends an encoding of the bytes read so far, so a live
    thread's past is read off these from the right. A token is certain as soon
    as the pasts of all live threads have it, or the match ends; ``stream``
    emits it then, and long matches are encoded that way. Short ones run in
    step and are read off at their ends.
    """

    ROOT, SMALL = 0, 6
    FREE = -2                                   # a left context after which all tokens below may follow

    def __init__(self, ranks: dict[bytes, int], limit: int = MAX_STATES):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = [0] * (max(ranks.values(), default=-1) + 1)
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.depth = [0]                        # bytes read by a thread at a node
        below = [0]
        for word, rank in ranks.items():
            self.length[rank] = len(word)
            node = self.ROOT
            for b in word:
                below[node] += 1
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    below.append(0)
                node = after
            self.token[node] = rank
        #: the tokens below a node that has few of them
        self.few: dict[int, list[int]] = {node: [] for node, n in enumerate(below) if n <= self.SMALL}
        for word, rank in ranks.items():
            node = self.ROOT
            for b in word:
                if node in self.few:
                    self.few[node].append(rank)
                node = self.child[node << 8 | b]
        self.lengths = np.array(self.length, np.int64)
        self.apart: dict[int, bool] = {}
        #: whole matches that are tokens although merging does not give them
        self.unreached = {w: r for w, r in ranks.items() if len(w) > 1 and not self.may_follow(-1, r)}
        self.restart()

    def restart(self) -> None:
        self.threads: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.column = np.zeros(256, np.int64)                   # byte -> column of the table, 0: none yet
        self.columns = 1
        #: table[state, column]: the next state, -1 where it is not determinised yet
        self.table = np.full((1024, 32), -1, np.int32)
        self.ends = np.full(1024, -1, np.int32)                 # the token that ends where a state is entered
        self.left: dict[tuple[int, int], int | None] = {}
        self.blocked: list[frozenset] = [frozenset()]           # of left context FREE - i
        self.blocked_number: dict[frozenset, int] = {frozenset(): 0}
        self.state_of(((self.ROOT, -1),))

    def state_of(self, threads: tuple[tuple[int, int], ...]) -> int:
        known = self.number.get(threads)
        if known is None:
            known = self.number[threads] = len(self.threads)
            self.threads.append(threads)
            if known == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.ends = np.concatenate([self.ends, np.full_like(self.ends, -1)])
            self.ends[known] = threads[-1][1]
        return known

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE of a few bytes: again and again the lowest-ranked pair, leftmost first."""
        parts, get = [word[i:i + 1] for i in range(len(word))], self.ranks.get
        while len(parts) > 1:
            pairs = [get(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, u: int, v: int) -> bool:
        """Whether tokens u, v stay apart; u = -1: whether v is the encoding of its own bytes."""
        key = (u + 1) << 32 | v
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 16 * self.limit:
                self.apart.clear()
            word, alone = (self.bytes_of[u], [u]) if u >= 0 else (b"", [])
            known = self.apart[key] = self.merged(word + self.bytes_of[v]) == [*alone, v]
        return known

    def narrowed(self, node: int, left: int) -> int | None:
        """The left context as far as it still matters at ``node``; None if no token lies below."""
        key = (node, left)
        if key in self.left:
            return self.left[key]
        few = self.few[node]
        if left >= -1:
            bad = frozenset(v for v in few if not self.may_follow(left, v))
        else:
            bad = self.blocked[self.FREE - left].intersection(few)
        if len(bad) == len(few):
            out = None
        else:
            number = self.blocked_number.setdefault(bad, len(self.blocked))
            if number == len(self.blocked):
                self.blocked.append(bad)
            out = self.FREE - number
        self.left[key] = out
        return out

    def advance(self, state: int, b: int) -> int:
        """Determinise one transition: the next state."""
        after, ends, few = [], -1, self.few
        for node, left in self.threads[state]:
            node = self.child.get(node << 8 | b)
            if node is None:
                continue
            v = self.token[node]
            if v >= 0 and (self.may_follow(left, v) if left >= -1
                           else v not in self.blocked[self.FREE - left]):
                ends = v
            if node in few:
                left = self.narrowed(node, left)
            if left is not None:
                after.append((node, left))
        after.append((self.ROOT, ends))
        made = self.state_of(tuple(after))
        if not self.column[b]:
            self.column[b] = self.columns
            self.columns += 1
            if self.columns > self.table.shape[1]:
                self.table = np.hstack([self.table, np.full_like(self.table, -1)])
        self.table[state, self.column[b]] = made
        return made

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in their order, number of ids of each word)."""
        if len(self.threads) > self.limit:
            self.restart()
        size = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.empty(len(text), np.int32)
        order = np.argsort(-size, kind="stable")
        alone = int(np.searchsorted(-size[order], -IN_STEP, "left"))
        apart = {int(i): np.fromiter((v for some in self.stream([words[i]]) for v in some), np.uint32)
                 for i in order[:alone]}
        inside = size.copy()
        inside[order[:alone]] = 0               # nothing to read off: encoded apart
        order = order[alone:]
        if len(order):
            self._in_step(text, ends, base[order], size[order])
        ids, count = self._read_off(ends, base, inside)
        if self.unreached:
            apart.update((i, np.array([self.unreached[w]], np.uint32))
                         for i, w in enumerate(words) if w in self.unreached)
        if apart:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i, own in apart.items():
                parts[i], count[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, count

    def stream(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one match whose bytes arrive in pieces, each as soon as it is certain.

        Only the bytes behind the last certain token are held. (A match that is itself a token which
        merging does not give is ``encode``'s matter.)
        """
        longest = int(self.lengths.max(initial=1))
        state, ends, wait = self.state_of(((self.ROOT, -1),)), [], longest
        for piece in pieces:
            for b in piece:
                after = self.table.item(state, self.column.item(b))
                state = after if after >= 0 else self.advance(state, b)
                ends.append(self.ends.item(state))
                if len(ends) >= wait:
                    threads = self.threads[state]
                    cut = self._certain(threads, ends)
                    if cut:
                        yield self._tokens(ends, cut)
                        ends = ends[cut:]
                        state = self.state_of(threads)          # the machine may have started anew
                    wait = len(ends) + longest
        if ends:
            yield self._tokens(ends, len(ends))

    def _certain(self, threads: tuple[tuple[int, int], ...], ends: list[int]) -> int:
        """The last place up to which the pasts of all live threads have the same tokens."""
        places = {len(ends) - self.depth[node] for node, _ in threads}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length[ends[last - 1]])
        return places.pop()

    def _tokens(self, ends: list[int], stop: int) -> list[int]:
        found = []
        while stop:
            found.append(ends[stop - 1])
            stop -= self.length[found[-1]]
        return found[::-1]

    def _in_step(self, text: np.ndarray, ends: np.ndarray, base: np.ndarray, size: np.ndarray) -> None:
        """All words at once, longest first: the tokens that end at each byte."""
        state = np.zeros(len(base), np.int64)
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for p, n in enumerate(active.tolist()):
            at = base[:n] + p
            b = text[at]
            after = self.table[state[:n], self.column[b]]
            unknown = np.flatnonzero(after < 0)
            if len(unknown):
                pairs, which = np.unique(state[unknown] << 8 | b[unknown], return_inverse=True)
                made = [self.advance(int(k) >> 8, int(k) & 255) for k in pairs]
                after[unknown] = np.array(made, np.int32)[which]
            state[:n] = after
            ends[at] = self.ends[after]

    def _read_off(self, ends: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, from its right end to its left."""
        at, word, found = base + size, np.flatnonzero(size > 0), []
        count = np.zeros(len(base), np.int64)
        while len(word):
            v = ends[at[word] - 1]
            found.append((word, v))
            at[word] -= self.lengths[v]
            count[word] += 1
            word = word[at[word] > base[word]]
        last = np.cumsum(count) - 1
        ids = np.empty(int(count.sum()), np.uint32)
        for k, (word, v) in enumerate(found):
            ids[last[word] - k] = v
        return ids, count


class TextEncoder:
    """Ids of whole texts: every match of the pattern through the transducer.

    Code points in ``changes`` are split as their stand-ins are.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, changes: dict[int, str] | None = None):
        self.machine, self.matches = Transducer(ranks), compiled(pattern)
        self.changes = class_changes() if changes is None else changes
        self.changed = frozenset(map(chr, self.changes))

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.changed.isdisjoint(text):
            return self.matches.findall(text)
        return [text[m.start():m.end()] for m in self.matches.finditer(text.translate(self.changes))]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.split(t) for t in texts]
        ids, count = self.machine.encode([m.encode() for some in found for m in some])
        total = np.concatenate([[0], np.cumsum(count)])
        stop = total[np.cumsum([0, *map(len, found)])].tolist()
        return [ids[a:b] for a, b in zip(stop, stop[1:])]


# -- decoding -------------------------------------------------------------------------------------

# The UTF-8 automaton (state -> ranges of the next byte -> state; 0 accepts, 8 is an error).
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5),
        (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
}
ERROR = 8


def _automaton() -> list[list[int]]:
    table = [[ERROR] * 256 for _ in range(9)]
    for state, ranges in _UTF8.items():
        for low, high, after in ranges:
            table[state][low:high + 1] = [after] * (high + 1 - low)
    return table


class Decoder:
    """Bytes and text of ids; ``feed`` takes them in pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        self.table = _automaton()
        self.whole = np.array([self.run(0, w) == 0 for w in self.bytes_of], bool)
        self.held, self.state = b"", 0

    def run(self, state: int, word: bytes) -> int:
        for b in word:
            state = self.table[state][b]
        return state

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def feed(self, ids: np.ndarray) -> str:
        """Text that is complete after these ids; an incomplete character waits for the next call.

        Bytes that are not UTF-8 become U+FFFD.
        """
        ids = np.asarray(ids, np.int64)
        if self.state == 0 and self.whole[ids].all():
            return self.to_bytes(ids.tolist()).decode()
        data, state, good = self.held + self.to_bytes(ids.tolist()), 0, 0
        for at, b in enumerate(data):
            state = self.table[state][b]
            if state == 0:
                good = at + 1
            elif state == ERROR:
                state = self.table[0][b]
                good = at if state not in (0, ERROR) else at + 1
                state = 0 if state == ERROR else state
        self.held, self.state = data[good:], state
        return data[:good].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held, self.state = self.held, b"", 0
        return rest.decode("utf-8", "replace")


# -- Spark ----------------------------------------------------------------------------------------

_CODECS: dict[tuple, tuple[TextEncoder, Decoder, list[bytes]]] = {}


def _codec(blob: bytes, changes: dict[int, str], pattern: str) -> tuple[TextEncoder, Decoder, list[bytes]]:
    """The codec of a rank file, built once in a Python worker."""
    key = (hashlib.sha256(blob).digest(), pattern)
    if key not in _CODECS:
        ranks = parse_ranks(blob)
        decimals = [b"%d" % i for i in range(max(ranks.values(), default=-1) + 1)]
        _CODECS[key] = TextEncoder(ranks, pattern, changes), Decoder(ranks), decimals
        gc.collect()
        gc.freeze()                             # the tables live as long as the worker
        gc.set_threshold(200_000, 50, 100)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` plus ``ids`` (array of int) of every whole text; null counts as empty."""
    blob = docs.sparkSession.sparkContext.broadcast((read_ranks(path), class_changes()))

    def make():
        encoder = _codec(*blob.value, pattern)[0]
        return lambda texts: [[ids.astype(np.int32) for ids in encoder([t.decode() for t in texts])]]

    return map_texts(docs, keep, "ids array<int>", make, text)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus n_tokens, and the SHA-256 of the ids (decimals joined by commas) and of the bytes
    that the streaming decoder makes of them, for every whole text. One scan, no shuffle."""
    blob = docs.sparkSession.sparkContext.broadcast((read_ranks(path), class_changes()))

    def make():
        encoder, decoder, decimals = _codec(*blob.value, pattern)

        def of(texts: list[bytes]) -> list:
            counts, id_digests, text_digests = [], [], []
            for ids in encoder([t.decode() for t in texts]):
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(b",".join([decimals[i] for i in ids.tolist()])).hexdigest())
                digest = hashlib.sha256()
                for at in range(0, len(ids), 1 << 16):
                    digest.update(decoder.feed(ids[at:at + (1 << 16)]).encode())
                digest.update(decoder.close().encode())
                text_digests.append(digest.hexdigest())
            return [counts, id_digests, text_digests]

        return of

    return map_texts(docs, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, text)
