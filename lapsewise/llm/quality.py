"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample; the rules
then run in the order of rejections per cost, each only on the documents that
the ones before it kept, and a count is made when a rule first asks for it.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import Words, chunked, slices, texts_of

#: Documents in the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 400
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _words_of(words: Words, index: np.ndarray) -> Words:
    """The words of some of the texts, without splitting them again."""
    out = object.__new__(Words)
    low, high = words.base[index], words.base[index + 1]
    out.base = np.concatenate([[0], np.cumsum(high - low)])
    counts = words.first[index + 1] - words.first[index]
    out.first = np.concatenate([[0], np.cumsum(counts)])
    out.doc = np.repeat(np.arange(len(index)), counts)
    own = np.arange(out.first[-1]) + (words.first[index] - out.first[:-1])[out.doc]
    move = (out.base[:-1] - low)[out.doc]
    out.start, out.end, out.hash = words.start[own] + move, words.end[own] + move, words.hash[own]
    for name in ("buf", "space"):
        parts = [getattr(words, name)[a:b] for a, b in zip(low.tolist(), high.tolist())]
        setattr(out, name, np.concatenate(parts) if parts else getattr(words, name)[:0])
    return out


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Texts:
    """Some texts with the counts that rules ask for, each counted on first use."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self._kept: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = getattr(self, f"count_{name}")()
        return self._kept[name]

    def only(self, index: np.ndarray) -> Texts:
        """Some of the texts, with the counts already made."""
        out = Texts([self.texts[i] for i in index])
        out._kept = {name: _words_of(made, index) if name == "words" else made[index]
                     for name, made in self._kept.items()}
        return out

    def count_words(self) -> Words:
        return Words(self.texts, lower=False)

    def count_n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    def count_word_chars(self) -> np.ndarray:
        w = self.words
        return _per_text(~w.space & ((w.buf & 0xC0) != 0x80), w.base)

    def count_n_symbols(self) -> np.ndarray:
        return _per_text(_SYMBOL[self.words.buf], self.words.base)

    def _lines(self) -> Iterator[tuple[int, int]]:
        for t in self.texts:
            lines = [x for x in t.split(b"\n") if x.split(None, 1)]
            yield len(lines), len(lines) - len(set(lines))

    def count_line_counts(self) -> np.ndarray:
        return np.array(list(self._lines()), np.int64).reshape(-1, 2)

    def count_n_lines(self) -> np.ndarray:
        return self.line_counts[:, 0]

    def count_n_dup_lines(self) -> np.ndarray:
        return self.line_counts[:, 1]

    def count_n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that the text has twice or more (the first included)."""
        w = self.words
        k = len(w.hash) - 2
        if k <= 0:
            return np.zeros(len(self.texts), np.int64)
        gram, _ = w.grams(3)
        at = np.flatnonzero(w.doc[:k] == w.doc[2:])
        order = np.lexsort((gram, w.doc[at]))
        g, d = gram[order], w.doc[at][order]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(g), bool)
        again[1:] |= same
        again[:-1] |= same
        covered = np.zeros(len(w.hash), bool)
        hit = at[order[again]]
        for i in range(3):
            covered[hit + i] = True
        return _per_text(covered, w.first)

    def count_n_alpha_words(self) -> np.ndarray:
        """Words with a letter (a byte A-Z, a-z or of a non-ASCII character)."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(_LETTER[w.buf], dtype=np.int64)])
        return _per_text(total[w.end] > total[w.start], w.first)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The production rules; thresholds in whole numbers, so that both sides are exact.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 12 * t.n_words)),
    Rule("few_letters", lambda t: 100 * t.n_alpha_words < 40 * t.n_words),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_order(sample: list[bytes], rules: tuple[Rule, ...] = RULES,
                   made: tuple[str, ...] = ()) -> list[str]:
    """Names of the rules by rejections per second on the sample, best first.

    Greedy: after a rule is placed, the rest is measured on what it keeps, with
    the counts that it and the rules before it made (a later rule has them for
    nothing). ``made`` are counts that are made in any case and cost no rule
    anything. An empty sample keeps the given order.
    """
    view = Texts(sample)
    for name in made:
        getattr(view, name)
    left, order = list(rules), []
    while left:
        rates = []
        for rule in left:
            if not view.texts:
                rates.append(0.0)
                continue
            trial = view.only(np.arange(len(view.texts)))
            began = time.perf_counter()
            rejected = int(rule.rejects(trial).sum())
            rates.append(rejected / max(time.perf_counter() - began, 1e-7))
        best = left.pop(int(np.argmax(rates)))
        order.append(best.name)
        if view.texts:
            view = view.only(np.flatnonzero(~best.rejects(view)))
    return order


def cascade(view: Texts, order: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """(name of the rule that rejects each text, "" for a kept one; rules tried on each text).

    Each rule sees only survivors, and each count is made once, for the texts that are alive when a
    rule first asks for it.
    """
    by_name = {r.name: r for r in rules}
    said = np.full(len(view.texts), "", object)
    tried = np.zeros(len(view.texts), np.int32)
    alive = np.arange(len(view.texts))
    for name in order:
        if not len(alive):
            break
        tried[alive] += 1
        bad = by_name[name].rejects(view)
        if bad.any():
            said[alive[bad]] = name
            alive = alive[~bad]
            view = view.only(np.flatnonzero(~bad))
    return said, tried


#: The rules whose rejections are base_failed.
BASE = ("few_words", "repeated_windows")
VERDICT = "kept boolean, rejected_by string, rules_tried int"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          f"n_repeat_words long, base_failed boolean, {VERDICT}")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                counts: bool = True) -> DataFrame:
    """Verdict of every document (``doc_id``, ``text``), and its counts.

    Words are ``[^\\x20\\x09-\\x0D]+``. kept: no rule rejects; rejected_by:
    the rule that did; rules_tried: how many rules the document was put to.
    With ``counts`` (the base counts, and base_failed: few_words or
    repeated_windows rejects) those are made for every document; the base rules
    come first, and the rest runs as a cascade on what passes them, on the counts
    already made. Without, all rules run as one cascade and nothing is counted
    before a rule asks for it: doc_id and the verdict return. Null and empty texts
    have zero counts and fail the base. Only the order of the rules comes
    from the sample (at most ``sample_rows`` texts of at most 64 KiB), so
    kept never depends on it. One scan, no shuffle.
    """
    picked = (docs.where(F.length("text") <= 1 << 16)
              .select("text").limit(sample_rows).collect())
    order = measured_order([r[0].encode() for r in picked], rules, COUNTS if counts else ())
    if counts:
        order = [*BASE, *(n for n in order if n not in BASE)]
        rules = (*rules, *(r for r in RULES if r.name in BASE and r not in rules))
    schema = SCHEMA if counts else f"doc_id long, {VERDICT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            all_texts = texts_of(batch.column("text"))
            for a, b in chunked(all_texts):
                view, made = Texts(all_texts[a:b]), []
                if counts:
                    made = [np.asarray(getattr(view, c), np.int64) for c in COUNTS]
                said, tried = cascade(view, order, rules)
                if counts:
                    made.append(np.isin(said, BASE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *map(pa.array, made),
                     pa.array(said == ""), pa.array([s or None for s in said], pa.string()), pa.array(tried)],
                    names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
