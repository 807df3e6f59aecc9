"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a learned vector of its hash next to the sum of learned
vectors of its first characters (prefixes of several lengths) and its last
ones. All overlapping windows of a text are scored; a document's score comes
from its largest, three largest and mean window logits, by a logistic fit on
sample rows that took no part in training. The
network is trained on windows: in a toxic document the windows that score
highest are taken as toxic, in a clean one the highest and some others as clean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import Words, chunked, map_texts

#: Words of a window and words from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Lengths of a word's prefixes, in bytes.
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
#: Sizes of the hashed tables, of a vector in them, and of the hidden state.
WORD_BUCKETS, GRAM_BUCKETS, DIM, HIDDEN = 1 << 16, 1 << 18, 2, 6
#: Bounds of the training sample: rows of each label, characters of a text.
#: Windows of a training step, and steps of a turn (two passes over its windows at least).
BATCH, STEPS = 256, 60
#: Step of the tables' rows against that of the network.
TABLE_RATE = 0.05
#: A bucket's log odds: documents that it needs, and documents at the base rate added to it.
SUPPORT, PSEUDO = 3, 2
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 1800, 1 << 14


@dataclass
class Model:
    word: np.ndarray
    gram: np.ndarray
    net: dict[str, np.ndarray]
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))
    prior: float = 0.0
    adam: dict = field(default_factory=dict)


# -- inputs ---------------------------------------------------------------------------------------

@dataclass
class Inputs:
    """Buckets of some texts' words, and of each word's PREFIXES byte prefixes and its last bytes."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray


def inputs(texts: list[bytes]) -> Inputs:
    parts = [_inputs(texts[a:b]) for a, b in chunked(texts)] or [_inputs([])]
    if len(parts) == 1:
        return parts[0]
    shift = np.cumsum([0] + [len(p.word) for p in parts])
    return Inputs(np.concatenate([p.word for p in parts]), np.hstack([p.gram for p in parts]),
                  np.concatenate([[0]] + [p.first[1:] + k for p, k in zip(parts, shift)]))


def _inputs(texts: list[bytes]) -> Inputs:
    w = Words(texts, lower=True)
    size = w.end - w.start
    grams = [w.part_hash(w.start, w.start + np.minimum(size, n)) for n in PREFIXES]
    grams.append(w.part_hash(w.end - np.minimum(size, 4), w.end) + np.uint64(1))
    gram = np.array([g % np.uint64(GRAM_BUCKETS) for g in grams], np.int32).reshape(len(PREFIXES) + 1, -1)
    return Inputs((w.hash % np.uint64(WORD_BUCKETS)).astype(np.int32), gram, w.first)


def vectors(model: Model, x: Inputs) -> np.ndarray:
    """(words + 1, 2 * DIM); the last row, for padding, is zero."""
    out = np.zeros((len(x.word) + 1, 2 * DIM), np.float32)
    out[:-1, :DIM] = model.word[x.word]
    for row in x.gram:
        out[:-1, DIM:] += model.gram[row]
    return out


def windows(first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) word rows, ``pad`` behind a text's end, and the text of each window.

    Windows start every STRIDE words until one reaches the text's end; a text
    without words has none.
    """
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = first[:-1][doc] + step * STRIDE
    rows = at[None, :] + np.arange(WINDOW)[:, None]
    return np.where(rows < first[1:][doc], rows, pad), doc


# -- network: arrays are (window step, feature, window), so that a gate is one block of memory --------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _tanh(x: np.ndarray) -> np.ndarray:
    y = np.multiply(x, -2)
    np.exp(y, out=y)
    y += 1
    np.reciprocal(y, out=y)
    y *= 2
    y -= 1
    return y


def new_net(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 2 * DIM, HIDDEN
    net = {"attend": rng.normal(0, 0.4, (h, 2 * h)), "attend_b": np.zeros((h, 1)),
           "attend_v": rng.normal(0, 0.4, h), "out": rng.normal(0, 0.4, 2 * h), "out_b": np.zeros(1)}
    for way in ("f", "b"):
        net |= {f"x_{way}": rng.normal(0, 0.4, (3 * h, d)), f"h_{way}": rng.normal(0, 0.3, (3 * h, h)),
                f"bias_{way}": np.zeros((3 * h, 1))}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _gru(net: dict, way: str, x: np.ndarray, out: np.ndarray, kept: list | None = None) -> None:
    """States into ``out`` (T, HIDDEN, n) over ``x`` (T, d, n), from the end for way "b"."""
    steps, _, n = x.shape
    k = HIDDEN
    h = np.zeros((k, n), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        into = net[f"x_{way}"] @ x[t]
        into += net[f"bias_{way}"]
        own = net[f"h_{way}"] @ h
        into[: 2 * k] += own[: 2 * k]
        gate = _sigmoid(into[: 2 * k])
        z, r = gate[:k], gate[k:]
        into[2 * k:] += r * own[2 * k:]
        new = _tanh(into[2 * k:])
        if kept is not None:
            kept.append((t, h, z, r, new, own[2 * k:]))
        h = h - new
        h *= z
        h += new
        out[t] = h


def forward(net: dict, x: np.ndarray, valid: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logit of each window of ``x`` (T, d, n); ``valid`` (T, n) marks words."""
    steps, _, n = x.shape
    runs = {"f": [], "b": []} if kept is not None else {"f": None, "b": None}
    state = np.empty((steps, 2 * HIDDEN, n), np.float32)
    _gru(net, "f", x, state[:, :HIDDEN], runs["f"])
    _gru(net, "b", x, state[:, HIDDEN:], runs["b"])
    seen = _tanh(net["attend"] @ state + net["attend_b"])
    e = np.where(valid, np.einsum("k,tkn->tn", net["attend_v"], seen), np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tkn->kn", a, state)
    if kept is not None:
        kept.update(runs=runs, state=state, seen=seen, a=a, pooled=pooled, x=x)
    return net["out"] @ pooled + net["out_b"][0]


def backward(net: dict, kept: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the inputs."""
    g = {k: np.zeros_like(v) for k, v in net.items()}
    state, seen, a, x = kept["state"], kept["seen"], kept["a"], kept["x"]
    g["out"], g["out_b"] = kept["pooled"] @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = net["out"][:, None] * d_logit
    d_a = np.einsum("kn,tkn->tn", d_pooled, state)
    d_e = a * (d_a - (a * d_a).sum(0))
    g["attend_v"] = np.einsum("tn,tkn->k", d_e, seen)
    d_seen = d_e[:, None, :] * net["attend_v"][:, None] * (1 - seen ** 2)
    g["attend"] = np.einsum("tin,tjn->ij", d_seen, state)
    g["attend_b"] = d_seen.sum((0, 2))[:, None]
    d_state = a[:, None, :] * d_pooled + net["attend"].T @ d_seen
    d_x = np.zeros_like(x)
    k = HIDDEN
    for i, way in enumerate("fb"):
        d_h = np.zeros((k, x.shape[2]), np.float32)
        for t, h, z, r, new, own in reversed(kept["runs"][way]):
            d_h = d_h + d_state[t, i * k:(i + 1) * k]
            d_new = d_h * (1 - z) * (1 - new ** 2)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new])
            d_own = np.concatenate([d_z, d_r, d_new * r])
            g[f"h_{way}"] += d_own @ h.T
            g[f"x_{way}"] += d_in @ x[t].T
            g[f"bias_{way}"] += d_in.sum(1, keepdims=True)
            d_x[t] += net[f"x_{way}"].T @ d_in
            d_h = d_h * z + net[f"h_{way}"].T @ d_own
    return g, d_x


def window_logits(model: Model, v: np.ndarray, rows: np.ndarray, piece: int = 2048) -> np.ndarray:
    pad = len(v) - 1
    parts = [np.zeros(0, np.float32)]
    for a in range(0, rows.shape[1], piece):
        at = rows[:, a:a + piece]
        parts.append(forward(model.net, np.ascontiguousarray(v[at].transpose(0, 2, 1)), at != pad))
    return np.concatenate(parts)


# -- training -------------------------------------------------------------------------------------

def _log_odds(bucket: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of each bucket by the documents of either label that have it."""
    pairs = np.unique(doc.astype(np.uint32) * np.uint32(size) + bucket.astype(np.uint32))
    hit, of = pairs % np.uint32(size), y[pairs // np.uint32(size)]
    toxic, clean = (np.bincount(hit[of == k], minlength=size) for k in (1, 0))
    rate = (y.sum() + 1) / (len(y) + 2)
    share = (toxic + PSEUDO * rate) / (toxic + clean + PSEUDO)
    return np.where(toxic + clean >= SUPPORT, np.log(share / (1 - share)) - np.log(rate / (1 - rate)), 0)


def train(texts: list[bytes], labels: np.ndarray, turns: int = 4, seed: int = 7) -> Model:
    """A model from labelled texts; without both labels, one that scores all texts by their share."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    zero = Model(np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((GRAM_BUCKETS, DIM), np.float32),
                 new_net(rng), prior=float(y.mean()) if len(y) else 0.0)
    zero.scale = np.array([0, 0, 0, np.log((zero.prior + 1e-3) / (1 - zero.prior + 1e-3))])
    used = [i for i, t in enumerate(texts) if t.strip()]
    texts, y = [texts[i] for i in used], y[used]
    if len(set(y)) < 2:
        return zero
    order = rng.permutation(len(texts))
    apart = np.zeros(len(texts), bool)
    apart[order[: len(order) // 5]] = len(order) >= 50
    x = inputs(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(x.first))
    model = Model(rng.normal(0, 0.1, (WORD_BUCKETS, DIM)).astype(np.float32),
                  rng.normal(0, 0.02, (GRAM_BUCKETS, DIM)).astype(np.float32), new_net(rng),
                  prior=float(y.mean()))
    mine = ~apart[doc]
    new_id = np.cumsum(~apart) - 1
    of_word, seen = new_id[doc[mine]], y[~apart]
    model.word[:, 0] = np.clip(_log_odds(x.word[mine], of_word, seen, WORD_BUCKETS), -1, 4)
    model.gram[:, 0] = np.clip(_log_odds(x.gram[:, mine].ravel(), np.tile(of_word, len(x.gram)), seen,
                                         GRAM_BUCKETS), -1, 4) / 3
    rows, of = windows(x.first, len(x.word))
    for turn in range(turns):
        v = vectors(model, x)
        score = window_logits(model, v, rows) if turn else (v[:, 0] + v[:, DIM])[rows].max(0)
        chosen, target = _choose(score, of, y, apart, rng)
        done, least = 0, max(2 * -(-len(chosen) // BATCH), STEPS)
        while done < least:
            for at in np.array_split(rng.permutation(len(chosen)), -(-len(chosen) // BATCH)):
                _step(model, x, rows[:, chosen[at]], target[at], 0.01 if turn < turns - 1 else 0.003)
                done += 1
    seen = pooled(window_logits(model, vectors(model, x), rows), of, len(texts))
    held = apart if apart.any() else ~apart
    model.scale = _calibrate(seen[held], y[held])
    model.adam = {}
    return model


def pooled(logits: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """(n, 4): of each text's window logits the largest, the mean of the three largest, the mean, and 1.

    ``of`` ascends. A text without windows has zeros.
    """
    out = np.zeros((n, 4), np.float32)
    order = np.lexsort((-logits, of))
    first = np.searchsorted(of, np.arange(n))
    count = np.searchsorted(of, np.arange(n), "right") - first
    some = count > 0
    ranked = np.concatenate([logits[order], np.zeros(3, np.float32)])
    at, size = first[some], count[some]
    top = np.array([np.where(i < size, ranked[at + i], 0) for i in range(3)])
    total = np.concatenate([[0], np.cumsum(logits, dtype=np.float64)])
    out[some] = np.array([top[0], top.sum(0) / np.minimum(size, 3),
                          (total[at + size] - total[at]) / size, np.ones(len(at))]).T
    return out


def _choose(score: np.ndarray, of: np.ndarray, y: np.ndarray, apart: np.ndarray,
            rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: the best of each toxic text; of each clean one the two best and two others."""
    order = np.lexsort((-score, of))
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    toxic = y[of[order]] == 1
    take = ~apart[of[order]] & np.where(toxic, rank < 1, (rank < 2) | (rng.random(len(of)) * (
        np.bincount(of, minlength=len(y))[of]) < 2))
    chosen = order[take]
    return chosen, y[of[chosen]].astype(np.float32)


def _step(model: Model, x: Inputs, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    pad = len(x.word)
    used, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape)
    real = used[used != pad]
    v = np.zeros((len(real) + 1, 2 * DIM), np.float32)
    v[:-1, :DIM] = model.word[x.word[real]]
    for row in x.gram:
        v[:-1, DIM:] += model.gram[row[real]]
    kept: dict = {}
    logit = forward(model.net, np.ascontiguousarray(v[at].transpose(0, 2, 1)), rows != pad, kept)
    weight = np.where(target > 0, 1 / max(target.mean(), 0.05), 1.0).astype(np.float32)
    d_logit = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
    grads, d_x = backward(model.net, kept, d_logit)
    d_v = np.zeros_like(v)
    np.add.at(d_v, at.ravel(), d_x.transpose(0, 2, 1).reshape(-1, 2 * DIM))
    for k, grad in grads.items():
        _adam(model, k, model.net[k], grad + 1e-4 * model.net[k], rate)
    _sparse(model.word, x.word[real], d_v[:-1, :DIM], rate * TABLE_RATE)
    _sparse(model.gram, x.gram[:, real].ravel(), np.tile(d_v[:-1, DIM:], (len(x.gram), 1)), rate * TABLE_RATE)


def _adam(model: Model, key: str, w: np.ndarray, grad: np.ndarray, rate: float) -> None:
    m, s, t = model.adam.get(key, (np.zeros_like(w), np.zeros_like(w), 0))
    m, s, t = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad ** 2, t + 1
    model.adam[key] = (m, s, t)
    w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-7)


def _sparse(table: np.ndarray, bucket: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """A normalised step of the rows that the batch used."""
    rows, at = np.unique(bucket, return_inverse=True)
    total = np.zeros((len(rows), table.shape[1]), np.float32)
    np.add.at(total, at, grad)
    table[rows] -= rate * total / (np.abs(total).max() + 1e-7)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic fit on ``pooled`` (Newton steps)."""
    w = np.array([0.5, 0.5, 0.0, 0.0])
    x = x.astype(np.float64)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = 1e-2 * np.array([1, 1, 1, 0.01])
        grad = x.T @ (p - y) / len(y) + pull * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pull + 1e-6)
        w = w - np.linalg.solve(hess, grad)
    return w


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Score of each whole text, from all its windows; 0 for a text without words."""
    seen = [np.zeros((0, 4), np.float32)]
    with np.errstate(over="ignore"):
        for a, b in chunked(texts):
            x = inputs(texts[a:b])
            rows, of = windows(x.first, len(x.word))
            seen.append(pooled(window_logits(model, vectors(model, x), rows), of, b - a))
    p = np.concatenate(seen)
    return np.where(p[:, 3] > 0, 1 / (1 + np.exp(-np.clip(p @ model.scale, -30, 30))), 0.0)


# -- Spark ----------------------------------------------------------------------------------------

def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text") -> Model:
    """Train on a bounded sample of labelled documents where ``learn`` (on ``doc_id``) holds.

    labels: ``doc_id``, ``toxic`` (null: not used; of repeated ids the larger
    counts). At most about SAMPLE_TOXIC and SAMPLE_CLEAN rows are drawn by a
    hash of the id; sampled texts over SAMPLE_CHARS are left out of training.
    """
    known = (labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE_TOXIC / max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1.0, SAMPLE_CLEAN / max(1, n.get(0, 0)))))
    drawn = (known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate * 1_000_003)
             .limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN)))
    own = docs.where(F.length(text).between(1, SAMPLE_CHARS)).select("doc_id", F.col(text).alias("text"))
    rows = (own.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")
            .limit(4 * (SAMPLE_TOXIC + SAMPLE_CLEAN)).collect())
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score",
          text: str = "text") -> DataFrame:
    """The columns ``keep`` plus ``name``: the score (0 to 1) of every whole text.

    A null or empty text, and one without words, scores 0. One scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, f"{name} double",
                     lambda: lambda texts: [score_texts(shared.value, texts)], text)
