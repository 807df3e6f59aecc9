"""Language identification by hierarchical discrimination.

A linear support vector machine (one against the rest) predicts the language
family; inside the family, one-versus-one linear support vector machines
separate the closely related languages. Inputs are hashed byte n-grams of the
whole lower-cased text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import _LOWER, _SPACE, has_letter, map_texts

#: Width of the hashed n-gram histogram.
BUCKETS = 2048
#: Bounds of the training sample: rows in all (but one of every language), rows of a language.
SAMPLE_ROWS, ROWS_PER_LANG = 8000, 800

# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"own:{lang}")


def features(texts: list[bytes]) -> np.ndarray:
    """Unit-length square-root histogram of hashed byte 1- and 3-grams, one row a text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        b = _LOWER[np.frombuffer(t, np.uint8)]
        b = np.where(_SPACE[b], np.uint8(32), b).astype(np.uint32)
        grams = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
                 + b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else b[:0]
        count = np.bincount((grams ^ (grams >> np.uint32(15))) % np.uint32(BUCKETS - 256),
                            minlength=BUCKETS)
        count[BUCKETS - 256:] += np.bincount(b, minlength=256)
        out[i] = np.sqrt(count)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear SVM; y is +1 or -1.

    Classes weigh alike; accelerated full-batch gradient steps, so the order
    of the rows is of no account.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 0.2
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = penalty * v - 2 * x.T @ (weight * slack * y)
        after = v - rate * grad
        v = after + (k / (k + 3)) * (after - w)
        w = after
    return w


@dataclass(frozen=True)
class Model:
    families: list[str]
    family_weights: np.ndarray
    langs: dict[str, list[str]]
    pair_weights: dict[tuple[str, str], np.ndarray]


def train(x: np.ndarray, lang: list[str]) -> Model:
    """The family machines, then one machine for each pair of languages of a family."""
    lang = np.array(lang, object)
    family = np.array([family_of(v) for v in lang], object)
    families = sorted(set(family))
    family_weights = np.array([train_svm(x, np.where(family == f, 1, -1).astype(np.float32))
                               for f in families]) if len(families) > 1 else np.zeros(
                                   (len(families), BUCKETS + 1), np.float32)
    langs = {f: sorted(set(lang[family == f])) for f in families}
    pairs = {}
    for f in families:
        for a, b in combinations(langs[f], 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return Model(families, family_weights, langs, pairs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(x, -20, 20)))


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """(language, score): ``und`` with score 0 for texts without a letter, or for an empty model.

    The family has the largest margin; in it, the language with the largest
    sum of pair probabilities (ties: the first by name). The score is the
    family's share of the margins' softmax times the mean pair probability.
    """
    said, score = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
    if not rows:
        return said, score
    x = features([texts[i] for i in rows])
    margin = x @ model.family_weights[:, :-1].T + model.family_weights[:, -1]
    share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
    share = share / share.sum(1, keepdims=True)
    best = margin.argmax(1)
    for k, f in enumerate(model.families):
        own = np.flatnonzero(best == k)
        if not len(own):
            continue
        langs = model.langs[f]
        votes = np.zeros((len(own), len(langs)))
        for (a, b), w in model.pair_weights.items():
            if a in langs:
                p = _sigmoid(x[own] @ w[:-1] + w[-1])
                votes[:, langs.index(a)] += p
                votes[:, langs.index(b)] += 1 - p
        votes = votes / (len(langs) - 1) if len(langs) > 1 else votes + 1
        for j, i in enumerate(own):
            at = int(votes[j].argmax())
            said[rows[i]], score[rows[i]] = langs[at], float(share[i, k] * votes[j, at])
    return said, score


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """A model from a bounded sample of the rows where ``learn`` holds and ``lang`` is not null.

    The sample is stratified by language: distinct texts are drawn by their
    hash at the rate that gives ROWS_PER_LANG rows of a language (fewer when
    there are many languages, one at least), the first by hash of them are
    taken. So copies of a text count once, no language crowds out another, and
    the sample does not hang on the order of tasks. Only histograms reach the
    driver.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = (rows.groupBy(F.col(lang).alias("lang")).agg(F.approx_count_distinct(F.xxhash64(text)).alias("n"))
              .orderBy("lang").collect())      # distinct texts, to a few per cent
    if not counts:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), {}, {})
    each = max(1, min(ROWS_PER_LANG, SAMPLE_ROWS // len(counts)))
    # twice the rate and some more, so that enough texts are left to take the first of
    rates = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, (2 * each + 20) / max(1, r["n"]))) for r in counts], "of string, rate double")
    drawn = (rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
             .join(F.broadcast(rates), F.col("lang") == F.col("of"))       # a row a language
             .where(F.pmod("h", F.lit(1_000_003)) < F.col("rate") * 1_000_003)
             .groupBy("lang", "h").agg(F.min("text").alias("text")))
    first = Window.partitionBy("lang").orderBy("h")
    picked = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each)
    shown = map_texts(picked, ["lang"], "x binary", lambda: lambda texts: [
        [r.astype(np.float16).tobytes() for r in features(texts)]]).collect()
    shown.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in shown], np.float32).reshape(-1, BUCKETS)
    return train(x, [r["lang"] for r in shown])


def identify(docs: DataFrame, model: Model, keep: list[str],
             names: tuple[str, str] = ("lang_pred", "score"), text: str = "text") -> DataFrame:
    """The columns ``keep`` plus the language and the score (0 to 1) of every whole text.

    A null text, and one without a letter, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, f"{names[0]} string, {names[1]} double",
                     lambda: lambda texts: list(predict(shared.value, texts)), text)
