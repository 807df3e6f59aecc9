"""Review-text operators (X-1 … X-4, P-4 … P-8, T-6, J-9, J-10).

Sentiment (X-1) is a lexicon model evaluated entirely inside one projection:
the whole text is tokenised with ``regexp_extract_all``, the places of lexicon
tokens kept by a hash set, those few looked up in a map literal (the lexicon),
modifiers read from the one or two previous tokens, and the matched scores
summed in one ``aggregate`` pass. No Python
UDF, no explode, no shuffle: a document's cost is linear in its length and the
job is embarrassingly parallel across rows.

Scoring rule (for every lexicon token of a text):
  mult   = intensity of the previous token if it is an intensifier, else 1
  flip   = -0.5 if one of the two previous tokens is a negation, else 1
  p      = clamp(polarity · mult · flip, -1, 1);  s = clamp(subjectivity · mult, 0, 1)
  text polarity / subjectivity = mean p / mean s over its lexicon tokens;
  0.0 when the text is NULL, blank or has no lexicon token.

The reference delegates this to a third-party English lexicon that is not in
its repository, so scores cannot match it numerically; the contract kept is
the one its tests pin: ranges, types, and (0, 0) for missing/blank text.

A lexicon learnt from the reviews' scores is in ``lexicon``, the themes of the
reviews (X-5) in ``themes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.exprs import hash_key, is_true, non_blank

TOKEN_PATTERN = r"[\p{L}']+"

# Sentiment lexicon, word -> (polarity, subjectivity).
LEXICON = {
    "good": (0.7, 0.6), "great": (0.8, 0.75), "excellent": (1.0, 1.0), "best": (1.0, 0.3),
    "perfect": (1.0, 1.0), "love": (0.5, 0.6), "happy": (0.8, 1.0), "nice": (0.6, 1.0),
    "fast": (0.2, 0.6), "quick": (0.33, 0.5), "recommend": (0.4, 0.5), "satisfied": (0.5, 1.0),
    "beautiful": (0.85, 1.0), "easy": (0.43, 0.83), "thanks": (0.2, 0.2), "ok": (0.5, 0.5),
    "bad": (-0.7, 0.67), "poor": (-0.4, 0.6), "terrible": (-1.0, 1.0), "awful": (-1.0, 1.0),
    "horrible": (-1.0, 1.0), "worst": (-1.0, 1.0), "worthless": (-0.8, 0.9),
    "stupid": (-0.8, 1.0), "idiot": (-0.8, 1.0), "disgusting": (-1.0, 1.0),
    "broken": (-0.4, 0.4), "damaged": (-0.5, 0.5), "late": (-0.3, 0.6), "slow": (-0.3, 0.4),
    "wrong": (-0.5, 0.9), "never": (-0.1, 0.3), "missing": (-0.2, 0.05), "angry": (-0.5, 1.0),
    "disappointed": (-0.75, 0.75), "useless": (-0.5, 0.2), "cheap": (0.1, 0.2),
    "bom": (0.7, 0.6), "boa": (0.7, 0.6), "otimo": (0.8, 0.75), "ótimo": (0.8, 0.75),
    "excelente": (1.0, 1.0), "perfeito": (1.0, 1.0), "recomendo": (0.4, 0.5),
    "ruim": (-0.7, 0.67), "péssimo": (-1.0, 1.0), "pessimo": (-1.0, 1.0),
    "horrível": (-1.0, 1.0), "atrasado": (-0.3, 0.6), "quebrado": (-0.4, 0.4),
    "bueno": (0.7, 0.6), "malo": (-0.7, 0.67), "bien": (0.5, 0.5), "mal": (-0.5, 0.6),
    "bon": (0.7, 0.6), "mauvais": (-0.7, 0.67), "gut": (0.7, 0.6), "schlecht": (-0.7, 0.67),
}

# Intensifiers (multiplier applied to the next lexicon token).
INTENSIFIERS = {
    "very": 1.3, "really": 1.3, "extremely": 1.5, "so": 1.2, "too": 1.2, "quite": 1.1,
    "muito": 1.3, "muy": 1.3, "très": 1.3, "sehr": 1.3,
}

# Negations (flip the sign of a lexicon token one or two places later).
NEGATIONS = ("not", "no", "never", "don't", "isn't", "wasn't", "não", "nao", "nunca",
             "nem", "pas", "nicht", "kein", "keine")


def tokens(text) -> Column:
    """Lower-cased word tokens of the whole text (letters and apostrophes)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def _map(d: dict, value) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), value(v))])


def score_tokens(toks: Column) -> Column:
    """X-1 on a token array: ``struct(polarity, subjectivity)`` (see module docstring).

    The places of lexicon tokens are found first (``isin`` is a hash set, a map literal
    is searched key by key); only there are the token and the two before it looked up.
    Most tokens are none, so no array of neighbours is made for them. The one-element
    ``transform`` binds the tokens: an expression read inside a lambda would be
    tokenised again for every element. The cost is linear in the length of the text.
    """
    lex = _map(LEXICON, lambda v: F.struct(F.lit(float(v[0])).alias("p"),
                                           F.lit(float(v[1])).alias("s")))
    inten = _map(INTENSIFIERS, lambda v: F.lit(float(v)))
    negs = F.array(*[F.lit(w) for w in NEGATIONS])

    def step(t, acc, i):
        e = F.try_element_at(lex, F.get(t, i))
        p1, p2 = F.get(t, i - 1), F.get(t, i - 2)        # NULL before the first token
        mult = F.coalesce(F.when(p1.isNotNull(), F.try_element_at(inten, p1)), F.lit(1.0))
        neg = is_true(F.array_contains(negs, p1)) | is_true(F.array_contains(negs, p2))
        p = F.greatest(F.least(e["p"] * mult * F.when(neg, F.lit(-0.5)).otherwise(F.lit(1.0)),
                               F.lit(1.0)), F.lit(-1.0))
        s = F.greatest(F.least(e["s"] * mult, F.lit(1.0)), F.lit(0.0))
        return F.struct((acc["sp"] + p).alias("sp"), (acc["ss"] + s).alias("ss"), (acc["n"] + 1).alias("n"))

    def finish(acc):
        return F.struct(F.when(acc["n"] > 0, acc["sp"] / acc["n"]).otherwise(F.lit(0.0))
                        .alias("polarity"),
                        F.when(acc["n"] > 0, acc["ss"] / acc["n"]).otherwise(F.lit(0.0))
                        .alias("subjectivity"))

    start = F.struct(F.lit(0.0).alias("sp"), F.lit(0.0).alias("ss"), F.lit(0).alias("n"))

    def scored(t):
        places = F.filter(F.transform(t, lambda x, i: F.when(is_true(x.isin(list(LEXICON))), i)),
                          lambda i: i.isNotNull())
        return F.aggregate(places, start, lambda acc, i: step(t, acc, i), finish)

    return F.transform(F.array(toks), scored)[0]


def sentiment_struct(text) -> Column:
    """X-1: ``struct(polarity, subjectivity)`` of a text."""
    return score_tokens(tokens(text))


def add_sentiment_features(df: DataFrame, text: str = "review_comment_message") -> DataFrame:
    """X-2: has_review_text, sentiment_polarity, sentiment_subjectivity (row count unchanged).

    Only non-blank texts are scored (the CASE short-circuits), others get 0.0.
    """
    has = non_blank(text)
    return (df.withColumn("has_review_text", has)
            .withColumn("__toks", F.when(F.col("has_review_text"), tokens(text)))
            .withColumn("__sent", F.when(F.col("has_review_text"), score_tokens(F.col("__toks"))))
            .withColumn("sentiment_polarity", F.coalesce(F.col("__sent.polarity"), F.lit(0.0)))
            .withColumn("sentiment_subjectivity",
                        F.coalesce(F.col("__sent.subjectivity"), F.lit(0.0)))
            .drop("__toks", "__sent"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """T-6: ``n`` rows drawn by the md5 order of ``seed:key`` (all rows if fewer).

    Unlike ``sample``/``rand`` the draw does not depend on partitioning or
    retries; Spark plans ``orderBy().limit(n)`` as a top-n per partition.
    """
    return df.orderBy(hash_key(key, seed), F.col(key)).limit(n)


def review_pool(df: DataFrame, max_score: int = 3,
                text: str = "review_comment_message") -> DataFrame:
    """Windowed review candidates: churned ∧ score ≤ max_score ∧ non-blank text (P-4, P-7, P-8)."""
    return df.where(is_true(F.col("churned")) & is_true(F.col("review_score") <= max_score)
                    & non_blank(text))


def review_sample(df: DataFrame, n: int = 50, max_score: int = 3, seed: int = 42,
                  text: str = "review_comment_message", key: str = "order_id") -> DataFrame:
    """X-3: fixed-seed sample of n windowed review candidates."""
    return seeded_sample(review_pool(df, max_score, text), n, key, seed)


def negative_churned_reviews(orders: DataFrame, customers: DataFrame, reviews: DataFrame,
                             max_score: int = 3) -> DataFrame:
    """X-4: whole-data variant: one-order customers (row count, inner joins),
    their orders' reviews (no dedupe), non-NULL text, score ≤ max_score."""
    oc = orders.select("order_id", "customer_id").join(
        customers.select("customer_id", "customer_unique_id"), "customer_id")
    one_order = (oc.groupBy("customer_unique_id").agg(F.count("order_id").alias("n"))
                 .where(F.col("n") == 1).select("customer_unique_id"))
    churned_orders = oc.join(one_order, "customer_unique_id", "left_semi")
    r = reviews.select("review_id", "order_id", "review_score", "review_comment_message")
    return (churned_orders.select("order_id", "customer_unique_id").join(r, "order_id")
            .where(F.col("review_comment_message").isNotNull()
                   & is_true(F.col("review_score") <= max_score)))


def review_candidates(mode: str, labelled: DataFrame | None = None,
                      tables: dict[str, DataFrame] | None = None,
                      max_score: int = 3) -> DataFrame:
    """Negative reviews of churned customers, in either of the two definitions.

    ``mode='window'``: the labelled, windowed frame (distinct-order label,
    latest review per order, non-blank text). ``mode='all'``: the whole data
    (row-count label over all orders, every review, non-NULL text).
    """
    if mode == "window":
        return review_pool(labelled, max_score)
    if mode == "all":
        return negative_churned_reviews(tables["orders"], tables["customers"],
                                        tables["order_reviews"], max_score)
    raise ValueError("mode must be 'window' or 'all'")
