"""A sentiment lexicon learnt from scored reviews (X-1, X-2).

For each term its log odds of standing in a good review (score ≥ 4) rather
than a bad one (score ≤ 2) are estimated with an informative prior: every term
starts with PRIOR occurrences dealt in proportion to its share of all
occurrences, so a rare term says little. With the estimate's variance

  z² = δ² / var,   shrunk = δ · (1 − 1 / z²),
  polarity = shrunk / (1 + |shrunk|) in (−1, 1),
  subjectivity = 1 − Z² / z² in (0, 1), for terms with |z| > Z only.

The lexicon is a table; texts are scored by joining their tokens with it. A
token within SCOPE places behind a negation counts with half its polarity, turned
round. A text's scores are the means over its lexicon tokens, (0, 0) if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.exprs import is_true, non_blank
from lapsewise.operators.joins import with_scalars
from lapsewise.operators.text import NEGATIONS, tokens

#: Prior occurrences, least reviews of a term, least |z|, letters of a term, places a negation reaches.
PRIOR, LEAST_REVIEWS, Z, LETTERS, SCOPE = 500.0, 5, 1.96, 2, 3
GOOD_FROM, BAD_TO = 4, 2


def fit_lexicon(reviews: DataFrame, text: str = "review_comment_message", score: str = "review_score") -> DataFrame:
    """(term, n_good, n_bad, polarity, subjectivity) from the rows' texts and scores.

    Rows without text or score, and middling scores, teach nothing. A review
    counts once for a term. Counting combines map-side; the result is bounded
    by the vocabulary.
    """
    good = F.col(score) >= GOOD_FROM
    told = reviews.where(good | (F.col(score) <= BAD_TO)).where(F.col(text).isNotNull())
    counts = (told.select(good.alias("good"), F.explode(F.array_distinct(
        F.filter(tokens(text), lambda t: F.length(t) >= LETTERS))).alias("term"))
        .groupBy("term").agg(F.count(F.when(F.col("good"), 1)).alias("n_good"),
                             F.count(F.when(~F.col("good"), 1)).alias("n_bad")))
    sums = counts.agg(F.sum("n_good").cast("double").alias("all_good"), F.sum("n_bad").cast("double").alias("all_bad"))
    g, b = F.col("n_good"), F.col("n_bad")
    prior = F.lit(PRIOR) * (g + b) / (F.col("all_good") + F.col("all_bad"))

    def odds(n: Column, total: str) -> Column:
        return F.log((n + F.col("prior")) / (F.col(total) + PRIOR + 1.0 - n - F.col("prior")))

    rated = (with_scalars(counts, sums).withColumn("prior", prior)
             .withColumn("delta", odds(g, "all_good") - odds(b, "all_bad"))
             .withColumn("var", 1.0 / (g + F.col("prior")) + 1.0 / (b + F.col("prior")))
             .where((g + b >= LEAST_REVIEWS) & (F.col("delta") * F.col("delta") > Z * Z * F.col("var"))))
    unsure = F.col("var") / (F.col("delta") * F.col("delta"))
    shrunk = F.col("delta") * (1.0 - unsure)
    return rated.select("term", "n_good", "n_bad", (shrunk / (1.0 + F.abs(shrunk))).alias("polarity"),
                        (1.0 - Z * Z * unsure).alias("subjectivity"))


def scoped_tokens(toks: Column) -> Column:
    """Array of (term, negated): whether one of the SCOPE tokens before is a negation."""
    n = F.size(toks)

    def before(d: int) -> Column:
        return F.concat(F.array_repeat(F.lit(None).cast("string"), d),
                        F.slice(toks, F.lit(1), F.greatest(n - d, F.lit(0))))

    zipped = F.arrays_zip(toks.alias("t"), *[before(d).alias(f"p{d}") for d in range(1, SCOPE + 1)])

    def negated(x: Column) -> Column:
        out = F.lit(False)
        for d in range(1, SCOPE + 1):
            out = out | is_true(x[f"p{d}"].isin(list(NEGATIONS)))
        return out

    # a text shorter than the scope leaves places without a token
    return F.filter(F.transform(zipped, lambda x: F.struct(x["t"].alias("term"), negated(x).alias("negated"))),
                    lambda x: x["term"].isNotNull())


def learnt_sentiment(df: DataFrame, lexicon: DataFrame, key: str = "order_id",
                     text: str = "review_comment_message") -> DataFrame:
    """X-2: ``df`` plus has_review_text, sentiment_polarity, sentiment_subjectivity (row count unchanged).

    ``key`` names a row. The lexicon, bounded by the vocabulary, goes to the
    tokens, which are not exchanged. Null and blank texts, and texts without a lexicon
    token, score (0, 0).
    """
    found = (df.where(non_blank(text)).select(F.col(key).alias("__key"), tokens(text).alias("w"))
             .select("__key", F.explode(scoped_tokens(F.col("w"))).alias("t"))
             .select("__key", "t.term", "t.negated")
             .join(F.broadcast(lexicon.select("term", "polarity", "subjectivity")), "term"))
    turned = F.col("polarity") * F.when(F.col("negated"), F.lit(-0.5)).otherwise(F.lit(1.0))
    means = found.groupBy("__key").agg(F.avg(turned).alias("__p"), F.avg("subjectivity").alias("__s"))
    return (df.join(means, F.col(key) == F.col("__key"), "left")
            .withColumn("has_review_text", non_blank(text))
            .withColumn("sentiment_polarity", F.coalesce("__p", F.lit(0.0)))
            .withColumn("sentiment_subjectivity", F.coalesce("__s", F.lit(0.0)))
            .drop("__key", "__p", "__s"))


def agreement(scored: DataFrame, score: str = "review_score", polarity: str = "sentiment_polarity") -> DataFrame:
    """One row: how far the sign of the polarity follows the score of good and bad reviews.

    n_good, n_bad (with text), their mean polarity, n_signed (polarity not 0),
    agreeing (sign as the score has it) and agreement, its share of the signed.
    """
    p = F.round(F.col(polarity), 9)
    good, bad = F.col(score) >= GOOD_FROM, F.col(score) <= BAD_TO
    told = scored.where((good | bad) & F.col("has_review_text"))
    return told.agg(
        F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_bad"),
        F.avg(F.when(good, F.col(polarity))).alias("mean_good"), F.avg(F.when(bad, F.col(polarity))).alias("mean_bad"),
        F.count(F.when(p != 0, 1)).alias("n_signed"),
        F.count(F.when((good & (p > 0)) | (bad & (p < 0)), 1)).alias("agreeing")) \
        .withColumn("agreement", F.when(F.col("n_signed") > 0, F.col("agreeing") / F.col("n_signed")))
