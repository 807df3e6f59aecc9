"""Themes found in the reviews (X-5): communities of terms that stand near each other.

1. Vocabulary: terms of at least three letters that a small but not too small
   share of the reviews has; the shares bound its size whatever the input.
2. Co-occurrence graph: in how many reviews two terms stand within a few words
   of each other, against what their numbers of such places would give by
   chance (m_a·m_b / T). An edge weighs the surplus; a term keeps its
   strongest edges.
3. Label propagation, a fixed number of rounds: every term takes the label its
   neighbours give most weight to (its own counts as much as its strongest
   edge; of equal ones the first by text).
4. A community of some terms is a theme, named by its weightiest terms. A review
   has a theme if it has two of its terms; the themes of most reviews come with
   their share and the review that says most of it.

Pairs are linear in the length of a text (a window, never all pairs) and are made
of vocabulary terms only, as numbers, counted where the reviews are; weights are whole numbers, so no result hangs on the
order of a sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.operators.joins import with_scalars
from lapsewise.operators.text import tokens
from lapsewise.session import materialize

#: A term is in at least this share of the reviews (and this many), at most in that one.
LEAST_SHARE, LEAST_REVIEWS, MOST_SHARE = 0.002, 5, 0.25
#: Letters of a term, at least; words that count as near; reviews of an edge, at least.
LETTERS, NEAR, LEAST_PAIR = 3, 4, 3
#: Edges of a term, rounds of propagation, terms of a theme (at least) and of its name, hits of a review.
EDGES, ROUNDS, LEAST_TERMS, NAMED_BY, HITS = 8, 6, 3, 3, 2
#: Words that a task pairs at a time.
PIECE = 1 << 20


def vocabulary(reviews: DataFrame) -> DataFrame:
    """(term, n): terms by the number of reviews that have them. ``reviews`` has ``w``, its words."""
    total = reviews.agg(F.count("w").alias("n_reviews"))
    counts = (reviews.select(F.explode(F.array_distinct("w")).alias("term"))
              .groupBy("term").agg(F.count("term").alias("n")))
    return (with_scalars(counts, total)
            .where((F.col("n") >= LEAST_REVIEWS) & (F.col("n") >= LEAST_SHARE * F.col("n_reviews"))
                   & (F.col("n") <= MOST_SHARE * F.col("n_reviews")))
            .select("term", "n"))


def near_pairs(reviews: DataFrame, terms: list[str]) -> DataFrame:
    """(p, c): partial counts of the reviews in which two different terms stand at most NEAR places apart.

    p = i·n + k for the terms i < k of the n ``terms``, and n² + i for all pairs of the term i. A
    review counts once for a pair; other words keep their places but make no pair.
    """
    shared = reviews.sparkSession.sparkContext.broadcast(terms)
    n = len(terms)

    def count(words: pa.Array) -> pa.RecordBatch:
        flat = words.flatten()
        known = pa.array(shared.value, flat.type)
        term = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        review = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        found = []
        for d in range(1, NEAR + 1):
            a, b = term[:-d], term[d:]
            near = (a >= 0) & (b >= 0) & (a != b) & (review[:-d] == review[d:])
            a, b = a[near], b[near]
            found.append((review[:-d][near] * n + np.minimum(a, b)) * n + np.maximum(a, b))
        found = np.sort(np.concatenate(found))
        once = found[np.diff(found, prepend=-1) != 0]                   # a pair of a review
        p, c = np.unique(once % (n * n), return_counts=True)
        sums = (np.bincount(p // n, c, n) + np.bincount(p % n, c, n)).astype(np.int64)
        of = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p, n * n + of])),
                                           pa.array(np.concatenate([c, sums[of]]))], ["p", "c"])

    def run(batches):
        for batch in batches:
            words = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(words):              # so many reviews at a time that their words are about PIECE
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                yield count(words.slice(at, to - at))
                at = to

    return reviews.select("w").mapInArrow(run, "p long, c long")


def term_graph(reviews: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, dst, weight): the strongest edges of each term, by surplus over chance in thousandths."""
    known = sorted(r["term"] for r in terms.select("term").collect())      # bounded by the shares
    n = len(known)
    if not known:
        return reviews.sparkSession.createDataFrame([], "src string, dst string, weight long")
    p = F.col("p")
    # the rare pairs count in the sums of their terms only
    counts = materialize(near_pairs(reviews, known).groupBy("p").agg(F.sum("c").alias("c"))
                         .where((p >= n * n) | (F.col("c") >= LEAST_PAIR)))
    names = F.broadcast(reviews.sparkSession.createDataFrame(list(enumerate(known)), "id long, term string"))
    places = F.broadcast(counts.where(p >= n * n).select((p - n * n).alias("id"), F.col("c").cast("double").alias("m"))
                         .join(names, "id"))
    pairs = counts.where(p < n * n).select(((p - p % n) / n).cast("long").alias("a"), (p % n).alias("b"), "c")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    weighed = with_scalars(
        both.join(places.select(F.col("id").alias("a"), F.col("term").alias("src"), "m"), "a")
        .join(places.select(F.col("id").alias("b"), F.col("term").alias("dst"), F.col("m").alias("m_dst")), "b"),
        counts.where(p >= n * n).agg(F.sum("c").cast("double").alias("t")))
    weight = F.floor((F.col("c") - F.col("m") * F.col("m_dst") / F.col("t")) * 1000)
    strongest = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")     # bounded by the vocabulary
    return (weighed.select("src", "dst", weight.cast("long").alias("weight")).where(F.col("weight") > 0)
            .withColumn("place", F.row_number().over(strongest))
            .where(F.col("place") <= EDGES).drop("place"))


def communities(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(term, label) after ``rounds`` rounds of label propagation."""
    own = materialize(graph.groupBy(F.col("src").alias("term")).agg(F.max("weight").alias("own")))
    labels = own.select("term", F.col("term").alias("label"))
    for _ in range(rounds):
        said = graph.join(labels.withColumnRenamed("term", "dst"), "dst").select(
            F.col("src").alias("term"), "label", "weight")
        kept = labels.join(own, "term").select("term", "label", F.col("own").alias("weight"))
        votes = said.unionByName(kept).groupBy("term", "label").agg(F.sum("weight").alias("v"))
        labels = materialize(votes.groupBy("term").agg(
            F.min_by("label", F.struct(-F.col("v"), F.col("label"))).alias("label")))
    return labels


def theme_terms(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(theme, term): the communities of at least LEAST_TERMS terms under their names."""
    ends = labels.select(F.col("term").alias("dst"), F.col("label").alias("to"))
    inside = (graph.join(labels.withColumnRenamed("term", "src"), "src").join(ends, "dst")
              .groupBy(F.col("src").alias("term"), "label")
              .agg(F.sum(F.when(F.col("label") == F.col("to"), F.col("weight")).otherwise(0)).alias("weight")))
    by_weight = Window.partitionBy("label").orderBy(F.col("weight").desc(), "term")  # bounded by the vocabulary
    ranked = inside.withColumn("place", F.row_number().over(by_weight))
    names = (ranked.groupBy("label").agg(
        F.count("term").alias("n_terms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= NAMED_BY, F.struct(
            "place", "term")))), lambda x: x["term"]), ", ").alias("theme"))
        .where(F.col("n_terms") >= LEAST_TERMS))
    return ranked.join(names, "label").select("theme", "n_terms", "term")


def find_themes(df: DataFrame, key: str = "review_id", text: str = "review_comment_message",
                top_k: int = 5) -> DataFrame:
    """X-5: the ``top_k`` themes of most reviews, each with its share and a representative review.

    theme (its weightiest terms), n_terms, reviews_with_theme, representative_id
    (most terms of the theme, then least key), representative_hits, share,
    representative_quote. Null texts count as reviews without words; with too
    few reviews for a vocabulary there are no themes. Only keys and terms are
    aggregated; the quotes are fetched for one review a theme.
    """
    words = F.filter(tokens(text), lambda t: F.length(t) >= LETTERS)
    # written as one text: an array of strings takes several times its room
    written = materialize(df.select(F.col(key).alias("key"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("w")))
    none = F.array().cast("array<string>")
    reviews = written.select("key", F.when(F.col("w") != "", F.split("w", " ")).otherwise(none).alias("w"))
    terms = materialize(vocabulary(reviews))
    graph = materialize(term_graph(reviews, terms))
    of_theme = materialize(theme_terms(graph, communities(graph)))
    hits = (reviews.select("key", F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(of_theme), "term")
            .groupBy("theme", "n_terms", "key").agg(F.count("term").alias("hits"))
            .where(F.col("hits") >= HITS))
    per_theme = hits.groupBy("theme", "n_terms").agg(
        F.count("key").alias("reviews_with_theme"),
        F.min_by("key", F.struct(-F.col("hits"), F.col("key"))).alias("representative_id"),
        F.max("hits").alias("representative_hits"))
    best = materialize(with_scalars(
        per_theme.orderBy(F.col("reviews_with_theme").desc(), "theme").limit(top_k),
        reviews.agg(F.count("w").alias("reviews"))))
    # top_k keys, as values: only these reviews' texts are read again
    chosen = [r["representative_id"] for r in best.select("representative_id").collect()]
    quotes = (df.where(F.col(key).isin(chosen))
              .groupBy(F.col(key).alias("__id")).agg(F.min(text).alias("representative_quote")))
    return (best.withColumn("share", F.col("reviews_with_theme") / F.col("reviews"))
            .join(quotes, F.col("representative_id") == F.col("__id"), "left")
            .drop("reviews", "__id"))
