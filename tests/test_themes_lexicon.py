"""Themes and the lexicon on planted words, odd rows and brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import lexicon as LX
from lapsewise.operators import themes as TH
from lapsewise.operators.text import tokens


def letters(i):
    return "".join(chr(97 + int(d)) for d in str(i))


PLANTED = {t: [f"{t}{letters(i)}" for i in range(10)] for t in ("late", "broken", "refund", "wrong", "rude")}


@pytest.fixture(scope="module")
def planted(spark):
    """Reviews of five planted vocabularies between words that say nothing."""
    rng = random.Random(11)
    noise = [f"noise{letters(i)}" for i in range(300)]
    rows = []
    for i in range(900):
        words = []
        if i % 6 < 5:
            theme = list(PLANTED)[i % 6]
            for _ in range(4):
                words += rng.sample(PLANTED[theme], 3) + rng.sample(noise, 3)
        else:
            words = rng.sample(noise, 15)
        rows.append((i, " ".join(["the", *words, "and"]), i % 5 + 1))
    rows += [(2000, None, 1), (2001, "", 2), (2002, " \n ", None), (2003, "x y", 5)]
    return spark.createDataFrame(rows, "review_id long, review_comment_message string, review_score int")


def test_planted_themes_are_found(spark, planted):
    words = F.coalesce(F.filter(tokens("review_comment_message"), lambda t: F.length(t) >= 3),
                       F.array().cast("array<string>"))
    reviews = planted.select(F.col("review_id").alias("key"), words.alias("w"))
    graph = TH.term_graph(reviews, TH.vocabulary(reviews))
    label = {r["term"]: r["label"] for r in TH.communities(graph).collect()}
    for vocabulary in PLANTED.values():
        own = [label[t] for t in vocabulary]
        most = max(set(own), key=own.count)
        assert own.count(most) >= 0.9 * len(vocabulary)
        assert all(label.get(t) != most for v in PLANTED.values() if v is not vocabulary for t in v)
    found = TH.find_themes(planted).collect()
    assert len(found) == 5
    named = {t for v in PLANTED for t in [v] if any(v in r["theme"] for r in found)}
    assert named == set(PLANTED)
    for r in found:
        theme = next(v for v in PLANTED if v in r["theme"])
        assert r["reviews_with_theme"] >= 0.9 * 150 and abs(r["share"] - r["reviews_with_theme"] / 904) < 1e-12
        assert theme in r["representative_quote"] and r["representative_hits"] >= 5


def test_themes_of_odd_rows(spark, planted):
    assert TH.find_themes(planted.limit(0)).collect() == []
    assert TH.find_themes(planted.where("review_id >= 2000")).collect() == []
    same = spark.createDataFrame([(i, "delay parcel carrier") for i in range(30)]
                                 + [(100 + i, f"other{letters(i)}") for i in range(100)],
                                 "review_id long, review_comment_message string")
    r = TH.find_themes(same.withColumn("w", F.lit(1)).withColumn("term", F.lit("x"))).collect()
    assert len(r) == 1 and r[0]["reviews_with_theme"] == 30 and r[0]["representative_id"] == 0


def scored_reviews(n, seed):
    rng = random.Random(seed)
    good, bad, plain = ([f"{w}{letters(i)}" for i in range(12)] for w in ("good", "bad", "plain"))
    rows = []
    for i in range(n):
        score = rng.randrange(1, 6)
        own = good if score >= 4 else bad if score <= 2 else plain
        words = rng.sample(plain, 8) + rng.sample(own, 2)
        if rng.random() < 0.1:
            words += [rng.choice(good + bad)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), score))
    return rows


def test_lexicon_follows_scores_and_negations(spark):
    schema = "order_id long, review_comment_message string, review_score int"
    train = spark.createDataFrame(scored_reviews(800, 1) + [(9000, None, 5), (9001, "goodb", None)], schema)
    lexicon = LX.fit_lexicon(train).collect()
    pol = {r["term"]: r["polarity"] for r in lexicon}
    assert sum(t.startswith("good") and p > 0 for t, p in pol.items()) == 12
    assert sum(t.startswith("bad") and p < 0 for t, p in pol.items()) == 12
    assert all(-1 < r["polarity"] < 1 and 0 < r["subjectivity"] < 1 for r in lexicon)
    table = spark.createDataFrame(lexicon)
    test = spark.createDataFrame(scored_reviews(400, 2), schema)
    a = LX.agreement(LX.learnt_sentiment(test, table)).first()
    assert a["agreement"] > 0.95 and a["mean_good"] > 0.1 > -0.1 > a["mean_bad"]
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "\t\n", 1), (4, "goodb", 1), (5, "not goodb", 1),
                                 (6, "not x y z goodb", 1), (7, "nothing here", 1)], schema)
    got = {r["order_id"]: r for r in LX.learnt_sentiment(odd, table).collect()}
    assert len(got) == 7
    for i in (1, 2, 3, 7):
        assert got[i]["sentiment_polarity"] == 0 and got[i]["sentiment_subjectivity"] == 0
        assert got[i]["has_review_text"] == (i == 7)
    assert math.isclose(got[4]["sentiment_polarity"], pol["goodb"])
    assert math.isclose(got[5]["sentiment_polarity"], -0.5 * pol["goodb"])
    assert math.isclose(got[6]["sentiment_polarity"], pol["goodb"])


def test_lexicon_without_reviews(spark):
    schema = "order_id long, review_comment_message string, review_score int"
    none = LX.fit_lexicon(spark.createDataFrame([], schema))
    assert none.count() == 0
    one = spark.createDataFrame([(1, "a word", 5)], schema)
    assert LX.learnt_sentiment(one, none).first()["sentiment_polarity"] == 0
    assert LX.fit_lexicon(spark.createDataFrame([(i, "word", 5) for i in range(20)], schema)).count() == 0
