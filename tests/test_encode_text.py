"""Encoding and text contracts (reference NLP tests + fixtures)."""
import pytest
from pyspark.sql import functions as F

from lapsewise.operators.encode import group_rare, one_hot, top_levels
from lapsewise.operators.text import (
    add_sentiment_features,
    review_sample,
    sentiment_struct,
)


def test_one_hot_drop_first_and_null_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "k int, s string")
    out = one_hot(df, "s")
    assert out.columns == ["k", "s_b", "s_c"]
    rows = {r["k"]: (r["s_b"], r["s_c"]) for r in out.collect()}
    assert rows == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True)}


def test_top_levels_tie_at_cut_and_null_goes_other(spark):
    vals = ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + ["d"] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, c string")
    top = top_levels(df, "c", 2)
    assert top == ["a", "b"]  # b and c tie: the smaller level wins
    got = {r["k"]: r["g"] for r in group_rare(df, "c", top, out="g").collect()}
    assert got[0] == "a" and got[5] == "other" and got[9] == "other"


def _score(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [(r["s"]["polarity"], r["s"]["subjectivity"]) for r in
            df.select(sentiment_struct("t").alias("s")).collect()]


def test_sentiment_returns_two_floats_in_range(spark):
    for p, s in _score(spark, ["Great product, very fast!", "terrible and slow", "xyz"]):
        assert isinstance(p, float) and isinstance(s, float)
        assert -1.0 <= p <= 1.0 and 0.0 <= s <= 1.0


def test_sentiment_negation_and_intensifier(spark):
    (good,), (not_good,), (very_good,) = [[x] for x in _score(spark, ["good", "not good", "very good"])]
    assert not_good[0] < 0 < good[0] < very_good[0]


def test_missing_and_blank_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("\t\n",), ("bom produto",)], "t string")
    out = add_sentiment_features(df, "t").collect()
    assert [r["has_review_text"] for r in out] == [False, False, False, False, True]
    for r in out[:4]:
        assert (r["sentiment_polarity"], r["sentiment_subjectivity"]) == (0.0, 0.0)
    assert {"has_review_text", "sentiment_polarity", "sentiment_subjectivity"} <= set(
        add_sentiment_features(df, "t").columns)


def test_whole_text_is_scored(spark):
    long_text = " ".join(["filler"] * 20000 + ["terrible"])
    [(p, _)] = _score(spark, [long_text])
    assert p == -1.0


def test_review_sample_filters_and_is_deterministic(spark):
    rows = [(i, i % 2 == 0, 1 + i % 5, "ruim" if i % 3 else "  ") for i in range(200)]
    df = spark.createDataFrame(rows, "order_id int, churned boolean, review_score int, "
                                     "review_comment_message string")
    a = [r["order_id"] for r in review_sample(df, n=10).collect()]
    b = [r["order_id"] for r in review_sample(df.repartition(7), n=10).collect()]
    assert sorted(a) == sorted(b) and len(a) == 10
    chosen = df.where(F.col("order_id").isin(a)).collect()
    assert all(r["churned"] and r["review_score"] <= 3 and r["review_comment_message"].strip()
               for r in chosen)


def test_many_levels_become_top_and_other(spark):
    from lapsewise.operators.encode import CATEGORY, GROUPED, fit_vocabulary, one_hot_long
    df = spark.range(4500).select("id", F.concat(F.lit("c"), F.least(F.col("id") % 1500, F.lit(1499)))
                                  .alias(CATEGORY))
    vocab = fit_vocabulary(df, 15)
    assert len(vocab["__top"]) == 15 and vocab[GROUPED] == sorted(vocab["__top"] + ["other"])
    few = fit_vocabulary(df.where("id < 10"), 15)
    assert "other" not in few[GROUPED] and len(few[GROUPED]) == 10
    flags = one_hot_long(df, "id", [CATEGORY])
    assert flags.count() == 4500 - 3 and flags.where("feature like '%c0'").count() == 0


def test_review_candidates_modes(spark):
    from lapsewise.operators.text import review_candidates
    lab = spark.createDataFrame([(1, True, 2, "ruim"), (2, True, 5, "bom"), (3, False, 1, "x"),
                                 (4, True, 1, " ")],
                                "order_id int, churned boolean, review_score int, "
                                "review_comment_message string")
    assert [r["order_id"] for r in review_candidates("window", labelled=lab).collect()] == [1]
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c2"), ("o3", "c2")],
                                   "order_id string, customer_id string")
    customers = spark.createDataFrame([("c1", "u1"), ("c2", "u2")],
                                      "customer_id string, customer_unique_id string")
    reviews = spark.createDataFrame([("r1", "o1", 1, "late"), ("r2", "o1", 2, None),
                                     ("r3", "o2", 1, "bad")],
                                    "review_id string, order_id string, review_score int, "
                                    "review_comment_message string")
    got = review_candidates("all", tables={"orders": orders, "customers": customers,
                                           "order_reviews": reviews}).collect()
    assert [r["review_id"] for r in got] == ["r1"]
    with pytest.raises(ValueError):
        review_candidates("other")


def test_vocabulary_tie_at_top15_cut_and_null_category(spark):
    from lapsewise.operators.encode import GROUPED, encode_categoricals, fit_vocabulary
    rows, k = [], 0
    # c00..c13 with 30-i rows, c14 and c15 tied at 5 rows, c16 with 1 row, plus NULLs
    sizes = {f"c{i:02d}": 30 - i for i in range(14)} | {"c14": 5, "c15": 5, "c16": 1}
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((k, name, "card", "SP")); k += 1
    rows += [(k, None, "card", "RJ"), (k + 1, None, "boleto", "SP")]
    df = spark.createDataFrame(rows, "order_id int, product_category_english string, "
                                     "payment_type string, customer_state string")
    v = fit_vocabulary(df, 15)
    assert len(v["__top"]) == 15 and "c14" in v["__top"] and "c15" not in v["__top"]
    assert v[GROUPED] == sorted(v["__top"] + ["other"])
    assert v["payment_type"] == ["boleto", "card"] and v["customer_state"] == ["RJ", "SP"]
    enc = encode_categoricals(df, 15, v)
    cols = [c for c in enc.columns if c.startswith(GROUPED + "_")]
    assert len(cols) == 15 and GROUPED + "_c00" not in cols   # smallest level is the base
    nulls = enc.where("order_id >= %d" % k).collect()
    assert all(r[GROUPED + "_other"] for r in nulls)
