"""Steps that grow with the tables run once, over the columns that they need."""

import random
import uuid
from collections import Counter

import pytest
from conftest import SMOKE
from pyspark.sql import functions as F

from lapsewise.operators import lexicon as LX
from lapsewise.operators import models as MD
from lapsewise.operators import text as TX
from lapsewise.operators import themes as TH
from lapsewise.plans.bucketed import SIDES, forget_sides, write_sides
from lapsewise.plans.queries import QUERIES
from lapsewise.sources.driver import PAYMENT_ORDER, model_tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["polarity_histogram", "polarity_density"])
def test_texts_are_scored_once_before_the_polarities_are_read(spark, name):
    assert "regexp_extract_all" not in plan(QUERIES[name](spark, SMOKE))


def test_lexicon_tokens_are_found_by_a_hash_set(spark):
    rows = [(0, "good"), (1, "x"), (2, ""), (3, None), (4, "not good great"), (5, "never very good"), (6, "GOOD, so bad")]
    df = TX.add_sentiment_features(spark.createDataFrame(rows, "id int, review_comment_message string"))
    assert " INSET " in plan(df)
    got = {r["id"]: (round(r["sentiment_polarity"], 9), round(r["sentiment_subjectivity"], 9)) for r in df.collect()}
    assert got == {0: (0.7, 0.6), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (-0.375, 0.675),
                   5: (-0.2775, 0.54),
                   6: (round((0.7 - 0.84) / 2, 9), round((0.6 + 0.804) / 2, 9))}


def test_the_frames_joins_run_once_for_the_train_medians(spark):
    assert "parquet" not in plan(QUERIES["impute_train_median"](spark, SMOKE))


def test_pairs_are_counted_of_vocabulary_terms_only_where_the_reviews_are(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefgh") * 3 for _ in range(rng.choice([0, 1, 2, 7, 40]))]) for i in range(300)] + [(900, None)]
    known = [x * 3 for x in "abcde"]
    want = Counter()
    for _, w in rows:
        w = w or []
        want.update({(a, b) for i in range(len(w)) for j in range(i + 1, min(i + 1 + TH.NEAR, len(w)))
                     for a, b in [sorted((w[i], w[j]))] if a != b and a in known and b in known})
    n = len(known)
    sums = Counter()
    for (a, b), c in want.items():
        sums[a] += c
        sums[b] += c
    reviews = spark.createDataFrame(rows, "key long, w array<string>")
    for piece in (1, 100, TH.PIECE):
        monkeypatch.setattr(TH, "PIECE", piece)
        got = {r["p"]: r["c"] for r in TH.near_pairs(reviews, known).groupBy("p").agg(F.sum("c").alias("c")).collect()}
        assert {(known[p // n], known[p % n]): c for p, c in got.items() if p < n * n} == want
        assert {known[p - n * n]: c for p, c in got.items() if p >= n * n} == sums


def test_only_held_out_reviews_are_scored_for_the_agreement(spark):
    lexicon = spark.createDataFrame([("good", 0.5, 0.5)], "term string, polarity double, subjectivity double")
    told = spark.createDataFrame([(1, "not good")], "order_id long, review_comment_message string")
    scored = LX.learnt_sentiment(told, lexicon)
    assert "strategy=broadcast" in plan(scored) and "array_contains" not in plan(scored)
    assert scored.first()["sentiment_polarity"] == -0.25
    # the learning rows do not reach the scoring: the flag is asked before the tokens are made
    p = plan(QUERIES["sentiment_agreement"](spark, SMOKE))
    assert all("held_out" in line for line in p.splitlines() if "Filter" in line and "RLIKE" in line)


def test_stored_sides_are_packed_with_zstd(spark, tmp_path):
    name = f"m{uuid.uuid4().hex}"
    write_sides(model_tables(spark, SMOKE), name, str(tmp_path), 2, PAYMENT_ORDER)
    for side in ("spine", *SIDES):
        files = list((tmp_path / side).glob("*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    forget_sides(spark, name)


def test_trees_keep_no_nodes_of_rows_between_levels(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    model = MD.train_gbt(rows, ["x"], max_iter=2, max_depth=2).stages[-1]
    assert not model.getOrDefault("cacheNodeIds")


def counted(df):
    """The rows of ``df`` and how many of them were read so far."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b
    return df.mapInPandas(count, df.schema), read


def test_split_reads_its_rows_twice_only(spark):
    from lapsewise.operators.sampling import stratified_split
    df = spark.range(0, 200, 1, 2).selectExpr("id order_id", "cast(id % 4 = 0 as int) label")
    rows, read = counted(df)
    split = stratified_split(rows).collect()
    assert sum(r["fold"] == "test" for r in split) == 40 and read.value == 400
    assert Counter(map(tuple, split)) == Counter(map(tuple, stratified_split(df).collect()))


def test_regression_makes_its_features_once(spark):
    df = spark.range(0, 100, 1, 2).selectExpr("id order_id", "cast(id % 3 = 0 as int) label", "double(id % 7) x")
    rows, read = counted(df)
    model = MD.train_logreg(rows, ["x"], max_iter=10)
    assert read.value == 200 and model.transform(df).count() == 100      # the classes' sizes, the features


def test_leaves_below_the_same_nodes_are_looked_up_once():
    from lapsewise.operators.attribution import LeafMasks
    node = lambda k, f, cut, left, right, value, cover: {
        "tree": 0, "node": k, "feature": f, "threshold": cut, "left": left, "right": right, "value": value, "cover": cover}
    masks = LeafMasks([node(0, 0, 0.5, 1, 2, 0.0, 8.0), node(1, 1, 0.5, 3, 4, 0.0, 6.0), node(2, 0, 0.7, 5, 6, 0.0, 2.0),
                       *[node(k, -1, 0.0, -1, -1, k / 7, c) for k, c in ((3, 2.0), (4, 4.0), (5, 1.0), (6, 1.0))]], 2)
    assert len(masks.lists) == 2 and len(masks.comparisons) == 3


def test_split_leaves_its_rows_where_they_are(spark, tmp_path):
    from lapsewise.operators.sampling import stratified_split
    from lapsewise.session import packed
    df = packed(spark.range(0, 200, 1, 2).selectExpr("id order_id", "cast(id % 4 = 0 as int) label", "string(id) s"))
    split = stratified_split(df)
    split.collect()
    text = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text
    assert {f.split(".")[-2] for f in df.inputFiles()} == {"zstd"}


def test_frames_of_models_are_not_kept_as_checkpoints(spark):
    from lapsewise.plans.queries import feature_matrix_train, model_inputs
    assert "zstd.parquet" in str(model_inputs(spark, SMOKE)[0].inputFiles())
    assert "zstd.parquet" in str(feature_matrix_train(spark, SMOKE).inputFiles())
