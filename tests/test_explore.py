"""Exploratory aggregates against NumPy / pandas on the same values."""
import random

import numpy as np
import pandas as pd
import pytest

from lapsewise.operators import explore as X


def _frame(spark, n=800, seed=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.random() < 0.7, round(rnd.lognormvariate(4, 1), 2) if i % 9 else None)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "order_id int, churned boolean, payment_value double")


def test_histogram_matches_numpy_density(spark):
    rows, df = _frame(spark)
    got = X.histogram(X.with_segment(df), "payment_value", bins=60).collect()
    for seg, flag in (("Churned", True), ("Retained", False)):
        vals = np.array([v for _, c, v in rows if c == flag and v is not None])
        dens, edges = np.histogram(vals, bins=60, density=True)
        counts, _ = np.histogram(vals, bins=60)
        mine = {r["bin"]: r for r in got if r["segment"] == seg}
        for i in range(60):
            if counts[i] == 0:
                assert i not in mine
                continue
            assert mine[i]["n"] == counts[i]
            assert mine[i]["density"] == pytest.approx(dens[i], rel=1e-9)
            assert mine[i]["bin_lo"] == pytest.approx(edges[i], rel=1e-9)


def test_describe_matches_pandas(spark):
    rows, df = _frame(spark)
    pdf = pd.DataFrame(rows, columns=["order_id", "churned", "payment_value"])
    want = pdf.groupby("churned")["payment_value"].describe()
    got = {r["segment"]: r for r in X.describe_by_segment(df).collect()}
    for flag, seg in ((True, "Churned"), (False, "Retained")):
        w, g = want.loc[flag], got[seg]
        assert g["count"] == w["count"]
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert g[mine] == pytest.approx(w[theirs], rel=1e-9)


def test_punctuality_denominator_keeps_missing_delays(spark):
    df = spark.createDataFrame([("delivered", 2.0), ("delivered", -1.0), ("delivered", None),
                                ("shipped", 5.0)], "order_status string, delivery_delay_days double")
    r = X.punctuality(df).first()
    assert (r["delivered_rows"], r["rows_with_delay"], r["late_n"], r["early_n"]) == (3, 2, 1, 1)
    assert r["late_share"] + r["early_share"] < 1


def test_density_curve_has_area_one(spark):
    import math
    import random
    rng = random.Random(2)
    rows = [("a", rng.gauss(0.1, 0.3)) for _ in range(400)] + [("b", rng.uniform(-0.5, 0.5)) for _ in range(90)]
    rows += [("c", 0.2), ("d", 0.1), ("d", 0.1), ("a", None), (None, 0.3)]
    df = spark.createDataFrame(rows, "segment string, v double")
    from lapsewise.operators.explore import density_curve
    got = density_curve(df, "v").collect()
    assert {r["segment"] for r in got} == {"a", "b"}
    for g in ("a", "b"):
        vals = [v for s, v in rows if s == g and v is not None]
        curve = {r["x"]: r["density"] for r in got if r["segment"] == g}
        assert len(curve) == 513 and abs(sum(curve.values()) * 4 / 512 - 1) < 1e-6
        mean = sum(vals) / len(vals)
        h = math.sqrt(sum((v - mean) ** 2 for v in vals) / (len(vals) - 1)) * len(vals) ** -0.2
        for x in (-0.5, 0.0, 0.25):
            exact = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in vals) / (len(vals) * h * math.sqrt(2 * math.pi))
            assert abs(curve[x] - exact) < 2e-3 * max(1, exact)
    assert density_curve(df.limit(0), "v").collect() == []


def test_opportunity_by_grain_adds_up(spark):
    from lapsewise.operators.business import opportunity_by_grain
    rows = [(i, f"c{i % 40}", ["SP", "RJ", None][i % 3], ["x", "y"][i % 2], i % 4 == 0, (i * 7 % 10) / 10)
            for i in range(100)]
    df = spark.createDataFrame(rows, "order_id int, customer_unique_id string, s string, c string, l boolean, "
                                     "p_churn double").selectExpr("*", "cast(l as int) label")
    cut = spark.createDataFrame([(0.5,)], "threshold double")
    got = {(r["grain"], r["level"]): r for r in opportunity_by_grain(df, cut, {"state": "s", "category": "c"}).collect()}
    assert set(got) == {("all", None), ("state", "SP"), ("state", "RJ"), ("state", None), ("category", "x"),
                        ("category", "y")}
    every = got["all", None]
    for grain in ("state", "category"):
        for c in ("actual_retained", "retained_tp", "retained_fn", "scored_rows", "flagged_retained"):
            assert sum(r[c] for k, r in got.items() if k[0] == grain) == every[c]
    assert every["scored_rows"] == 100 and every["customers"] == 40
    assert every["retained_tp"] == sum(1 for r in rows if not r[4] and r[5] < 0.5)
    assert opportunity_by_grain(df.limit(0), cut, {"state": "s"}).collect() == []
