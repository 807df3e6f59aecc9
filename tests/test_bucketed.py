"""The master join over co-bucketed sides: same rows, no exchange by order_id."""

import uuid

from lapsewise.operators.orders import join_tables
from lapsewise.plans.bucketed import forget_sides, stored_master, write_sides
from lapsewise.plans.pipeline import present
from lapsewise.sources.driver import PAYMENT_ORDER, model_tables

SMOKE = "/root/testdata/sf0.001"


def test_stored_master_joins_without_an_exchange(spark, tmp_path):
    tables, name = model_tables(spark, SMOKE), f"m{uuid.uuid4().hex}"
    write_sides(tables, name, str(tmp_path / "sides"), 4, PAYMENT_ORDER)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = stored_master(spark, name)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = sorted(map(str, present(stored).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = present(join_tables(tables, payment_order=PAYMENT_ORDER))
    assert stored.columns == want.columns and got == sorted(map(str, want.collect()))
    forget_sides(spark, name)
    assert not spark.catalog.tableExists(f"{name}_spine")
