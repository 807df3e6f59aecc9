import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lapsewise.session import apply_defaults
    spark = (SparkSession.builder.master("local[4]").appName("lapsewise-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    apply_defaults(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lapsewise-test-ckpt-"))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


SMOKE = "/root/testdata/sf0.001"
