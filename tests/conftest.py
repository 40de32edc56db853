import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from listforge.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one text."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        row = df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()[0]
        return row.asDict() if hasattr(row, "asDict") else row

    return run
