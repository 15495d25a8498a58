import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("state")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """Even documents use only a and b, odd ones only c and d."""
    rows = [(d, w, 4 + (d + i) % 3) for d in range(16)
            for i, w in enumerate("ab" if d % 2 == 0 else "cd")]
    return spark.createDataFrame(rows, "doc_id long, term string, n long").cache()
