import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from pairgrammar.session import build_session
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.driver.memory", "8g")
    session = build_session("tests", "local[*]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
