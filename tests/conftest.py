import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def documents(spark):
    """A maker of document tables with columns whose names clash with helpers."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, `key` string, row string, n_lines string, node string, toxic_score string, marks string, words string"
        return spark.createDataFrame([(i, t, None, s, None, None, "k", None, "x", None, None, None, None) for i, t, s in rows], schema)

    return make
