import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, size int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with two extra columns that clash with names the operators use inside."""

    def make(rows, sources=None):
        sources = sources or ["a"] * len(rows)
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 3) for (i, t), s in zip(rows, sources)], DOCS).repartition(3)

    return make
