import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, ids=None):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS)

    return docs


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest generated table, with odd ones added."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    texts = pq.read_table(path).column("text").to_pylist() if os.path.exists(path) else ["some words of a text " * 20] * 3
    return [*texts, None, "", " ", "one", "a b", "x " * 3000, texts[0], texts[0] + " tail", "é ☃ " * 30]
