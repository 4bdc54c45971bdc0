import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    """Rows (doc_id, text) or (doc_id, text, lang, source) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]))
            for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents table with awkward rows added."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = d.orderBy("doc_id").limit(3)
    odd = make(spark, [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "one two"), (905, "Ünï çödé 漢字 " * 40),
                       (906, "word " * 30_000), (907, "a\x00b " * 60), (None, "no id at all here, but seven words"),
                       (908, "x" * 70_000), (909, None, None, None)])
    again = first.withColumn("doc_id", F.col("doc_id") + 5000)
    return d.union(odd).union(again).union(first.limit(1)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
