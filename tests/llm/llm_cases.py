"""Shared small inputs of the corpus operators' tests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names working columns might have.
CLASHING = ("key", "node", "root", "h", "size", "block", "draws", "score", "hits", "kinds", "m0", "shard", "copy", "_doc", "p", "n", "label")


def edge_docs(spark) -> DataFrame:
    """Nulls in every column, empty and blank and long texts, ties, repeated rows, and clashing extra columns."""
    long_text = " ".join(f"word{i} of a rather long text." for i in range(4000))
    rows = [(1, "a plain text of some words that stands here alone.", "en", "s1", 49), (2, None, "en", "s1", None), (None, "no id here at all, yet some words.", None, None, 3),
            (3, "", "en", "s2", 0), (4, " \n\t ", None, "s2", 4), (5, long_text, "en", "s3", len(long_text)), (6, "twin text that is told two times.", "en", "s1", 3),
            (6, "twin text that is told two times.", "en", "s1", 3), (7, "twin text that is told two times.", "fr", "s2", 3), (None, None, None, None, None), (None, None, None, None, None)]
    return with_clashes(spark.createDataFrame(rows, SCHEMA))


def with_clashes(docs: DataFrame) -> DataFrame:
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def empty_docs(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def table(spark, name: str, sf: str = SF) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
