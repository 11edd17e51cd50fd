"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: A word: a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a task reads, and a Python task gets and unfolds, at once.
TEXTS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the plan runs once, survives
    lost executors, and the written size lets the planner choose broadcast joins by measured size."""
    return materialize(df, f"llm-{name}")


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside read ``TEXTS`` rows at once and send so many to Python: whole texts and their features are large rows,
    and a column of thousands of them is an array of many MB, for which the heap grows and is not given back."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {name: spark.conf.get(name) for name in names}
    for name, rows in before.items():
        spark.conf.set(name, min(TEXTS, int(rows)) if int(rows) > 0 else TEXTS)
    try:
        yield
    finally:
        for name, rows in before.items():
            spark.conf.set(name, rows)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns ``needed`` beside a struct ``_doc`` of all input columns, so that no input column
    can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       *[F.col(f"`{c}`").alias(c) for c in needed])


def unpacked(df: DataFrame, columns: list[str], *extra) -> DataFrame:
    """The packed input columns again, then ``extra`` columns; an extra column replaces an input
    column of its name."""
    names = df.select(*extra).columns if extra else []
    return df.select(*[F.col("_doc").getField(c).alias(c) for c in columns if c not in names], *extra)
