"""Main texts of raw web pages: a linear-chain conditional random field labels the leaf blocks of a page.

The field is trained on labelled pages (``labelled_pages``): 600 written ones and about 200 of the given pages that mark up
their own article (``WRITTEN``, ``MAX_MARKED``: the bounds of the training set). Every page is then
decoded by Viterbi as a whole; Spark deals out the pages, and a task holds one Arrow batch of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import crf
from cohortlab.llm.common import store
from cohortlab.llm.dom import FEATURES, block_features, blocks_of
from cohortlab.llm.labelled_pages import LABEL, marked, written_pages

WRITTEN = 600
MAX_MARKED = 200
PARTS = 8


def _encoded(page: str) -> dict:
    blocks = blocks_of(page, LABEL)
    return {"features": block_features(blocks), "labels": [int(e.mark == "main") for _, _, e in blocks]}


def training_sequences(pages: DataFrame, written: int = WRITTEN, most_marked: int = MAX_MARKED) -> DataFrame:
    """The blocks' features and labels of written pages and of about ``most_marked`` given ones, chosen by a hash of id and url."""
    def rows(batches, several):
        import pandas as pd

        for batch in batches:
            found = [x for page in batch["html"] if page for version in (marked(page) if several else [page]) if (x := _encoded(version))["labels"]]
            if found:
                yield pd.DataFrame({k: [x[k] for x in found] for k in ("features", "labels")})

    spark = pages.sparkSession
    own = spark.createDataFrame([(p,) for p in written_pages(written)], "html string").repartition(PARTS)
    every = max(1, pages.count() // most_marked) if most_marked else 1
    chosen = pages.select("html", F.pmod(F.xxhash64(F.col("page_id").cast("string"), "url"), F.lit(every)).alias("h")).filter("h = 0").select("html")
    found = own.mapInPandas(lambda b: rows(b, False), crf.SCHEMA)
    if most_marked:
        found = found.unionByName(chosen.mapInPandas(lambda b: rows(b, True), crf.SCHEMA))
    return store(store(found, "labelled-pages").repartition(PARTS), "labelled-blocks")


def train(pages: DataFrame, written: int = WRITTEN, most_marked: int = MAX_MARKED) -> crf.Weights:
    return crf.fit(training_sequences(pages, written, most_marked), FEATURES)


def main_text(page: str | None, weights: crf.Weights) -> str:
    """The blocks labelled as main text, joined by line feeds."""
    blocks = blocks_of(page)
    labels = crf.viterbi(crf.unary(weights.item, block_features(blocks)), weights)
    return "\n".join(text for (text, _, _), y in zip(blocks, labels) if y)


def extract_text(pages: DataFrame, weights: crf.Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every input row; ``weights`` are trained on the pages if none are given.

    Null or empty html, and html without a main text, give an empty text and 0. Ids and urls may be null or repeat, and
    repeated rows give their own rows; further columns are ignored; an empty table gives no row. Pages are read as a
    whole, however long; broken markup is read as a browser would: missing end tags are implied, and a
    tag cut off at the end of the page is no text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or train(pages))

    def rows(batches):
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.pop("html")]
            batch["text"], batch["n_chars"] = texts, [len(t) for t in texts]
            yield batch[["page_id", "url", "text", "n_chars"]].astype({"n_chars": "int64"})

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInPandas(
        rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
