"""HTML extraction: the main text of whole pages by the recurrent block labeller.

Defined results: null or empty html, and pages without main text, give the empty string and n_chars 0; character
references are decoded; white space inside a block becomes one space; blocks are joined in page order by one space; cut
off, unclosed and misnested markup is read as far as it goes; repeated rows come back once each; a null page_id or url
stays null; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.block_lstm import Labeller
from quarry.llm.htmlblocks import blocks
from quarry.llm.layouts import training_pages

TRAINING_PAGES, ROUNDS = 1200, 9
#: Characters of html that are read before a batch of pages is labelled.
AT_ONCE = 2 << 20


@cache
def trained() -> Labeller:
    """The labeller, trained once per process from a fixed seed."""
    model = Labeller()
    model.train(*training_pages(TRAINING_PAGES), rounds=ROUNDS)
    return model


def labelled(model: Labeller, pages: list[str | None]) -> list[list[tuple[str, float]]]:
    """(text, margin) of every block of every page."""
    own = [blocks(p) for p in pages]
    return [[(b.text, float(z)) for b, z in zip(p, margins, strict=True)] for p, margins in zip(own, model.margins(own), strict=True)]


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    return [" ".join(text for text, margin in page if margin > 0) for page in labelled(model, pages)]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            column, texts, wait, size = batch.column("html"), [], [], 0
            for value in column:
                page = value.as_py()
                wait.append(page)
                size += len(page or "")
                if size > AT_ONCE:
                    texts += main_texts(shared.value, wait)
                    wait, size = [], 0
            texts += main_texts(shared.value, wait)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
