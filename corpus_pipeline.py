"""The corpus pipeline: quality, language, near duplicates, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the
columns of documents. The mixture is an order: the last stage's rows come in it, as read and as written in part files. Empty tables pass through; extra columns stay; nulls are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id, quality
from quarry.llm.mixing import in_mix_order
from quarry.llm.ngram_join import ngram_jaccard_join
from quarry.llm.scratch import Scratch
from quarry.llm.sentencepiece_lattice import encode

#: Documents whose language is no surer than this are rejected with those that have none.
LEAST_LANGUAGE_SCORE = 0.3


def _beside(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that a stage reads, beside the whole row: what the stage adds cannot clash with a column of docs."""
    return docs.select(*read, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_beside(docs, "text", "lang", "source"), model).where("keep").select("whole_row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    found = language_id.predict(_beside(docs, "text"), language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("whole_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of smallest doc_id (nulls last), then the first; rows are told apart by
    their place, so rows of one doc_id and different texts are different documents."""
    rows = placed(spark, _beside(docs, "doc_id", "text"))
    group = ngram_jaccard_join(rows.select(F.col("place").alias("doc_id"), "text")).select(F.col("doc_id").alias("place"), "component_id")
    own = group.join(rows.select("place", "doc_id"), "place")
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"))
    return rows.join(first.select("first.place"), "place", "left_semi").select("whole_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return in_mix_order(docs)


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with their place in the order they were written in; what is no selection from files is written first."""
    if not docs.inputFiles() or _moved(docs):
        docs = Scratch(spark, "order").keep(docs)
    named = docs.select("*", F.col("_metadata.file_path").alias("place_file"), F.col("_metadata.row_index").alias("place_row"))
    sizes = {r.place_file: r.n for r in named.groupBy("place_file").agg((F.max("place_row") + 1).alias("n")).collect()}  # one row a file
    starts, at = [], 0
    for file in sorted(sizes, key=lambda f: (len(f), f)):  # part files are numbered in order
        starts.append((file, at))
        at += sizes[file]
    starts = spark.createDataFrame(starts, "place_file string, place_start long")
    return named.join(F.broadcast(starts), "place_file").select(*docs.columns, (F.col("place_start") + F.col("place_row")).alias("place"))


def _moved(docs: DataFrame) -> bool:
    """Whether docs is anything but columns of one table of files."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    return plan.getClass().getSimpleName() != "LogicalRelation"


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_place, n_tokens and ids of every document: mix_place is its place in docs, whose order is the
    mixture's, and the rows come in its order."""
    found = encode(placed(spark, docs.select("doc_id", "text")), place="place")
    return found.select("doc_id", F.col("place").alias("mix_place"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_classifier", judge_quality), ("language_id", identify_language), ("ngram_jaccard_join", drop_near_duplicates), ("source_mixing", mix), ("sentencepiece", encode_pieces)]
#: Trained and iterative stages are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
