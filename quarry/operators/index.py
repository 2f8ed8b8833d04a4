"""The content index as tables: docs, postings, term_df, stats; built in whole or by what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tokens import content_tokens, identifier_tokens, path_tokens
from quarry.operators.chunks import chunks

SCHEMA_VERSION = 2


def doc_lengths(files: DataFrame) -> DataFrame:
    return files.select("path", "sha256", F.size(content_tokens(F.col("content"))).alias("doc_length"))


def postings(files: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """path, term, tf_filename, tf_symbols, tf_body of files(path, language, content); of `terms` only, if given.

    One pass over the files: names and contents are cut side by side and exploded together; symbols come from the lines of
    source files only. Counted with map-side partial sums: one shuffle on (path, term).
    """
    asked = (lambda c: F.filter(c, lambda t: t.isin(terms))) if terms is not None else (lambda c: c)
    marked = lambda c, field: F.transform(asked(c), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    own = files.select("path", F.explode(F.concat(marked(path_tokens(F.col("path")), 0), marked(F.coalesce(content_tokens(F.col("content")), F.array().cast("array<string>")), 2))).alias("x")).select("path", "x.term", "x.field")
    symbols = chunks(files).select("path", F.explode(asked(identifier_tokens(F.col("name")))).alias("term"), F.lit(1).alias("field"))
    counted = [F.sum(F.when(F.col("field") == i, 1).otherwise(0)).cast("int").alias(c) for i, c in enumerate(("tf_filename", "tf_symbols", "tf_body"))]
    return own.unionByName(symbols).groupBy("path", "term").agg(*counted)


def term_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("doc_length"), F.lit(1.0)).alias("average"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def changed(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    return fresh.join(existing.select("path", "sha256"), ["path", "sha256"], "left_anti")


def unchanged(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    return fresh.join(existing.select("path", "sha256"), ["path", "sha256"], "left_semi")


def deleted(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.join(fresh.select("path"), "path", "left_anti")


def merge_docs(fresh_files: DataFrame, existing: DataFrame) -> DataFrame:
    """docs of the fresh snapshot: rows of unchanged files carried over, others computed, missing ones gone."""
    carried = existing.join(fresh_files.select("path", "sha256"), ["path", "sha256"], "left_semi").select("path", "sha256", "doc_length")
    return carried.unionByName(doc_lengths(changed(fresh_files, existing)))


def merge_postings(fresh_files: DataFrame, existing_docs: DataFrame, existing_postings: DataFrame) -> DataFrame:
    same = unchanged(fresh_files, existing_docs).select("path")
    return existing_postings.join(same, "path", "left_semi").unionByName(postings(changed(fresh_files, existing_docs)))


class Index:
    """The tables of an index, in memory as lazy DataFrames or saved as parquet."""

    TABLES = ("docs", "postings", "term_df", "stats", "pagerank")

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)

    @staticmethod
    def build(files: DataFrame, pagerank: DataFrame, existing: Index | None = None) -> Index:
        docs = merge_docs(files, existing.docs) if existing else doc_lengths(files)
        post = merge_postings(files, existing.docs, existing.postings) if existing else postings(files)
        return Index(docs=docs, postings=post, term_df=term_frequencies(post), stats=corpus_stats(docs), pagerank=pagerank)

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> Index | None:
        """None where the index is missing, broken or of another version."""
        from pyspark.errors import PySparkException

        try:
            found = Index(**{name: spark.read.parquet(f"{path}/{name}") for name in Index.TABLES})
            return found if found.stats.first()["schema_version"] == SCHEMA_VERSION else None
        except (PySparkException, TypeError):
            return None
