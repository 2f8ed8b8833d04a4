"""BM25F, hybrid scores, rank fusion and commit recency over file tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.heuristic import heuristic
from quarry.functions.tokens import STOP_WORDS, query_tokens

# Field weights and saturation of BM25F, the constant of rank fusion.
FIELDS = {"tf_filename": 5.0, "tf_symbols": 3.0, "tf_body": 1.0}
K1, B, RRF_K = 1.2, 0.75, 60


def question_tokens(task: str) -> list[str]:
    """query_tokens() of a literal, on the driver: the question is a parameter, not data."""
    x = re.sub(r"[ \t\n\x0b\f\r/\\.\-_]", " ", task)
    x = re.sub("([^A-Z])([A-Z])", r"\1 \2", x)
    x = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", x)
    return [t for t in (p.lower() for p in x.split(" ")) if len(t.encode()) >= 2 and t not in STOP_WORDS]


def idf(total: Column, df: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / average))


def path_stats(files: DataFrame, question: list[str]) -> DataFrame:
    """One row: number of files, mean length of path tokens, and each question token's document frequency."""
    own = files.select(query_tokens(F.col("path")).alias("t"))
    return own.agg(F.count(F.lit(1)).cast("double").alias("total"), F.when(F.count(F.lit(1)) > 0, F.avg(F.size("t"))).otherwise(1.0).alias("average"), *(F.sum(F.when(F.array_contains("t", q), 1.0).otherwise(0.0)).alias(f"df{i}") for i, q in enumerate(question)))


def bm25f_paths(files: DataFrame, question: list[str]) -> DataFrame:
    """files with bm25f over path tokens in the file name field; statistics come as one broadcast row."""
    stats = F.broadcast(path_stats(files, question))  # one row
    own = F.col("path_tokens")
    terms = []
    for i, q in enumerate(question):
        tf = FIELDS["tf_filename"] * F.size(F.filter(own, _is(q))).cast("double")
        terms.append(idf(F.col("total"), F.col(f"df{i}")) * saturated(tf, F.size(own).cast("double"), F.col("average")))
    score = reduce(lambda a, b: a + b, terms, F.lit(0.0))
    return files.withColumn("path_tokens", query_tokens(F.col("path"))).join(stats).withColumn("bm25f", F.when(F.col("total") > 0, score).otherwise(0.0)).select(*files.columns, "bm25f")


def _is(token: str):
    return lambda t: t == token


def bm25f_postings(docs: DataFrame, postings: DataFrame, stats: DataFrame, term_df: DataFrame | None, question: list[str]) -> DataFrame:
    """path, bm25f of docs(path, doc_length) by postings(path, term, tf_*); repeated question tokens count again.

    Only postings of asked terms are read; without term_df their numbers of documents are counted from the same rows.
    """
    spark = docs.sparkSession
    terms = sorted(set(question))
    asked = F.broadcast(spark.createDataFrame([(q, float(question.count(q))) for q in terms], "term string, times double"))  # the question's terms
    own = postings.where(F.col("term").isin(terms))
    df = term_df.where(F.col("term").isin(terms)) if term_df is not None else own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = own.join(asked, "term").join(F.broadcast(df), "term").join(docs.select("path", "doc_length"), "path").join(F.broadcast(stats.select("total", "average")))
    tf = reduce(lambda a, b: a + b, (w * F.col(c) for c, w in FIELDS.items()))
    one = F.col("times") * idf(F.col("total"), F.col("df")) * saturated(tf, F.col("doc_length").cast("double"), F.col("average"))
    scores = hits.groupBy("path").agg(F.sum(one).alias("bm25f"))
    return docs.select("path").join(scores, "path", "left").fillna(0.0, ["bm25f"])


def hybrid(files: DataFrame, task: str, bm25f_weight: float = 0.6, heuristic_weight: float = 0.4, index=None) -> DataFrame:
    """files(path, size, language, role) with bm25f, heuristic and score; weights are normalised, or default if their sum is not positive.

    index: an index's tables (docs, postings, stats, term_df); then bm25f is that of names, symbols and contents, and that
    of the path only for files outside the index.
    """
    total = bm25f_weight + heuristic_weight
    wb, wh = (bm25f_weight / total, heuristic_weight / total) if total > 0 else (0.6, 0.4)
    question = question_tokens(task)
    out = bm25f_paths(files, question)
    if index is not None:
        own = bm25f_postings(index.docs, index.postings, index.stats, index.term_df, question)
        out = out.withColumnRenamed("bm25f", "by_path").join(own, "path", "left").withColumn("bm25f", F.coalesce("bm25f", "by_path")).drop("by_path")
    out = out.withColumn("heuristic", heuristic(F.col("path"), F.col("role"), F.col("size"), question))
    return out.withColumn("score", wb * F.col("bm25f") + wh * F.col("heuristic"))


def ranked(scored: DataFrame, by: str = "score") -> DataFrame:
    """rank (from 1) by descending score, ties by path. One ordered list is one partition: call it on bounded candidates."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "path")))


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """path, rrf_score of lists(list_id, rank, path)."""
    return lists.groupBy("path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def fuse_scored(scored: DataFrame, other: DataFrame, by: str, k: int = RRF_K, candidates: int | None = None) -> DataFrame:
    """scored with its score replaced by the fusion of its own order with other(path, <by>)'s order.

    candidates: with a minimum score t only files among the best 2 / t ranks of one list can pass. Then those of either
    list are chosen by top-k, their ranks in both lists are counted exactly over all rows, and no global order of all rows
    is formed; what is not chosen cannot pass and gets the score 0.
    """
    both = scored.join(other.select("path", by), "path", "left")
    if candidates is None:
        r1, r2 = ranked(scored), ranked(other, by)
    else:
        lists = (scored, "score"), (other, by)
        best = [x.orderBy(F.desc(c), "path").limit(candidates).select("path") for x, c in lists]
        chosen = scored.sparkSession.createDataFrame(best[0].union(best[1]).distinct().collect(), "path string")  # 2 * candidates at most
        r1, r2 = (F.broadcast(exact_ranks(x, c, chosen)) for x, c in lists)
    r1, r2 = r1.select("path", F.col("rank").alias("r1")), r2.select("path", F.col("rank").alias("r2"))
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.join(r1, "path", "left").join(r2, "path", "left").withColumn("score", share("r1") + share("r2")).drop("r1", "r2")


def exact_ranks(scored: DataFrame, by: str, chosen: DataFrame) -> DataFrame:
    """path, rank of the chosen paths in the order of ranked() of all rows: the rows before each are counted, not ordered."""
    own = scored.select(F.col(by).cast("double").alias("by"), "path")

    def key(score, path):
        return (True, 0.0, path.encode()) if score is None else (False, -score, path.encode())

    keys = sorted(key(r.by, r.path) for r in own.join(F.broadcast(chosen), "path", "left_semi").collect())

    def run(batches):
        counts = Counter()
        for batch in batches:
            counts.update(bisect_right(keys, key(*r)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"place": pa.array(list(counts), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    before = {r.place: r.n for r in own.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    ranks = accumulate(before.get(i, 0) for i in range(len(keys)))
    return scored.sparkSession.createDataFrame([(path.decode(), n + 1) for (_, _, path), n in zip(keys, ranks, strict=True)], "path string, rank long")


def recency(commits: DataFrame, days: int = 90) -> DataFrame:
    """path, recency of commits(path, ts): ln(1 + n) / ln(1 + most) over the last days before the newest commit."""
    newest = commits.agg(F.max("ts").alias("newest"))
    counts = commits.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select("path", (F.log(1 + F.col("n")) / F.log(1 + F.col("most"))).alias("recency"))


def file_recency(files: DataFrame, recency: DataFrame) -> DataFrame:
    """files with their recency; 0 for files without a recent commit."""
    return files.join(recency.select("path", "recency"), "path", "left").fillna(0.0, ["recency"])
