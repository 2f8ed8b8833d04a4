"""Every query of the engine by name, with the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify, heuristic, tokens
from quarry.operators import chunks as ch
from quarry.operators import graph, imports, index, rendering, scoring, selection, usage
from quarry.plans import api
from quarry.plans import oracle as O
from quarry.sources import files as src
from quarry.streaming import usage as stream

#: The task that scoring queries ask, and what is left of it.
TASK = "auth the net tests handler models"
ASKED = scoring.question_tokens(TASK)
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_files = O.FILES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.virtual_files(table(spark, sf_dir, "documents"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.virtual_sources(table(spark, sf_dir, "documents"))


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        FOUND[name or f.__name__] = (f, sql)
        return f

    return keep


# Classification


@query(O.with_(_files, "SELECT path, language FROM files"))
def lang_classify(s, d):
    return corpus(s, d).select("path", "language")


@query(O.with_(_files, "SELECT path, role FROM files"))
def role_classify(s, d):
    return corpus(s, d).select("path", "role")


@query(O.with_(_files, "SELECT role, language, count(*) AS files, sum(tokens)::BIGINT AS tokens FROM files GROUP BY role, language"))
def role_histogram(s, d):
    return corpus(s, d).groupBy("role", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


@query(O.with_(_files, f"SELECT path, list_has_any({O.parts_of('path')}, ['vendor', 'node_modules', 'third_party']) AS vendored FROM files"))
def is_vendored(s, d):
    return corpus(s, d).select("path", classify.is_vendored(F.col("path")).alias("vendored"))


@query(O.with_(_files, "SELECT path, size, tokens FROM files"))
def token_estimate(s, d):
    return corpus(s, d).select("path", "size", "tokens")


@query(O.with_(_files, "SELECT count(*) AS file_count, sum(tokens)::BIGINT AS total_tokens, count(*) = 0 AS is_empty FROM files"))
def bundle_totals(s, d):
    return corpus(s, d).agg(F.count(F.lit(1)).alias("file_count"), F.sum("tokens").alias("total_tokens"), (F.count(F.lit(1)) == 0).alias("is_empty"))


@query(O.with_(_files, "SELECT sha256(string_agg(path || ':' || size, chr(10) ORDER BY path || ':' || size)) AS fingerprint FROM files"))
def fingerprint(s, d):
    return src.fingerprint(corpus(s, d))


@query(O.with_(_files, "SELECT sha256, count(*) AS copies, min(path) AS first_path FROM files GROUP BY sha256 HAVING count(*) > 1"))
def content_hash_dupes(s, d):
    return corpus(s, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


# Tokenizers


def _tokenized(files: DataFrame, own) -> DataFrame:
    return files.select("path", F.array_join(own, " ").alias("tokens"), F.size(own).cast("long").alias("n"))


def _tok_sql(own: str) -> str:
    return O.with_(_files, f"SELECT path, array_to_string({own}, ' ') AS tokens, len({own}) AS n FROM files")


@query(_tok_sql(O.query_tokens("path")))
def tok_query(s, d):
    return _tokenized(corpus(s, d), tokens.query_tokens(F.col("path")))


@query(_tok_sql(O.path_tokens("path")))
def tok_path(s, d):
    return _tokenized(corpus(s, d), tokens.path_tokens(F.col("path")))


@query(_tok_sql(O.content_tokens("content")))
def tok_content(s, d):
    return _tokenized(corpus(s, d), tokens.content_tokens(F.col("content")))


@query(_tok_sql(O.ident_tokens(O.name_of("path"))))
def tok_ident(s, d):
    return _tokenized(corpus(s, d), tokens.identifier_tokens(classify.file_name(F.col("path"))))


@query(O.with_(_files, f"SELECT count(*) AS all_tokens, count(*) FILTER (WHERE z IN ({O.names(tokens.STOP_WORDS)})) AS stop_tokens FROM (SELECT unnest({O.content_tokens('content')}) AS z FROM files)"))
def stopword_effect(s, d):
    return corpus(s, d).select(F.explode(tokens.content_tokens(F.col("content"))).alias("z")).agg(F.count(F.lit(1)).alias("all_tokens"), F.count_if(F.col("z").isin(tokens.STOP_WORDS)).alias("stop_tokens"))


# Statistics

_POST = f"""{_files}, post AS (SELECT path, term, sum(a)::INT AS tf_filename, 0 AS tf_symbols, sum(b)::INT AS tf_body FROM (SELECT path, unnest({O.path_tokens('path')}) AS term, 1 AS a, 0 AS b FROM files UNION ALL SELECT path, unnest({O.content_tokens('content')}), 0, 1 FROM files) GROUP BY path, term), lens AS (SELECT path, sha256, len({O.content_tokens('content')})::INT AS doc_length FROM files)"""


@query(O.with_(_files, f"SELECT count(*) AS total, round(avg(len({O.query_tokens('path')})), 6) AS average FROM files"))
def corpus_stats_shallow(s, d):
    return scoring.path_stats(corpus(s, d), []).select(F.col("total").cast("long").alias("total"), F.round("average", 6).alias("average"))


@query(O.with_(_POST, "SELECT count(*) AS total, round(avg(doc_length), 6) AS average FROM lens"))
def corpus_stats_deep(s, d):
    return index.corpus_stats(index.doc_lengths(corpus(s, d))).select("total", F.round("average", 6).alias("average"))


@query(O.with_(_POST, "SELECT term, count(*) AS df FROM post GROUP BY term"))
def term_df(s, d):
    return index.term_frequencies(index.postings(corpus(s, d)))


@query(O.with_(_POST, "SELECT * FROM post"))
def postings_fields(s, d):
    return index.postings(corpus(s, d))


@query(O.with_(_POST, "SELECT path, sha256, doc_length FROM lens"))
def doc_length(s, d):
    return index.doc_lengths(corpus(s, d))


# Scoring


@query(O.with_(f"{_files}, {O.bm25f_path(ASKED)}", "SELECT path, round(bm25f, 6) AS bm25f FROM bm"))
def bm25f_path(s, d):
    return scoring.bm25f_paths(corpus(s, d), ASKED).select("path", F.round("bm25f", 6).alias("bm25f"))


CONTENT_ASKED = ["the", "and", "anon", "the"]
_CONTENT = f"""{_POST}, st AS (SELECT count(*) AS total, avg(doc_length) AS average FROM lens), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), ask(term, times) AS (VALUES ('the', 2.0), ('and', 1.0), ('anon', 1.0)),
sc AS (SELECT post.path, sum(times::DOUBLE * ln((total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * ((5.0::DOUBLE * tf_filename + tf_body) / (5.0::DOUBLE * tf_filename + tf_body + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_length / average)))) AS bm25f FROM post JOIN ask USING (term) JOIN dfs USING (term) JOIN lens USING (path), st GROUP BY post.path)"""


@query(O.with_(_CONTENT, "SELECT lens.path, round(coalesce(bm25f, 0), 6) AS bm25f FROM lens LEFT JOIN sc USING (path)"))
def bm25f_content(s, d):
    files = corpus(s, d)
    docs, post = index.doc_lengths(files), index.postings(files, sorted(set(CONTENT_ASKED)))
    return scoring.bm25f_postings(docs, post, index.corpus_stats(docs), None, CONTENT_ASKED).select("path", F.round("bm25f", 6).alias("bm25f"))


@query(O.with_(f"{_files}, toks AS (SELECT *, {O.query_tokens('path')} AS t FROM files)", "SELECT path, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}_part" for k, v in O.heuristic_parts(ASKED).items()) + f", round({O.heuristic(ASKED)}, 6) AS heuristic FROM toks"))
def heuristic_parts(s, d):
    c = F.col("path"), F.col("role"), F.col("size")
    return corpus(s, d).select("path", *(F.round(v, 6).alias(f"{k}_part") for k, v in heuristic.heuristic_parts(*c, ASKED).items()), F.round(heuristic.heuristic(*c, ASKED), 6).alias("heuristic"))


_SCORES = "path, round(bm25f, 6) AS bm25f, round(heuristic, 6) AS heuristic, round(score, 6) AS score"


def _scores(df: DataFrame, *more: str) -> DataFrame:
    return df.select("path", *(F.round(c, 6).alias(c) for c in ("bm25f", "heuristic", "score")), *more)


@query(O.with_(O.hybrid(ASKED), f"SELECT {_SCORES} FROM scored"))
def hybrid_default(s, d):
    return _scores(scoring.hybrid(corpus(s, d), TASK))


@query(O.with_(O.hybrid(ASKED, 0.25, 0.75), f"SELECT {_SCORES} FROM scored"))
def hybrid_weights(s, d):
    return _scores(scoring.hybrid(corpus(s, d), TASK, 1.0, 3.0))


_INDEXED = f"""{O.hybrid(ASKED)}, ix AS (SELECT path, len({O.content_tokens('content')}) AS doc_length, {O.path_tokens('path')} AS names, {O.content_tokens('content')} AS body FROM files WHERE doc_id % 10 <> 0),
xp AS (SELECT path, term, 5.0::DOUBLE * sum(a) + sum(b) AS tf FROM (SELECT path, unnest(names) AS term, 1 AS a, 0 AS b FROM ix UNION ALL SELECT path, unnest(body), 0, 1 FROM ix) WHERE term IN ({O.names(ASKED)}) GROUP BY path, term), xd AS (SELECT term, count(*) AS df FROM xp GROUP BY term), xt AS (SELECT count(*) AS total, avg(doc_length) AS average FROM ix),
xs AS (SELECT xp.path, sum(ln((total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / average))) AS own FROM xp JOIN xd USING (term) JOIN ix USING (path), xt GROUP BY xp.path),
both_ AS (SELECT scored.path, heuristic, CASE WHEN ix.path IS NULL THEN bm25f ELSE coalesce(own, 0) END AS bm25f FROM scored LEFT JOIN ix USING (path) LEFT JOIN xs USING (path))"""


@query(O.with_(_INDEXED, "SELECT path, round(bm25f, 6) AS bm25f, round(heuristic, 6) AS heuristic, round(0.6::DOUBLE * bm25f + 0.4::DOUBLE * heuristic, 6) AS score FROM both_"))
def hybrid_indexed(s, d):
    files = corpus(s, d)
    known = files.where("doc_id % 10 <> 0")  # files outside the index are scored by their paths
    docs = index.doc_lengths(known)
    return _scores(scoring.hybrid(files, TASK, index=index.Index(docs=docs, postings=index.postings(known, ASKED), stats=index.corpus_stats(docs), term_df=None)))


@query(O.with_(O.hybrid(ASKED), f"SELECT {_SCORES}, tokens FROM scored ORDER BY scored.score DESC, path LIMIT 10"))
def explain_topk(s, d):
    return _scores(api.explain(corpus(s, d), TASK), "tokens")


# Selection


def _selection(name: str, **limits):
    sql = O.with_(O.selected(ASKED, **limits), f"SELECT {_SCORES}, tokens, rank, cumulative FROM sel")

    def run(s, d):
        return _scores(selection.select_files(scoring.hybrid(corpus(s, d), TASK), **limits), "tokens", F.col("rank").cast("long").alias("rank"), "cumulative")

    query(sql, name)(run)


_selection("min_score_filter", min_score=0.5)
_selection("top_n", min_score=0.0, top=25)
_selection("budget_bytes", min_score=0.0, max_bytes=60_000)
_selection("budget_tokens", min_score=0.0, max_tokens=9_000)
for _p in (selection.PRESETS["fast"], selection.PRESETS["balanced"]):
    _selection(f"preset_{_p.name}", min_score=_p.min_score, max_bytes=_p.max_bytes)


@query(O.with_(O.selected(ASKED, 0.01, max_bytes=100_000), f"SELECT {_SCORES}, language, role, tokens, rank FROM sel"))
def quick_balanced(s, d):
    return _scores(api.quick(corpus(s, d), TASK), "language", "role", "tokens", F.col("rank").cast("long").alias("rank"))


def _deep(name: str):
    def run(s, d):
        own = code(s, d)
        files = src.described(own.withColumn("size", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2("content", 256)).drop("language"))
        return api.query(files, TASK, name, api.build_index(files)).select("path", F.round("score", 6).alias("score"), "tokens", F.col("rank").cast("long").alias("rank"))

    query(None, f"preset_{name}")(run)


_deep("deep")
_deep("thorough")

# Chunks and imports

_sources = O.sources()


def _chunk(lang: str):
    query(O.with_(_sources, O.chunk_query(lang)), f"chunk_{lang}")(lambda s, d: ch.chunks(code(s, d).where(F.col("language") == lang)))


for _lang in src.TEMPLATES:
    _chunk(_lang)


@query(O.with_(_sources, "SELECT language, kind, count(*) AS chunks FROM (" + " UNION ALL ".join(f"SELECT {O.q(x)} AS language, kind FROM ({O.chunk_query(x)})" for x in src.TEMPLATES) + ") GROUP BY language, kind"))
def chunk_counts(s, d):
    own = code(s, d)
    return ch.chunks(own).join(own.select("path", "language"), "path").groupBy("language", "kind").agg(F.count(F.lit(1)).alias("chunks"))


_CODE_CHUNKS = " UNION ALL ".join(f"SELECT path, name FROM ({O.chunk_query(x)})" for x in src.TEMPLATES)
_CODE_POST = f"""{_sources}, names AS ({_CODE_CHUNKS}), code_post AS (SELECT path, term, sum(a)::INT AS tf_filename, sum(b)::INT AS tf_symbols, sum(c)::INT AS tf_body FROM (
SELECT path, unnest({O.path_tokens('path')}) AS term, 1 AS a, 0 AS b, 0 AS c FROM sources UNION ALL SELECT path, unnest({O.ident_tokens('name')}), 0, 1, 0 FROM names UNION ALL SELECT path, unnest({O.content_tokens('content')}), 0, 0, 1 FROM sources) GROUP BY path, term)"""


@query(O.with_(_CODE_POST, "SELECT * FROM code_post"))
def postings_code(s, d):
    return index.postings(code(s, d))


@query(O.with_(_CODE_POST, f"SELECT (SELECT count(*) FROM sources) AS files, (SELECT round(avg(len({O.content_tokens('content')})), 6) FROM sources) AS average, (SELECT count(*) FROM names) AS chunks, (SELECT count(*) FROM code_post) AS file_terms, (SELECT count(DISTINCT term) FROM code_post) AS terms"))
def inspect_code(s, d):
    own = code(s, d).withColumn("sha256", F.sha2("content", 256))
    return usage.inspect_index(index.doc_lengths(own), ch.chunks(own), index.postings(own))


_other = "other"
_IMPORTS = {
    "rust": f"SELECT path, 1 AS line_no, {_other} AS raw FROM s WHERE language = 'rust'",
    "go": f"SELECT path, 3 AS line_no, 'example.org/' || w1 || '/' || {_other} AS raw FROM s WHERE language = 'go'",
    "python": f"SELECT path, 1 AS line_no, {_other} AS raw FROM s WHERE language = 'python' UNION ALL SELECT path, 2, '.' || {_other} FROM s WHERE language = 'python'",
    "javascript": f"SELECT path, 1 AS line_no, './' || {_other} AS raw FROM s WHERE language = 'javascript' UNION ALL SELECT path, 2, {_other} FROM s WHERE language = 'javascript'",
    "java": f"SELECT path, 2 AS line_no, 'org.example.' || {_other} AS raw FROM s WHERE language = 'java'",
    "ruby": f"SELECT path, 1 AS line_no, {_other} AS raw FROM s WHERE language = 'ruby'",
    "c": f"SELECT path, 1 AS line_no, {_other} || '.h' AS raw FROM s WHERE language = 'c'",
}
_IMPORT_BASE = f"{_sources}, s AS (SELECT sources.path, sources.language, src.w1, src.other FROM sources JOIN src USING (doc_id))"


def _import(lang: str):
    query(O.with_(_IMPORT_BASE, _IMPORTS[lang]), f"imports_{lang}")(lambda s, d: imports.imports(code(s, d).where(F.col("language") == lang)).select("path", "line_no", "raw"))


for _lang in _IMPORTS:
    _import(_lang)

_STEM = rf"lower(regexp_replace({O.name_of('path')}, '^(.+)\.[^.]*$', '\1'))"


@query(O.with_(_sources, f"SELECT {_STEM} AS key, path FROM sources"))
def stem_index(s, d):
    return imports.stem_index(code(s, d))


@query(O.with_(_sources, f"SELECT lower({O.parts_of('path')}[-2]) AS key, path FROM sources WHERE len({O.parts_of('path')}) > 1"))
def dir_index(s, d):
    return imports.dir_index(code(s, d))


# every template import names the stem `other`; JavaScript's ./ never equals a candidate and falls back to all of the stem
_EDGES = f"""{_IMPORT_BASE}, imps AS (SELECT i.path, i.line_no, s2.other FROM ({' UNION ALL '.join(f'({x})' for x in _IMPORTS.values())}) i JOIN s s2 ON s2.path = i.path), idx AS (SELECT {_STEM} AS key, path AS target FROM sources),
edges AS (SELECT imps.path AS src, target AS dst FROM imps JOIN idx ON key = other WHERE imps.path <> target AND NOT list_has_any({O.parts_of('imps.path')}, ['vendor', 'node_modules', 'third_party']) AND NOT list_has_any({O.parts_of('target')}, ['vendor', 'node_modules', 'third_party']))"""


@query(O.with_(_EDGES, "SELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst"))
def edges_non_vendored(s, d):
    return imports.import_edges(code(s, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(O.with_(_EDGES, "SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges"))
def graph_counts(s, d):
    return graph.graph_counts(imports.import_edges(code(s, d)))


def supplier_edges(s, d) -> DataFrame:
    """A larger multigraph: suppliers to the parts that they ship, parts of even keys back to suppliers."""
    x = table(s, d, "lineitem")
    a = x.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return a.unionByName(x.where("l_partkey % 2 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")))


ROUNDS = 6
_LINKS = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_partkey % 2 = 0), n AS (SELECT src AS path FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), w AS (SELECT e.src, e.dst, count(*)::DOUBLE / any_value(out) AS share FROM e JOIN o USING (src) GROUP BY e.src, e.dst), c AS (SELECT count(*)::DOUBLE AS k FROM n), r0 AS (SELECT path, 1 / k AS rank FROM n, c)"
_RANKS = _LINKS + "".join(f", r{i + 1} AS (SELECT n.path, 0.15::DOUBLE / k + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(share * rank) AS got FROM w JOIN r{i} ON r{i}.path = w.src GROUP BY dst) g ON g.dst = n.path)" for i in range(ROUNDS))


@query(O.with_(_RANKS, f"SELECT path, round(rank, 8) AS rank FROM r{ROUNDS}"))
def pagerank_raw(s, d):
    return graph.pagerank(supplier_edges(s, d), rounds=ROUNDS).select("path", F.round("rank", 8).alias("rank"))


@query(O.with_(_RANKS, f"SELECT path, round(rank / (SELECT max(rank) FROM r{ROUNDS}), 6) AS pagerank FROM r{ROUNDS}"))
def pagerank_norm(s, d):
    return graph.normalised(graph.pagerank(supplier_edges(s, d), rounds=ROUNDS)).select("path", F.round("pagerank", 6).alias("pagerank"))


@query(O.with_(_EDGES, "SELECT src AS path, 1 AS hops FROM edges WHERE dst = (SELECT min(dst) FROM edges) GROUP BY src"))
def impact_direct(s, d):
    edges = imports.import_edges(code(s, d))
    first = edges.agg(F.min("dst")).first()[0]
    return graph.impact(edges, first, 1).where("hops = 1")


@query("WITH RECURSIVE " + _EDGES + ", hit(path, hops) AS (SELECT min(dst), 0 FROM edges UNION SELECT edges.src, hops + 1 FROM hit JOIN edges ON edges.dst = hit.path WHERE hops < 4) SELECT path, min(hops) AS hops FROM hit GROUP BY path")
def impact_reachability(s, d):
    edges = imports.import_edges(code(s, d))
    return graph.impact(edges, edges.agg(F.min("dst")).first()[0], 4)


# Fusion and recency

_LISTS = f"{O.hybrid(ASKED)}, l1 AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS r FROM scored), l2 AS (SELECT path, row_number() OVER (ORDER BY tokens DESC, path) AS r FROM scored)"


def _two_lists(s, d) -> DataFrame:
    scored = scoring.hybrid(corpus(s, d), TASK)
    return scoring.ranked(scored).select(F.lit(1).alias("list_id"), "rank", "path").unionByName(scoring.ranked(scored, "tokens").select(F.lit(2).alias("list_id"), "rank", "path"))


def _rrf(name: str, k: int):
    query(O.with_(_LISTS, f"SELECT path, round(sum(1.0::DOUBLE / ({k} + r)), 8) AS rrf_score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY path"), name)(lambda s, d: scoring.fuse(_two_lists(s, d), k).select("path", F.round("rrf_score", 8).alias("rrf_score")))


_rrf("rrf_two_lists", scoring.RRF_K)
_rrf("rrf_custom_k", 5)

_RECENT = "c AS (SELECT 'u' || user_id AS path, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY user_id), rec AS (SELECT path, ln(1 + n) / ln(1 + (SELECT max(n) FROM c)) AS recency FROM c)"


def commits(s, d) -> DataFrame:
    return table(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), "ts")


@query(O.with_(_RECENT, "SELECT path, round(recency, 6) AS recency FROM rec"))
def recency_score(s, d):
    return scoring.recency(commits(s, d), 10).select("path", F.round("recency", 6).alias("recency"))


@query(O.with_(_RECENT, "SELECT 'u' || c_custkey AS path, round(coalesce(recency, 0), 6) AS recency FROM customer LEFT JOIN rec ON path = 'u' || c_custkey"))
def recency_default(s, d):
    files = table(s, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("path"))
    return scoring.file_recency(files, scoring.recency(commits(s, d), 10)).select("path", F.round("recency", 6).alias("recency"))


@query(O.with_(_RECENT + ", a AS (SELECT 'u' || user_id AS path, round(sum(value), 4) AS score FROM events GROUP BY user_id), b AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS r FROM a), m AS (SELECT path, row_number() OVER (ORDER BY recency DESC, path) AS r FROM rec)", "SELECT a.path, round(1.0::DOUBLE / (60 + b.r) + coalesce(1.0::DOUBLE / (60 + m.r), 0), 8) AS score FROM a JOIN b USING (path) LEFT JOIN m USING (path)"))
def rrf_with_recency(s, d):
    base = table(s, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.round(F.sum("value"), 4).alias("score"))
    return scoring.fuse_scored(base, scoring.recency(commits(s, d), 10), "recency").select("path", F.round("score", 8).alias("score"))


# Incremental index: the snapshot before has every document but each 7th, and other text for each 11th

_OLD = f"{_POST}, old AS (SELECT files.path, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE lens.sha256 END AS sha256, lens.doc_length FROM files JOIN lens USING (path) WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || path, 'x', 1 FROM files WHERE doc_id % 13 = 0)"


def snapshots(s, d) -> tuple[DataFrame, DataFrame]:
    files = corpus(s, d)
    old = index.doc_lengths(files).join(files.select("path", "doc_id"), "path").where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), "doc_length")
    return files, old.unionByName(files.where("doc_id % 13 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), F.lit("x").alias("sha256"), F.lit(1).alias("doc_length")))


@query(O.with_(_OLD, "SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = files.path AND old.sha256 = files.sha256)"))
def incr_changed(s, d):
    return index.changed(*snapshots(s, d)).select("path")


@query(O.with_(_OLD, "SELECT path FROM files WHERE EXISTS (SELECT 1 FROM old WHERE old.path = files.path AND old.sha256 = files.sha256)"))
def incr_unchanged(s, d):
    return index.unchanged(*snapshots(s, d)).select("path")


@query(O.with_(_OLD, "SELECT path FROM old WHERE path NOT IN (SELECT path FROM files)"))
def incr_deleted(s, d):
    return index.deleted(*snapshots(s, d)).select("path")


@query(O.with_(_POST, "SELECT path, sha256, doc_length FROM lens"))
def merge_incremental(s, d):
    return index.merge_docs(*snapshots(s, d))


# Reports and renderings


@query(O.with_(_POST, "SELECT (SELECT count(*) FROM lens) AS files, (SELECT round(avg(doc_length), 6) FROM lens) AS average, 0::BIGINT AS chunks, (SELECT count(*) FROM post) AS file_terms, (SELECT count(DISTINCT term) FROM post) AS terms"))
def inspect_stats(s, d):
    files = corpus(s, d)
    return usage.inspect_index(index.doc_lengths(files), ch.chunks(files), index.postings(files))


@query(O.with_(_files, f"SELECT CASE WHEN place <= 5 THEN ext ELSE '(other)' END AS extension, sum(n)::BIGINT AS files FROM (SELECT *, row_number() OVER (ORDER BY n DESC, ext) AS place FROM (SELECT {O.ext_of('path')} AS ext, count(*) AS n FROM files GROUP BY ext)) GROUP BY 1"))
def inspect_extensions(s, d):
    return usage.language_counts(corpus(s, d).select(classify.extension(F.col("path")).alias("extension")), 5)


_SEL = O.selected(ASKED, 0.01, max_bytes=100_000)


def chosen(s, d) -> DataFrame:
    return api.query(corpus(s, d), TASK)


@query()
def render_jsonl(s, d):
    return api.render(chosen(s, d), "jsonl", TASK, scanned=corpus(s, d)).select("section", F.col("rank").cast("long").alias("rank"), "line")


@query()
def render_json(s, d):
    return api.render(chosen(s, d), "json", TASK)


@query(O.with_(_SEL, "SELECT rank, printf('%s (%s, %dtok, %.2f)', path, role, tokens, score) AS line FROM sel"))
def render_compact(s, d):
    return api.render(chosen(s, d), "compact").select(F.col("rank").cast("long").alias("rank"), "line")


@query(O.with_(_SEL, "SELECT rank, rpad(CASE WHEN length(path) > 60 THEN '...' || right(path, 57) ELSE path END, 60, ' ') || ' ' || printf('%8.4f %8d %s', score, tokens, role) AS line FROM sel"))
def render_human(s, d):
    return api.render(chosen(s, d), "human").select(F.col("rank").cast("long").alias("rank"), "line")


@query(O.with_(_SEL, "SELECT 'file' AS kind, path, tokens, language, role FROM sel UNION ALL SELECT 'header', NULL, NULL, NULL, NULL UNION ALL SELECT 'footer', NULL, NULL, NULL, NULL"))
def render_reparse(s, d):
    return rendering.reread(api.render(chosen(s, d), "jsonl", TASK, scanned=corpus(s, d)).select("line")).select("kind", "path", "tokens", "language", "role")


_LOG = "log AS (SELECT CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'click' THEN 'query' WHEN 'view' THEN 'file_read' ELSE event_type END AS event, 'u' || user_id AS path, CAST(json_extract_string(props, '$.k') AS INT) AS files_suggested, CAST(floor(value) AS BIGINT) AS tokens_suggested FROM events)"


@query(O.with_(_LOG, "SELECT count(*) FILTER (WHERE event = 'session_start') AS sessions, count(*) FILTER (WHERE event = 'query') AS queries, coalesce(sum(files_suggested) FILTER (WHERE event = 'query'), 0)::BIGINT AS files_suggested, coalesce(sum(tokens_suggested) FILTER (WHERE event = 'query'), 0)::BIGINT AS tokens_suggested, count(DISTINCT path) FILTER (WHERE event = 'file_read') AS files_opened, round(coalesce(sum(files_suggested) FILTER (WHERE event = 'query'), 0)::DOUBLE / greatest(1, count(*) FILTER (WHERE event = 'query')), 6) AS files_per_query FROM log"))
def usage_gain(s, d):
    event = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "click", "query").when(F.col("event_type") == "view", "file_read").otherwise(F.col("event_type"))
    log = table(s, d, "events").select(event.alias("event"), F.concat(F.lit("u"), "user_id").alias("path"), F.get_json_object("props", "$.k").cast("int").alias("files_suggested"), F.floor("value").alias("tokens_suggested"))
    return usage.gains(log)


# Extensions: streaming logic over a batch, and the embedding signal


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(s, d):
    return stream.windowed_counts(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM b GROUP BY user_id, k")
def stream_sessions(s, d):
    return stream.sessions(table(s, d, "events"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS p FROM v WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))), 6) AS embedding FROM v, q")
def embedding_cosine(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    one = F.broadcast(v.where("vec_id = 0").select(F.col("e").alias("p")).limit(1))  # one row
    return v.join(one).select("vec_id", F.round(dot("e", "p") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("p", "p"))), 6).alias("embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracles() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
