from pyspark.sql import functions as F

from quarry.functions import classify, tokens
from quarry.functions.heuristic import heuristic
from quarry.operators.scoring import bm25f_paths, fuse, hybrid, question_tokens
from quarry.operators.selection import within_budget
from quarry.sources.files import described, fingerprint, ignored

PATHS = ["src/auth/handler.rs", "src/auth/middleware.rs", "src/db/connection.rs", "src/db/query.rs", "src/main.rs", "tests/auth_test.rs", "README.md"]
FILES = [("src/auth/handler.rs", 2000), ("src/auth/middleware.rs", 1500), ("src/db/connection.rs", 3000), ("tests/auth_test.rs", 800), ("README.md", 500)]


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def scores(spark, asked):
    out = bm25f_paths(rows(spark, [(p,) for p in PATHS], "path string"), question_tokens(asked)).collect()
    return {r.path: round(r.bm25f, 6) for r in out}


def test_bm25f_paths(spark):
    assert scores(spark, "auth")["src/auth/handler.rs"] == 0.655262 == scores(spark, "auth")["tests/auth_test.rs"]
    assert scores(spark, "auth handler")["src/auth/handler.rs"] == 1.982130
    assert scores(spark, "src")["src/main.rs"] == 0.309357
    assert set(scores(spark, "").values()) == {0.0}


def test_hybrid_and_heuristic(spark):
    files = described(rows(spark, FILES, "path string, size bigint"))
    out = {r.path: r for r in hybrid(files, "auth").collect()}
    assert [round(out[p].heuristic, 6) for p, _ in FILES] == [0.955, 0.955, 0.555, 0.8, 0.33]
    assert [round(out[p].score, 6) for p, _ in FILES] == [0.638665, 0.638665, 0.222, 0.576665, 0.132]
    assert files.select(heuristic(F.col("path"), F.col("role"), F.col("size"), []).alias("h")).where("h < 0 or h > 1").count() == 0


def test_roles_and_languages(spark):
    cases = {"src/a.rs": "impl", "vendor/x.go": "generated", "a/x.pb.go": "generated", "tests/x.rs": "test", "test/x.rs": "impl", "x_test.go": "test", "test_x.py": "test", "docs/x.rs": "docs", "Cargo.toml": "build", "x.toml": "config", ".env.local": "config", "x.md": "docs", "x.jsx": "other", "x.html": "impl", "x.bin": "other"}
    got = rows(spark, [(k,) for k in cases], "path string").select("path", classify.role(F.col("path")).alias("r"), classify.language(F.col("path")).alias("l"), classify.extension(F.col("path")).alias("e")).collect()
    assert {r.path: r.r for r in got} == cases
    assert {r.path: r.l for r in got}["x.jsx"] == "other" and {r.path: r.e for r in got}[".env.local"] == "local"


def test_tokenizers(spark):
    one = rows(spark, [("parseHTTPResponse the_fooBar(x): a.b/c-dE",)], "t string")
    got = one.select(tokens.query_tokens(F.col("t")), tokens.path_tokens(F.col("t")), tokens.content_tokens(F.col("t")), tokens.identifier_tokens(F.lit("getURLFor_x1"))).first()
    assert got[0] == ["parse", "http", "response", "foo", "bar(x):"] == question_tokens("parseHTTPResponse the_fooBar(x): a.b/c-dE")
    assert "the" in got[2] and got[3] == ["get", "url", "for", "x1"]


def test_budget_keeps_the_first_row_and_stops_at_the_first_overflow(spark):
    s = rows(spark, [("a", 3.0, 100), ("b", 2.0, 200), ("c", 1.0, 300), ("d", 0.5, 1)], "path string, score double, tokens bigint")
    kept = lambda **k: [r.path for r in within_budget(s, **k).orderBy("rank").collect()]
    assert kept(max_bytes=1000) == ["a"] and kept(max_tokens=250) == ["a"] and kept(max_bytes=10) == ["a"] and kept() == ["a", "b", "c", "d"] and kept(max_tokens=300) == ["a", "b"]


def test_fusion_fingerprint_and_ignore_rules(spark):
    out = {r.path: r.rrf_score for r in fuse(rows(spark, [(1, 1, "x"), (1, 2, "y")], "list_id int, rank int, path string"), 1).collect()}
    assert out == {"x": 1 / 2, "y": 1 / 3}
    a = rows(spark, [("b", 2), ("a", 1)], "path string, size bigint")
    assert fingerprint(a).first() == fingerprint(a.orderBy("path")).first() and len(fingerprint(a.limit(0)).first()[0]) == 64
    rules = ["target/", "*.tmp", "!keep.tmp", "/top.txt", "a/**/z", "# no"]
    p = rows(spark, [(x,) for x in ["target/x", "src/target/y", "a.tmp", "keep.tmp", "top.txt", "b/top.txt", "a/q/r/z", "src/x.rs"]], "path string")
    assert [r.path for r in p.where(~ignored(F.col("path"), rules)).collect()] == ["keep.tmp", "b/top.txt", "src/x.rs"]


def test_scan_reads_a_folder(spark, tmp_path):
    from quarry.sources.files import scan

    for name, text in {"src/main.rs": "fn main() {}", "tests/a_test.rs": "x", ".gitignore": "target/\n*.tmp\n", "target/x.rs": "no", "a.tmp": "no", "node_modules/m.js": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    out = {r.path: (r.size, r.language, r.role) for r in scan(spark, str(tmp_path)).collect()}
    assert out == {"src/main.rs": (12, "rust", "impl"), "tests/a_test.rs": (1, "rust", "test"), ".gitignore": (14, "other", "config")}


def test_scan_keeps_hidden_names_and_nested_rules(spark, tmp_path):
    from quarry.sources.files import listing, scan

    files = {".gitignore": "target/\n*.tmp\n!keep.tmp\n/top.txt\n", ".github/w.yml": "a", "pkg/__init__.py": "b", "src/__tests__/a.js": "c", "_x/y.go": "d", "keep.tmp": "e", "top.txt": "no", "sub/top.txt": "f", "sub/.ignore": "*.log\n!b.tmp\nown/\n", "sub/a.log": "no", "sub/b.tmp": "g", "sub/own/z": "no", "sub/deep/c.log": "no", "a.log": "h", "target/.gitignore": "!x.rs", "target/x.rs": "no", ".git/info/exclude": "secret*\n", "secret.txt": "no", "empty": "", "deep/" * 9 + "f.rs": "i"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "odd.bin").write_bytes(b"\xff\xfe")
    want = {k: v for k, v in files.items() if v != "no" and not k.startswith(("target/", ".git/"))} | {"odd.bin": None}
    got = {r.path: r for r in scan(spark, str(tmp_path)).collect()}
    assert {k: r.content for k, r in got.items()} == want and got["odd.bin"].size == 2 and len(got["empty"].sha256) == 64
    assert "a.log" not in {r.path for r in listing(spark, f"file://{tmp_path}", more_rules=["*.log"]).collect()}
    assert {"top.txt", "secret.txt", "target/x.rs"} <= {r.path for r in listing(spark, str(tmp_path), rules=[]).collect()}
    (tmp_path / "none").mkdir()
    assert scan(spark, str(tmp_path / "none")).collect() == []


def test_commits_feed_recency(spark, tmp_path):
    import subprocess

    from quarry.operators.scoring import file_recency, recency
    from quarry.sources.files import commit_log

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert commit_log(spark, str(tmp_path)).collect() == []
    git("init")
    for k, names in enumerate((["a.rs", "b c.rs"], ["a.rs"], ["a.rs"])):
        for n in names:
            (tmp_path / n).write_text(str(k))
        git("add", ".")
        git("commit", "-m", "x")
    log = commit_log(spark, str(tmp_path))
    files = spark.createDataFrame([("a.rs",), ("b c.rs",), ("new.rs",)], "path string")
    got = {r.path: round(r.recency, 6) for r in file_recency(files, recency(log)).collect()}
    assert log.count() == 4 and got == {"a.rs": 1.0, "b c.rs": 0.5, "new.rs": 0.0}


def test_fusion_by_candidates_equals_uncut_fusion(spark):
    from quarry.operators.scoring import fuse_scored

    n = 2500
    scored = spark.createDataFrame([(f"p{i:04}", round(1 / (1 + i // 3), 6)) for i in range(n)], "path string, score double").repartition(5)
    other = spark.createDataFrame([(f"p{i:04}", float(i * 1237 % 2503 // 2)) for i in range(n) if i % 11], "path string, pagerank double").repartition(3)
    for least, reach in ((0.005, 341), (0.001, 1941)):
        want = {r.path: round(r.score, 12) for r in fuse_scored(scored, other, "pagerank").collect() if r.score >= least}
        got = {r.path: round(r.score, 12) for r in fuse_scored(scored, other, "pagerank", candidates=reach).collect() if r.score >= least}
        assert got == want and len(want) > 100
