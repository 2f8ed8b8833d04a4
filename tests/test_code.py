import pytest

from quarry.operators.chunks import chunks
from quarry.operators.graph import graph_counts, impact, normalised, pagerank
from quarry.operators.imports import import_edges, imports, resolve


def one(spark, language, *lines):
    return spark.createDataFrame([("f", language, "\n".join(lines))], "path string, language string, content string")


def found(spark, language, *lines):
    return [(r.kind, r.name, r.start_line) for r in chunks(one(spark, language, *lines)).orderBy("start_line").collect()]


def raws(spark, language, *lines):
    return [r.raw for r in imports(one(spark, language, *lines)).orderBy("line_no").collect()]


def test_chunks(spark):
    assert found(spark, "rust", "pub(crate) async fn go<T>(x: T) {", "// fn no()", "impl Foo {", "impl<T> Bar<T> {", "pub use a::b;", "pub enum E{") == [("function", "go", 1), ("impl", "Foo", 3), ("import", "use a::b;", 5), ("type", "E", 6)]
    assert found(spark, "go", "func (s *Server) Run(ctx) error {", "func main() {", "type T struct {", "import (") == [("function", "Run", 1), ("function", "main", 2), ("type", "T", 3), ("import", "import (", 4)]
    assert found(spark, "python", "async def f(x):", "class A(B):", "# def no():", "from a import b") == [("function", "f", 1), ("type", "A", 2), ("import", "from a import b", 4)]
    assert found(spark, "typescript", "export default async function go(x) {", "const f = (x) => x", "let n = 3", "export interface I {", "function *gen()", "function * no()", "function* no2()") == [("function", "go", 1), ("function", "f", 2), ("type", "I", 4), ("function", "*gen", 5)]
    assert found(spark, "java", "public static void main(String[] a) {", "@Override public int size() {", "if (x) {", "return f(x);", "public final class A {", "import a.B;") == [("function", "main", 1), ("function", "size", 2), ("type", "A", 5), ("import", "import a.B;", 6)]
    assert found(spark, "ruby", "def self.make(x)", "class A < B", "module M", "require 'x'") == [("function", "make", 1), ("type", "A", 2), ("type", "M", 3), ("import", "require 'x'", 4)]
    assert found(spark, "cpp", "#include <a.h>", "static int *get(int x) {", "class A : public B {", "return f(x);", "namespace n {") == [("import", "#include <a.h>", 1), ("function", "get", 2), ("type", "A", 3), ("type", "n", 5)]
    assert found(spark, "java", "public Foo(int x) {", "Foo() {", "@Inject public Foo(Bar b) {", "protected abstract Map<K, V> all ();", "public @interface Mark {", "foo.bar(x);", "int 9x(") == [("function", "all", 4)]  # an annotation type begins like an annotation, which is left out
    assert found(spark, "c", "foo->bar(x);", "o.call(z);", "_helper(1);", "void _own(int);", "char **names(void);", "x = sizeof(int);", "std::string A::b(int c)", "static inline int f2((x))", "main ()", "else if (x) {") == [("function", "names", 5), ("function", "A::b", 7), ("function", "f2", 8), ("function", "main", 9)]
    assert found(spark, "haskell", "main = x") == []


def test_imports(spark):
    assert raws(spark, "rust", "use crate::auth::X;", "use std::x;", "mod db;", "pub mod no;") == ["auth", "db"]
    assert raws(spark, "python", "import os, sys", "from .a import b") == ["os,", ".a"]
    assert raws(spark, "javascript", 'import x from "./a";', "const y = require('b')") == ["./a", "b"]
    assert raws(spark, "go", 'import "fmt"', "import (", '"a/b"', 'x "c/d"', ")", "func f() {") == ["fmt", "a/b", 'x "c/d']
    assert raws(spark, "java", "import static a.B.c;", "import x.Y;") == ["a.B.c", "x.Y"]
    assert raws(spark, "c", '#include "a/b.h"', "#include <c.h>") == ["a/b.h"]
    assert raws(spark, "ruby", "require 'a'", 'require_relative "../b"') == ["a", "../b"]
    assert raws(spark, "swift", "@testable import A", "import class B.C") == ["A", "B"]
    assert raws(spark, "elixir", "alias A.B, as: C", "use x") == ["A.B"]
    assert raws(spark, "php", "use A\\B as C;", "use D;", "require_once 'x.php';") == ["A\\B", "x.php"]
    assert raws(spark, "scala", "import a.b.{C, D}") == ["a.b"]
    assert raws(spark, "r", "library(x)", 'source("y.R")') == ["x", "y.R"]
    assert raws(spark, "shell", "source ./a.sh", '. "$X/b.sh"', ". c.sh") == ["./a.sh", "c.sh"]


def test_resolution_prefers_and_falls_back(spark):
    paths = spark.createDataFrame([(p,) for p in ["api/core/v1/types.go", "api/apps/v1/types.go", "src/utils.ts", "lib/utils.ts", "inc/b.h", "src/b.h", "pkg/mod.rs", "a/auth/handler.ex"]], "path string")

    def targets(importer, language, raw):
        asked = spark.createDataFrame([(importer, language, 1, raw)], "path string, language string, line_no int, raw string")
        return sorted(r.target for r in resolve(asked, paths).collect())

    assert targets("x.go", "go", "k8s/api/core/v1") == ["api/core/v1/types.go"]
    assert targets("x.go", "go", "k8s/other/v1") == ["api/apps/v1/types.go", "api/core/v1/types.go"]
    assert targets("src/h.ts", "typescript", "./utils") == ["lib/utils.ts", "src/utils.ts"]
    assert targets("inc/a.c", "c", "b.h") == ["inc/b.h"] and targets("zzz/a.c", "c", "b.h") == ["inc/b.h", "src/b.h"]
    assert targets("m.rs", "rust", "pkg") == ["pkg/mod.rs"] and targets("m.ex", "elixir", "My.Handler.None") == ["a/auth/handler.ex"] and targets("m.py", "python", "os") == []


def test_pagerank_drops_dangling_mass(spark):
    e = spark.createDataFrame([("main", "auth"), ("main", "db"), ("auth", "utils"), ("db", "utils")], "src string, dst string")
    raw = {r.path: r.rank for r in pagerank(e).collect()}
    assert raw == pytest.approx({"main": 0.0375, "auth": 0.0534375, "db": 0.0534375, "utils": 0.128344}, abs=1e-6)
    assert {r.path: round(r.pagerank, 6) for r in normalised(pagerank(e)).collect()}["main"] == 0.292184
    assert graph_counts(e).first() == (4, 4)
    assert {r.path: r.hops for r in impact(e, "utils", 2).collect()} == {"utils": 0, "auth": 1, "db": 1, "main": 2}


def test_edges_leave_vendored_files_and_self_imports_out(spark):
    f = spark.createDataFrame([("src/a.rs", "rust", "mod b;\nmod a;"), ("src/b.rs", "rust", ""), ("vendor/b.rs", "rust", "mod a;")], "path string, language string, content string")
    assert [tuple(r) for r in import_edges(f).collect()] == [("src/a.rs", "src/b.rs")]
