"""SQL texts that state in another engine's words what the queries of the catalog compute."""

from __future__ import annotations

from quarry.functions import classify as C
from quarry.functions import heuristic as H
from quarry.functions.tokens import STOP_WORDS
from quarry.operators.scoring import B, K1
from quarry.sources import files as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(map(q, values))


def name_of(path: str) -> str:
    return rf"regexp_extract({path}, '[^/\\]*$')"


def parts_of(path: str) -> str:
    return rf"string_split_regex({path}, '[/\\]')"


def ext_of(path: str) -> str:
    return rf"regexp_extract({name_of(path)}, '^.+\.([^.]*)$', 1)"


def language(path: str) -> str:
    return "CASE " + " ".join(f"WHEN {ext_of(path)} IN ({names(v)}) THEN {q(k)}" for k, v in C.EXTENSIONS.items()) + " ELSE 'other' END"


def role(path: str) -> str:
    has = lambda *v: f"list_has_any({parts_of(path)}, [{names(v)}])"
    low = f"lower({name_of(path)})"
    ends = lambda v: "(" + " OR ".join(f"ends_with({low}, {q(e)})" for e in v) + ")"
    return (
        f"CASE WHEN {has('vendor', 'node_modules', 'generated')} OR contains({low}, '.generated.') OR {ends(['.pb.go', '.g.dart'])} THEN 'generated' WHEN {has('tests', '__tests__', 'spec')} OR {ends(C.TEST_ENDINGS)} OR (starts_with({low}, 'test_') AND {ends(['.py', '.rb'])}) THEN 'test' "
        f"WHEN {has('docs')} THEN 'docs' WHEN {name_of(path)} IN ({names(C.BUILD_NAMES)}) THEN 'build' WHEN {ext_of(path)} IN ({names(C.CONFIG_EXTENSIONS)}) OR starts_with({low}, '.env') OR {name_of(path)} IN ({names(C.CONFIG_NAMES)}) THEN 'config' "
        f"WHEN {ext_of(path)} IN ('md', 'mdx', 'rst') THEN 'docs' WHEN {language(path)} IN ({names([*C.PROGRAMMING, 'html', 'css'])}) THEN 'impl' ELSE 'other' END"
    )


def split(text: str, breaks: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace({text}, '{breaks}', ' ', 'g'), '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(string_split_regex({x}, ' +'), lambda z: lower(z)), lambda z: strlen(z) >= 2)"


def query_tokens(text: str) -> str:
    return f"list_filter({split(text, r'[\s/\\.\-_]')}, lambda z: z NOT IN ({names(STOP_WORDS)}))"


def path_tokens(text: str) -> str:
    return split(text, r"[/\\.\-_]")


def content_tokens(text: str) -> str:
    return split(text, r"[^\p{L}\p{N}]+")


def ident_tokens(text: str) -> str:
    return split(text, "_")


WORD = "'([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)'"
_PATH = f"""CASE WHEN f = '' THEN '' ELSE f || '/' END"""
RAW = f"""raw AS (SELECT doc_id, text, lower(regexp_extract(text, {WORD}, 1)) AS w1, lower(regexp_extract(text, {WORD}, 2)) AS w2, [{names(S.FOLDERS)}][doc_id % {len(S.FOLDERS)} + 1] AS f, [{names(S.ENDINGS)}][doc_id % {len(S.ENDINGS)} + 1] AS e FROM documents)"""
PATHS = f"""{RAW}, paths AS (SELECT doc_id, text AS content, {_PATH} || w1 || upper(substr(w2, 1, 1)) || substr(w2, 2) || '_' || doc_id || e AS path, strlen(text) AS size, sha256(text) AS sha256 FROM raw)"""
FILES = f"""{PATHS}, files AS (SELECT *, {language("path")} AS language, {role("path")} AS role, size // 4 AS tokens FROM paths)"""


def with_(body: str, select: str) -> str:
    return f"WITH {body} {select}"


def bm25f_path(question: list[str]) -> str:
    terms = " + ".join(f"ln((total - df{i} + 0.5) / (df{i} + 0.5) + 1) * (5.0 * len(list_filter(t, lambda z: z = {q(w)})) / (5.0 * len(list_filter(t, lambda z: z = {q(w)})) + {K1} * (1 - {B} + {B} * len(t) / average)))" for i, w in enumerate(question)) or "0.0"
    dfs = "".join(f", sum(CASE WHEN list_contains(t, {q(w)}) THEN 1.0 ELSE 0.0 END)::DOUBLE AS df{i}" for i, w in enumerate(question))
    return f"toks AS (SELECT *, {query_tokens('path')} AS t FROM files), stat AS (SELECT count(*)::DOUBLE AS total, avg(len(t)) AS average{dfs} FROM toks), bm AS (SELECT toks.*, {terms} AS bm25f FROM toks, stat)"


def heuristic_parts(question: list[str]) -> dict[str, str]:
    n = f"(len({parts_of('path')}) - 1)"
    case = lambda on, pairs, last: "CASE " + " ".join(f"WHEN {on.format(v)} THEN {s}" for v, s in pairs) + f" ELSE {last} END"
    return {
        "keyword": "((" + " + ".join(f"CASE WHEN list_contains(t, {q(w)}) THEN 1.0 ELSE 0.0 END" for w in question) + f") / {len(question)})::DOUBLE" if question else "0.0", "role": case("role = '{}'", H.ROLES.items(), 0.1),
        "depth": case(n + " = {}", enumerate(H.DEPTHS), 0.1), "wellknown": case(f"{parts_of('path')}[1] IN ({{}})", [(names(v), s) for v, s in H.WELL_KNOWN], 0.4), "size": case("size <= {}", H.SIZES, 0.05),
    }


def heuristic(question: list[str]) -> str:
    return "(" + " + ".join(f"{H.WEIGHTS[k]} * ({v})::DOUBLE" for k, v in heuristic_parts(question).items()) + ")"


def hybrid(question: list[str], wb: float = 0.6, wh: float = 0.4) -> str:
    return f"{FILES}, {bm25f_path(question)}, scored AS (SELECT path, size, language, role, tokens, bm25f, {heuristic(question)} AS heuristic, {wb} * bm25f + {wh} * {heuristic(question)} AS score FROM bm)"


def selected(question: list[str], min_score: float, top: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None) -> str:
    limit = f"ORDER BY score DESC, path LIMIT {top}" if top is not None else ""
    fits = " AND ".join([*([f"cumulative * 4 <= {max_bytes}"] if max_bytes is not None else []), *([f"cumulative <= {max_tokens}"] if max_tokens is not None else [])]) or "true"
    return f"{hybrid(question)}, cut AS (SELECT * FROM scored WHERE score >= {min_score} {limit}), ord AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank, sum(tokens) OVER (ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM cut), sel AS (SELECT * FROM ord WHERE rank = 1 OR ({fits}))"


def sources() -> str:
    langs = list(S.TEMPLATES)
    ends = {"rust": ".rs", "go": ".go", "python": ".py", "javascript": ".js", "java": ".java", "ruby": ".rb", "c": ".c"}
    body = "CASE lang " + " ".join("WHEN {} THEN {}".format(q(k), " || chr(10) || ".join(map(q, v))) for k, v in S.TEMPLATES.items()) + " END"
    return f"""{RAW}, src AS (SELECT *, [{names(langs)}][doc_id % {len(langs)} + 1] AS lang, [{names(ends[k] for k in langs)}][doc_id % {len(langs)} + 1] AS ending, CASE WHEN doc_id % 5 = 0 THEN 'external' ELSE 'unit' || ((doc_id * 7 + 3) % 200) END AS other FROM raw),
sources AS (SELECT doc_id, lang AS language, {_PATH} || 'unit' || doc_id || ending AS path, replace(replace(replace({body}, '{{a}}', w1), '{{b}}', upper(substr(w2, 1, 1)) || substr(w2, 2)), '{{n}}', other) AS content FROM src),
lines AS (SELECT path, language, i AS line_no, trim(x) AS line FROM (SELECT path, language, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM sources))"""


#: What the template lines of each language declare, as line, kind and name (and the name where a text has no two words);
#: written out by hand, not made from the rules.
CHUNKS = {
    "rust": [(1, "import", "use crate::{n};"), (2, "type", "{b};"), (3, "function", "{a}"), (4, "impl", "{b}")],
    "go": [(2, "import", "import ("), (5, "function", "{b}"), (6, "type", "{b}"), (7, "function", "{a}", "{")],
    "python": [(1, "import", "import {n}"), (2, "import", "from .{n} import x"), (3, "type", "{b}"), (4, "function", "{a}")],
    "javascript": [(1, "import", "import x from './{n}';"), (3, "type", "{b}"), (4, "function", "{a}"), (5, "function", "{a}2")],
    "java": [(1, "import", "package org.example;"), (2, "import", "import org.example.{n};"), (3, "type", "{b}"), (4, "function", "{a}")],
    "ruby": [(1, "import", "require '{n}'"), (2, "type", "{b}"), (3, "function", "{a}"), (4, "type", "{b}X")],
    "c": [(1, "import", '#include "{n}.h"'), (2, "import", "#include <stdio.h>"), (3, "function", "{a}", "int"), (4, "type", "{b}")],
}


def chunk_query(lang: str) -> str:
    """Chunks of the template lines; a text without two words leaves names empty, and those are no chunks."""
    word2 = "upper(substr(w2, 1, 1)) || substr(w2, 2)"
    named = lambda t, none=None: (f"CASE WHEN w1 = '' THEN {q(none)} ELSE " if none else "CASE WHEN true THEN ") + f"replace(replace(replace({q(t)}, '{{n}}', other), '{{b}}', {word2}), '{{a}}', w1) END"
    rows = " UNION ALL ".join(f"SELECT sources.path, {q(kind)} AS kind, {named(*t)} AS name, {line} AS start_line, {line} AS end_line FROM sources JOIN src USING (doc_id) WHERE sources.language = {q(lang)}" for line, kind, *t in CHUNKS[lang])
    return f"SELECT * FROM ({rows}) WHERE name <> ''"
