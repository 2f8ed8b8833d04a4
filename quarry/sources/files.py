"""File tables: folders read through Spark, ignore rules, logs, and a virtual corpus from a documents table."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.classify import estimated_tokens, language, role
from quarry.operators.kept import kept

# Folders that are always skipped.
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", ".env", ".svn", ".hg", ".quarry"]
IGNORE_FILES = (".gitignore", ".ignore")
LOG_SCHEMA = "timestamp string, event string, path string, files_suggested int, tokens_suggested bigint"
# The virtual corpus: folders and extensions dealt out by doc_id.
FOLDERS = ["src/auth", "tests", "docs", "vendor/lib", "crates/core", "a/b/c/d/e", "", "src/net", "lib", "app/models", "scripts/x/y"]
ENDINGS = [".rs", ".py", ".go", ".js", ".md", ".toml", ".java", ".rb", ".c", "_test.go", ".pb.go", ".css", ".txt"]


def ignore_pattern(rule: str) -> tuple[bool, str] | None:
    """(negated, regular expression over relative paths) of one ignore rule; None for blanks and comments."""
    rule = rule.rstrip("\n").rstrip(" ") if not rule.endswith("\\ ") else rule
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return negated, ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits says so."""
    out = F.lit(False)
    for found in map(ignore_pattern, rules):
        if found:
            out = F.when(path.rlike(found[1]), F.lit(not found[0])).otherwise(out)
    return out


def described(files: DataFrame) -> DataFrame:
    """files(path, size, ...) with language, role and tokens."""
    return files.withColumn("language", language(F.col("path"))).withColumn("role", role(F.col("path"))).withColumn("tokens", estimated_tokens(F.col("size")))


def _file_system(root: str):
    """(pyarrow file system, its path of root): local folders, hdfs, s3, gs and what else pyarrow opens."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root.rstrip("/"))
    return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/")


@cache
def _compiled(base: str, rule: str) -> tuple[bool, re.Pattern, str] | None:
    found = ignore_pattern(rule)
    return (found[0], re.compile(found[1] + r"\Z"), base) if found else None


def is_ignored(path: str, folder: bool, rules: list[tuple[str, str]]) -> bool:
    """Whether the last rule (folder of its file, text) that fits this very path says so; folders above were asked before."""
    out = False
    for found in (_compiled(*r) for r in rules):
        if found and path.startswith(found[2]) and found[1].search(path[len(found[2]) :] + "/" * folder):
            out = not found[0]
    return out


def _listed(root: str, own_rules: bool):
    """The entries of each folder of a batch; ignored and skipped folders are not entered, ignored files not listed."""

    def run(batches):
        from pyarrow import fs

        system, base = _file_system(root)
        for batch in batches:
            out: list[tuple] = []
            for folder, told in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                entries = sorted(system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))), key=lambda x: x.base_name)
                rules = [tuple(r) for r in json.loads(told)]
                for x in entries if own_rules else ():
                    if x.base_name in IGNORE_FILES and x.type == fs.FileType.File:
                        with system.open_input_stream(x.path) as f:
                            rules += [(folder, line) for line in f.read().decode("utf-8", "replace").splitlines()]
                for x in entries:
                    path, deeper = folder + x.base_name, x.type == fs.FileType.Directory
                    if (deeper and x.base_name in SKIPPED) or is_ignored(path, deeper, rules):
                        continue
                    out.append((path + "/" if deeper else path, deeper, None if deeper else x.size, json.dumps(rules) if deeper else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["path", "folder", "size", "rules"])

    return run


def _contents(root: str):
    """size, sha256 and text (null if not UTF-8) of each file, a few at a time; a file that has gone meanwhile is left out."""

    def run(batches):
        system, base = _file_system(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(raw)]), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([text], pa.string())], names=["path", "size", "sha256", "content"])

    return run


def listing(spark: SparkSession, root: str, rules: list[str] | None = None, more_rules: list[str] | None = None) -> DataFrame:
    """path, size of the files below root, hidden ones too: a round for each folder level, folders dealt to tasks.

    rules: the only ignore rules; by default each folder's ignore files hold below it, deeper ones last, after more_rules
    (a user's own) and those of .git/info/exclude.
    """
    first = [("", r) for r in (rules if rules is not None else more_rules or [])]
    if rules is None:
        system, base = _file_system(root)
        try:
            with system.open_input_stream(f"{base}/.git/info/exclude") as f:
                first += [("", line) for line in f.read().decode("utf-8", "replace").splitlines()]
        except (FileNotFoundError, NotADirectoryError):
            pass  # no repository
    front, files = spark.createDataFrame([("", json.dumps(first))], "path string, rules string"), []
    while True:
        level = kept(front.mapInArrow(_listed(root, rules is None), "path string, folder boolean, size long, rules string"), "scan")
        files.append(level.where("not folder").select("path", "size"))
        front = level.where("folder").select("path", "rules")
        n = front.count()
        if not n:
            return reduce(DataFrame.union, files)
        front = front.repartition(max(1, min(10_000, n // 64)))


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, more_rules: list[str] | None = None) -> DataFrame:
    """path, size, sha256, content (null if not UTF-8), language, role, tokens of the files of listing().

    Files are read in partitions of about 64 MB by their listed sizes.
    """
    found = listing(spark, root, rules, more_rules)
    parts = 1 + (found.agg(F.sum("size")).first()[0] or 0) // (64 << 20)
    return described(found.select("path").repartition(parts).mapInArrow(_contents(root), "path string, size long, sha256 string, content string"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted path:size lines. The lines meet in one row: it is a digest of a file list."""
    return files.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "size")))), 256).alias("fingerprint"))


def virtual_files(documents: DataFrame) -> DataFrame:
    """A file table from documents(doc_id, text): paths dealt out by doc_id, the text as content."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.pmod("doc_id", F.lit(len(names))).cast("int"))
    word = lambda i: F.lower(F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)", i))
    name = F.concat(word(1), F.initcap(word(2)), F.lit("_"), F.col("doc_id"))
    folder = pick(FOLDERS)
    path = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name, pick(ENDINGS))
    return described(documents.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").alias("content")))


# Lines of code per language that the virtual source files consist of; {a}, {b}: words, {n}: the stem of another file.
TEMPLATES = {
    "rust": ["use crate::{n};", "pub struct {b};", "pub async fn {a}(x: u8) {", "impl {b} {", "// fn no()"],
    "go": ["package main", "import (", '"example.org/{a}/{n}"', ")", "func (r *T) {b}(x int) {", "type {b} struct {", "func {a}() {"],
    "python": ["import {n}", "from .{n} import x", "class {b}(Base):", "async def {a}(self):", "# def no():"],
    "javascript": ["import x from './{n}';", "const y = require('{n}');", "export default class {b} {", "const {a} = (x) => x;", "function {a}2(x) {"],
    "java": ["package org.example;", "import org.example.{n};", "public class {b} {", "private static int {a}(int x) {", "if (x > 0) {"],
    "ruby": ["require '{n}'", "module {b}", "def self.{a}(x)", "class {b}X < Base", "end"],
    "c": ['#include "{n}.h"', "#include <stdio.h>", "static int {a}(int x) {", "struct {b} {", "return f(x);"],
}


def virtual_sources(documents: DataFrame) -> DataFrame:
    """Source files of seven languages made of template lines, with imports of one another (every fifth is external)."""
    endings = {"rust": ".rs", "go": ".go", "python": ".py", "javascript": ".js", "java": ".java", "ruby": ".rb", "c": ".c"}
    names = list(TEMPLATES)
    lang = F.get(F.array(*map(F.lit, names)), F.pmod("doc_id", F.lit(len(names))).cast("int"))
    word = lambda i: F.lower(F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)", i))
    other = F.pmod(F.col("doc_id") * 7 + 3, F.lit(200))
    target = F.when(F.pmod("doc_id", F.lit(5)) == 0, "external").otherwise(F.concat(F.lit("unit"), other))
    text = F
    for name, lines in TEMPLATES.items():
        text = text.when(lang == name, F.lit("\n".join(lines)))
    content = F.replace(F.replace(F.replace(text, F.lit("{a}"), word(1)), F.lit("{b}"), F.initcap(word(2))), F.lit("{n}"), target)
    ending = F
    for name in names:
        ending = ending.when(lang == name, endings[name])
    folder = F.get(F.array(*map(F.lit, FOLDERS)), F.pmod("doc_id", F.lit(len(FOLDERS))).cast("int"))
    path = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("unit"), F.col("doc_id"), ending)
    return documents.select("doc_id", path.alias("path"), lang.alias("language"), content.alias("content"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines log; blank and malformed lines are skipped."""
    x = F.from_json(F.col("value"), LOG_SCHEMA, {"mode": "PERMISSIVE"})
    return spark.read.text(path).select(x.alias("x")).where("x.event is not null").select("x.*")


def commit_log(spark: SparkSession, root: str, days: int | None = 90) -> DataFrame:
    """path, ts of every change in the last days (all, if None), from git; empty if git fails. recency() reads it.

    git's output is written to the driver's memory line by line: a history, not the corpus.
    """
    since = [f"--since={days}.days"] if days is not None else []
    try:
        done = subprocess.run(["git", "-C", root, "log", "--format=%x00%ct", "--name-only", *since], capture_output=True, text=True, check=False)
    except FileNotFoundError:  # no git here
        return spark.createDataFrame([], "path string, ts timestamp")
    rows, ts = [], 0
    for line in done.stdout.splitlines() if done.returncode == 0 else ():
        if line.startswith("\0"):
            ts = int(line[1:])
        elif line.strip():
            rows.append((line.strip(), ts))
    return spark.createDataFrame(rows, "path string, ts long").select("path", F.timestamp_seconds("ts").alias("ts"))
