"""The path heuristic: five parts of a file's score that need no content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.classify import parts
from quarry.functions.tokens import query_tokens

# Weights, role scores, well-known first folders, size steps.
WEIGHTS = {"keyword": 0.40, "role": 0.25, "depth": 0.15, "wellknown": 0.10, "size": 0.10}
ROLES = {"impl": 1.0, "build": 0.6, "test": 0.5, "config": 0.3, "docs": 0.2, "other": 0.1, "generated": 0.05}
WELL_KNOWN = [
    (["src", "lib", "cmd", "pkg", "app", "internal", "crates"], 1.0), (["bin", "server", "api", "core", "modules"], 0.8), (["test", "tests", "spec", "e2e"], 0.5), (["docs", "doc", "examples", "scripts"], 0.3), (["vendor", "node_modules", "third_party"], 0.0),
]
DEPTHS = [1.0, 0.9, 0.7, 0.5, 0.3]
SIZES = [(1000, 0.9), (5000, 1.0), (20000, 0.8), (100000, 0.5), (500000, 0.2)]


def keyword_part(path: Column, question: list[str]) -> Column:
    if not question:
        return F.lit(0.0)
    own = query_tokens(path)
    return sum((F.when(F.array_contains(own, t), 1.0).otherwise(0.0) for t in question), F.lit(0.0)) / len(question)


def role_part(role: Column) -> Column:
    out = F
    for name, value in ROLES.items():
        out = out.when(role == name, value)
    return out.otherwise(0.1)


def depth_part(path: Column) -> Column:
    n, out = F.size(parts(path)) - 1, F
    for k, value in enumerate(DEPTHS):
        out = out.when(n == k, value)
    return out.otherwise(0.1)


def wellknown_part(path: Column) -> Column:
    first, out = F.element_at(parts(path), 1), F
    for names, value in WELL_KNOWN:
        out = out.when(first.isin(names), value)
    return out.otherwise(0.4)


def size_part(size: Column) -> Column:
    out = F
    for most, value in SIZES:
        out = out.when(size <= most, value)
    return out.otherwise(0.05)


def heuristic_parts(path: Column, role: Column, size: Column, question: list[str]) -> dict[str, Column]:
    return {"keyword": keyword_part(path, question), "role": role_part(role), "depth": depth_part(path), "wellknown": wellknown_part(path), "size": size_part(size)}


def heuristic(path: Column, role: Column, size: Column, question: list[str]) -> Column:
    own = heuristic_parts(path, role, size, question)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((WEIGHTS[k] * own[k] for k in WEIGHTS), F.lit(0.0))))
