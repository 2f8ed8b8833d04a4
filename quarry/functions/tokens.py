"""Tokenizers as Column expressions: query text, index paths, index content, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that query tokens leave out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "my", "no", "not", "of", "on", "or", "our", "out", "so", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "to", "up", "us", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
]


def _pieces(text: Column, breaks: str) -> Column:
    x = F.regexp_replace(text, breaks, " ")
    x = F.regexp_replace(x, "([^A-Z])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(x, " +"), lambda t: F.lower(t)), lambda t: F.octet_length(t) >= 2)


def query_tokens(text: Column) -> Column:
    """Tokens of a question or a path: split on white space, / \\ . - _ and case; stop words leave; marks stay inside."""
    return F.filter(_pieces(text, r"[\s/\\.\-_]"), lambda t: ~t.isin(STOP_WORDS))


def path_tokens(path: Column) -> Column:
    return _pieces(path, r"[/\\.\-_]")


def content_tokens(text: Column) -> Column:
    """Runs of letters and digits, split on case; stop words stay."""
    return _pieces(text, r"[^\p{L}\p{N}]+")


def identifier_tokens(name: Column) -> Column:
    return _pieces(name, "_")
