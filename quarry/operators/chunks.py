"""Chunks of source files: one per line that declares something, by first-match patterns of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.lines import first_match, source_lines

_RUST = r"^(?:pub )*(?:pub\(crate\) )*(?:pub\(super\) )*(?:async )*(?:unsafe )*(?:const )*"
_JS = r"^(?:export )*(?:default )*(?:async )*(?:abstract )*(?:declare )*"
_JAVA = r"^(?:(?:public|private|protected|static|final|abstract|synchronized|native|default) |@[^ ]* +)*+"
_C = r"^(?:template *<[^>]*> *)*(?:static )*(?:inline )*(?:extern )*(?:virtual )*(?:explicit )*"
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", _RUST + r"fn ([^(< ]*)"), ("type", _RUST + r"struct ([^ {<(]*)"), ("type", _RUST + r"enum ([^ {<]*)"), ("type", _RUST + r"trait ([^ {<:]*)"), ("type", _RUST + r"type ([^ =<;]*)"), ("impl", _RUST + r"impl ([^ {<]*)"), ("import", _RUST + r"(use .*)"),
    ],
    "go": [("function", r"^func \([^)]*\)\s*([^( )]*)"), ("function", r"^func ([^( ]*)"), ("type", r"^type ([^ ]*)"), ("import", r"^(import .*)")],
    "python": [("function", r"^(?:async )*def ([^(]*)"), ("type", r"^(?:async )*class ([^(:]*)"), ("import", r"^((?:import|from) .*)")],
    "javascript": [
        ("function", _JS + r"function (?!\*(?:[(< ]|$))([^(< ]*)"), ("type", _JS + r"class ([^ {<]*)"), ("type", _JS + r"interface ([^ {<]*)"), ("type", _JS + r"type ([^ =<]*)"), ("type", _JS + r"enum ([^ {]*)"), ("function", _JS + r"(?:const|let) ([^ =:]*).*(?:=>|function)"), ("import", r"^(import .*)"),
    ],
    "java": [
        ("type", _JAVA + r"(?:class|interface|enum) ([^ {<]*)"), ("type", _JAVA + r"record ([^ (<]*)"), ("function", _JAVA + r"[^(]* (\p{L}[\p{L}\p{N}_]*) *\("), ("import", r"^((?:import|package) .*)"),
    ],
    "ruby": [("function", r"^def (?:self\.)?([^( ;]*)"), ("type", r"^class ([^ <]*)"), ("type", r"^module ([^ ;]*)"), ("import", r"^((?:require|require_relative|include|extend) .*)")],
    "c": [
        ("import", r"^(#include.*)"), ("type", _C + r"(?:struct|class) ([^ {:;]*)"), ("type", _C + r"enum (?:class )?([^ {:;]*)"), ("type", _C + r"union ([^ {;]*)"), ("type", _C + r"namespace ([^ {]*)"), ("type", _C + r"typedef .* (\p{L}[^ ;]*);*$"), ("function", r"^(?:[^(]*[ *])?(\p{L}[\p{L}\p{N}_:]*)[ *]*\("),
    ],
}
RULES["typescript"], RULES["cpp"] = RULES["javascript"], RULES["c"]
#: Lines that are no function, whatever the function pattern says.
NOT_FUNCTIONS = {
    "java": r"^(?:(?:public|private|protected|static|final|abstract|synchronized|native|default) )*(?:(?:if|for|while|switch|return|new) |super\(|this\()", "c": r"^(?:(?:if|for|while|switch|return|case) |else)|^(?:[^(]*[ *])?(?:sizeof|typeof|alignof|defined)[ *]*\(",
}
NOT_FUNCTIONS["cpp"] = NOT_FUNCTIONS["c"]


def chunk_of(line: Column, language: Column) -> Column:
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for name, rules in RULES.items():
        if name in ("typescript", "cpp"):
            continue
        same = language.isin(name, {"javascript": "typescript", "c": "cpp"}.get(name, name))
        # functions need a bracket: without it only the other rules can fit
        text = F.when(line.rlike(NOT_FUNCTIONS[name]), F.translate(line, "(", " ")).otherwise(line) if name in NOT_FUNCTIONS else line
        found = first_match(text, rules)
        out = F.when(same, found).otherwise(out)
    skip = (line == "") | line.startswith("//") | (line.startswith("#") & ~language.isin("c", "cpp"))
    return F.when(~skip, out)


def chunks(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line, end_line: narrow, one pass over the lines; content is not kept."""
    own = source_lines(files.where(F.col("language").isin(list(RULES)))).withColumn("chunk", chunk_of(F.col("line"), F.col("language")))
    return own.where("chunk is not null").select("path", "chunk.kind", "chunk.name", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))
