"""Language and role of a path, sizes in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
EXTENSIONS = {
    "rust": ["rs"], "go": ["go"], "python": ["py", "pyi"], "javascript": ["js", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "java": ["java"], "ruby": ["rb"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "shell": ["sh", "bash", "zsh"],
    "markdown": ["md", "mdx"], "yaml": ["yml", "yaml"], "toml": ["toml"], "json": ["json"], "html": ["html", "htm"], "css": ["css", "scss", "sass", "less"], "swift": ["swift"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "haskell": ["hs"], "elixir": ["ex", "exs"],
    "lua": ["lua"], "php": ["php"], "r": ["r", "R"],
}
# Languages that are programmed in, and the names that decide a role.
PROGRAMMING = ["rust", "go", "python", "javascript", "typescript", "java", "ruby", "c", "cpp", "shell", "swift", "kotlin", "scala", "haskell", "elixir", "lua", "php", "r"]
TEST_ENDINGS = ["_test.go", "_test.rs", "_spec.rs", "_spec.rb", "_test.py", ".test.js", ".test.ts", ".test.tsx", ".test.jsx", ".spec.js", ".spec.ts", ".spec.tsx", ".spec.jsx"]
BUILD_NAMES = [
    "Makefile", "makefile", "GNUmakefile", "Cargo.toml", "package.json", "build.rs", "build.gradle", "build.gradle.kts", "pom.xml", "CMakeLists.txt", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Rakefile", "Gemfile", "Justfile", "justfile", "go.mod",
    "go.sum", "setup.py", "setup.cfg", "pyproject.toml", "Pipfile", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "flake.nix",
]
CONFIG_EXTENSIONS = ["yaml", "yml", "toml", "json", "ini", "cfg", "env"]
CONFIG_NAMES = [".gitignore", ".gitattributes", ".editorconfig", ".prettierrc", ".eslintrc", ".babelrc", "tsconfig.json", "rustfmt.toml", "clippy.toml", ".rustfmt.toml", ".clippy.toml", "deny.toml"]
VENDOR_PARTS = ["vendor", "node_modules", "third_party"]


def parts(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one or with a leading one only."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def language(path: Column) -> Column:
    ext, out = extension(path), None
    for name, exts in EXTENSIONS.items():
        out = (F if out is None else out).when(ext.isin(exts), name)
    return out.otherwise("other")


def role(path: Column) -> Column:
    """The first rule that fits: generated, test, docs by folder, build, config, docs by extension, impl, other."""
    all_, name = parts(path), file_name(path)
    low, ext = F.lower(name), extension(path)
    has = lambda *names: F.arrays_overlap(all_, F.array(*map(F.lit, names)))
    ends = lambda endings: F.greatest(*(low.endswith(e) for e in endings))
    return (
        F.when(has("vendor", "node_modules", "generated") | low.contains(".generated.") | ends([".pb.go", ".g.dart"]), "generated")
        .when(has("tests", "__tests__", "spec") | ends(TEST_ENDINGS) | (low.startswith("test_") & ends([".py", ".rb"])), "test")
        .when(has("docs"), "docs").when(name.isin(BUILD_NAMES), "build")
        .when(ext.isin(CONFIG_EXTENSIONS) | low.startswith(".env") | name.isin(CONFIG_NAMES), "config")
        .when(ext.isin("md", "mdx", "rst"), "docs").when(language(path).isin([*PROGRAMMING, "html", "css"]), "impl").otherwise("other")
    )


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, VENDOR_PARTS)))


def estimated_tokens(size: Column) -> Column:
    return F.expr("1").cast("long") * F.floor(size / 4)
