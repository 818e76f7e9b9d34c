"""Folders of files as DataFrames: scanning, ignoring, languages, and which reader a file needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages and the endings of their files; of two languages with an ending the later has it.
EXTENSIONS = {
    "python": "py pyw pyi", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "java": "java", "kotlin": "kt kts", "go": "go", "rust": "rs",
    "c": "c h", "cpp": "cpp cc cxx hpp hxx h", "csharp": "cs", "ruby": "rb rake", "php": "php", "swift": "swift", "scala": "scala sc",
    "html": "html htm", "css": "css", "scss": "scss", "json": "json", "yaml": "yaml yml", "xml": "xml",
    "bash": "sh bash", "powershell": "ps1 psm1", "lua": "lua", "perl": "pl pm", "r": "r R",
    "zig": "zig", "nim": "nim", "haskell": "hs", "elixir": "ex exs", "erlang": "erl hrl", "clojure": "clj cljs cljc", "ocaml": "ml mli", "fsharp": "fs fsi fsx",
    "sql": "sql", "graphql": "graphql gql", "toml": "toml", "dart": "dart", "julia": "jl", "v": "v", "solidity": "sol",
}
#: Languages of files without an ending.
NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile"}
LANGUAGES = {x: language for language, endings in EXTENSIONS.items() for x in endings.split()}
#: Parts of a path, in small letters, that tell a test.
TESTS = ("test_", "_test.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts", "__tests__", "tests/", "test/")
#: Endings of files worth indexing, and what is ignored by default.
CODE = "py js ts jsx tsx java go rs cpp c h cs rb php swift kt scala r".split()
IGNORED = "*.pyc *.pyo *.pyd __pycache__ .pytest_cache .mypy_cache node_modules .venv venv env .egg-info dist build .git .gitignore .DS_Store Thumbs.db .vscode .idea".split()
READERS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "md": "markdown", "markdown": "markdown", "py": "python", "html": "html", "htm": "html"}
MOST_BYTES = 10 << 20


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def _lookup(values: dict[str, str], key: Column, default: str | None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def language(path: Column | str) -> Column:
    """By the ending, or the whole name of a file without one; unknown where neither tells."""
    return F.coalesce(_lookup(LANGUAGES, F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1), None), _lookup(LANGUAGES, extension(path), None), _lookup(NAMES, F.substring_index(path, "/", -1), "unknown"))


def reader(path: Column | str) -> Column:
    return _lookup(READERS, extension(path), "text")


def is_test(path: Column | str) -> Column:
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F.lit(False)
    for x in TESTS:
        out |= p.contains(x)
    return out


def ignored(path: str, patterns: list[str]) -> Column:
    """By the patterns of an ignore file; a line with # or a leading ! has no effect.

    Without * and / a pattern is an ending of the path; with / at its end, a folder anywhere; else the path ends with
    what the pattern says, wherever it begins, and * stands for anything.
    """
    out = F.lit(False)
    p = F.col(path)
    for x in (x.strip() for x in patterns):
        if not x or x[0] in "#!":
            continue
        if "*" not in x and "/" not in x:
            out |= p.endswith(x)
        elif x.endswith("/"):
            out |= F.concat(F.lit("/"), p, F.lit("/")).contains("/" + x.rstrip("/") + "/")
        else:
            body = "".join(".*" if c == "*" else "\\" + c if c in ".+?()[]{}|^$\\" else c for c in x)
            out |= p.rlike(f"(?s)^.*{body}$")
    return out


def keep(files: DataFrame, languages: list[str] | None = None, most_bytes: int = MOST_BYTES, tests: bool = False, ignore: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of files (relative_path, size) worth indexing."""
    ok = (F.col("size") <= most_bytes) & ~ignored("relative_path", ignore)
    if languages is not None:
        ok &= language("relative_path").isin(languages)
    if not tests:
        ok &= ~is_test("relative_path")
    return files.where(ok)


def scan(spark: SparkSession, folder: str, **filters) -> DataFrame:
    """path, relative_path, extension, size, lines, text of files that ``keep`` keeps; content is read for these alone."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", "")
    kept = keep(raw.withColumn("relative_path", rel).withColumnRenamed("length", "size"), **filters)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return kept.select("path", "relative_path", extension("path").alias("extension"), "size", F.size(F.split(text, "\n")).cast("long").alias("lines"), text.alias("text"))


def stats(files: DataFrame, by: str = "extension") -> DataFrame:
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
