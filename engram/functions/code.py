"""Source files on the executors: rows of functions, classes, imports, calls and chunks.

Python is parsed by the standard library, other languages by ``languages``. Files go by their path's ending.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.languages import Source
from engram.session import tasks
from engram.sources.files import LANGUAGES

# Names whose calls are builtin.
BUILTINS = (
    "print len range str int float bool list dict tuple set frozenset type isinstance issubclass id hash repr abs min max sum all any "
    "enumerate zip map filter sorted reversed open input getattr setattr hasattr delattr vars dir callable super property staticmethod "
    "classmethod object iter next slice round pow divmod hex oct bin chr ord format ascii eval exec compile globals locals memoryview "
    "bytearray bytes complex help exit quit"
).split()
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension)
SYMBOLS = "path string, kind string, name string, qualified string, line long, end_line long, doc string, params array<string>, bases array<string>, decorators array<string>, is_async boolean, is_generator boolean, is_static boolean, is_abstract boolean, is_private boolean, complexity long"
CALLS = "path string, caller string, callee string, receiver string, line long, col long, type string, args long"
PARTS = "path string, kind string, qualified string, line long, end_line long, doc string, body string"
CHUNKS = "path string, kind string, name string, first_line long, last_line long, text string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def language_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1]
    return LANGUAGES.get(ending, LANGUAGES.get(ending.lower(), "unknown"))


def _functions(tree: ast.AST, outer: str = "") -> Iterator[tuple[ast.AST, str]]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            name = f"{outer}.{node.name}" if outer else node.name
            yield node, name
            yield from _functions(node, name)
        else:
            yield from _functions(node, outer)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """What is inside a function, but not inside functions, lambdas or classes within."""
    for x in ast.iter_child_nodes(node):
        if not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            yield x
            yield from _own(x)


def _symbol(path: str, node: ast.AST, name: str) -> dict:
    decorators = [ast.unparse(x) for x in node.decorator_list]
    ends = {d.split("(")[0].rsplit(".", 1)[-1] for d in decorators}
    private = node.name.startswith("_") and not (node.name.startswith("__") and node.name.endswith("__"))
    out = {"path": path, "name": node.name, "qualified": name, "line": node.lineno, "end_line": node.end_lineno, "doc": ast.get_docstring(node), "decorators": decorators, "params": None, "bases": None, "is_async": False, "is_generator": False, "is_static": "staticmethod" in ends, "is_abstract": "abstractmethod" in ends, "is_private": private, "complexity": None}
    if isinstance(node, ast.ClassDef):
        bases = [ast.unparse(b) for b in node.bases]
        return out | {"kind": "class", "bases": bases, "is_abstract": "ABC" in {b.rsplit(".", 1)[-1] for b in bases}}
    a = node.args
    params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
    own = list(_own(node))
    method = params[:1] in (["self"], ["cls"]) or "staticmethod" in ends
    return out | {"kind": "method" if method else "function", "params": params, "is_async": isinstance(node, ast.AsyncFunctionDef), "is_generator": any(isinstance(x, ast.Yield | ast.YieldFrom) for x in own), "complexity": 1 + sum(isinstance(x, _BRANCH) for x in own)}


def _call(path: str, caller: str, x: ast.Call) -> dict:
    f, receiver, kind = x.func, None, "function"
    if isinstance(f, ast.Name):
        name = f.id
        kind = "builtin" if name in BUILTINS else "constructor" if name[:1].isupper() else "function"
    elif isinstance(f, ast.Attribute):
        name, receiver, kind = f.attr, ast.unparse(f.value), "method"
    else:
        name = ast.unparse(f)
    return {"path": path, "caller": caller, "callee": name, "receiver": receiver, "line": x.lineno, "col": x.col_offset, "type": kind, "args": len(x.args) + len(x.keywords)}


def _parse(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


#: Rows, and characters of their files, after which a batch is handed on.
BATCH_ROWS, BATCH_CHARS = 2048, 4 << 20


def dealt(files: DataFrame) -> DataFrame:
    """Files (path, text) dealt to all cores: parsing takes long for few bytes, and splits by size leave it to few tasks."""
    return files.select("path", "text").repartition(tasks(files.sparkSession), "path", "text")


def _rows(files: DataFrame, of: Callable[[str, str], Iterable[dict]], schema: str) -> DataFrame:
    """of(path, text) for each file (path, text); a null text is empty. Batches hold the rows of many files."""
    fields = pa.schema([(n, _KINDS[k]) for n, k in (x.strip().split(" ") for x in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += of(path or "", text or "")
                chars += len(text or "")
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return dealt(files).mapInArrow(run, schema)


def _symbols(path: str, text: str) -> Iterable[dict]:
    if language_of(path) != "python":
        return Source(path, text, language_of(path)).symbols()
    tree = _parse(text)
    return [_symbol(path, n, q) for n, q in _functions(tree)] if tree else []


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of files (path, text): see SYMBOLS. Python's nested ones are named outer.inner; a file that doesn't parse has none."""

    return _rows(files, _symbols, SYMBOLS)


def parts(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of files (path, text) with the lines that are theirs: see PARTS; a file without one is a part as a whole."""

    def of(path: str, text: str) -> Iterator[dict]:
        lines = text.split("\n")
        found = [x for x in _symbols(path, text) if x["kind"] in ("function", "method", "class")]
        for x in found:
            yield {k: x[k] for k in ("path", "kind", "qualified", "line", "end_line", "doc")} | {"body": "\n".join(lines[x["line"] - 1 : x["end_line"]])}
        if not found:
            yield {"path": path, "kind": "file", "qualified": None, "line": 1, "end_line": len(lines), "doc": None, "body": text}

    return _rows(files, of, PARTS)


def imports(files: DataFrame) -> DataFrame:
    """path, module, name (null for a plain import), line of Python files."""

    def of(path: str, text: str) -> Iterator[dict]:
        for n in ast.walk(_parse(text) or ast.Module([], [])) if language_of(path) == "python" else ():
            if isinstance(n, ast.Import):
                yield from ({"path": path, "module": a.name, "name": None, "line": n.lineno} for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                yield from ({"path": path, "module": n.module or "", "name": a.name, "line": n.lineno} for a in n.names)

    return _rows(files, of, "path string, module string, name string, line long")


def syntax(files: DataFrame) -> DataFrame:
    """path, ok, line, message: whether a Python file parses, else where it doesn't."""

    def of(path: str, text: str) -> Iterator[dict]:
        if language_of(path) == "python":
            try:
                ast.parse(text)
                yield {"path": path, "ok": True, "line": None, "message": None}
            except SyntaxError as e:
                yield {"path": path, "ok": False, "line": e.lineno, "message": e.msg}
            except (ValueError, RecursionError, MemoryError) as e:
                yield {"path": path, "ok": False, "line": None, "message": str(e)}

    return _rows(files, of, "path string, ok boolean, line long, message string")


def calls(files: DataFrame) -> DataFrame:
    """Calls inside functions: see CALLS. Those of nested functions count for these alone."""

    def of(path: str, text: str) -> Iterator[dict]:
        if language_of(path) != "python":
            yield from Source(path, text, language_of(path)).calls()
            return
        for n, q in _functions(_parse(text) or ast.Module([], [])):
            if not isinstance(n, ast.ClassDef):
                yield from (_call(path, q, x) for x in _own(n) if isinstance(x, ast.Call))

    return _rows(files, of, CALLS)


def call_graph(found: DataFrame, declared: DataFrame) -> DataFrame:
    """path, name, callees: for each function by its bare name, what it calls by bare names, each once, in order.

    found: rows of ``calls``; declared: rows of ``symbols``. Functions that call nothing have an empty list.
    """
    names = declared.where(F.col("kind").isin("function", "method")).select("path", "name").distinct()
    bare = found.select("path", F.element_at(F.split("caller", "\\.|::"), -1).alias("name"), "callee").groupBy("path", "name").agg(F.sort_array(F.collect_set("callee")).alias("callees"))
    return names.join(bare, ["path", "name"], "left").select("path", "name", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


def call_stats(found: DataFrame) -> DataFrame:
    """path, type, n: how many calls of each type a file has, and under a null type all of them."""
    return found.rollup("path", "type").agg(F.count(F.lit(1)).alias("n")).where("path is not null")


def ast_chunks(files: DataFrame, least_lines: int = 1, lines: int = 20, overlap: int = 5) -> DataFrame:
    """path, kind, name, first_line, last_line, text of Python files: top-level functions and classes, and the imports together.

    Decorators belong to what they decorate. A file that doesn't parse, has no such part or is in another language is
    cut into windows of lines.
    """

    def of(path: str, text: str) -> Iterator[dict]:
        rows = text.split("\n")
        part = lambda a, b: {"path": path, "first_line": a, "last_line": b, "text": "\n".join(rows[a - 1 : b])}
        tree = _parse(text) if language_of(path) == "python" else None
        body = tree.body if tree else []
        heads = [n for n in body if isinstance(n, ast.Import | ast.ImportFrom)]
        found = [part(heads[0].lineno, heads[-1].end_lineno) | {"kind": "imports", "name": "imports"}] if heads else []
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                if n.end_lineno - first + 1 >= least_lines:
                    found.append(part(first, n.end_lineno) | {"kind": "class" if isinstance(n, ast.ClassDef) else "function", "name": n.name})
        if not found and text.strip():
            step = max(lines - overlap, 1)
            starts = range(0, max(len(rows) - lines, 0) + step, step) if len(rows) > lines else (0,)
            found = [part(a + 1, min(a + lines, len(rows))) | {"kind": "lines", "name": f"lines_{a + 1}"} for a in starts if a < len(rows)]
        yield from found

    return _rows(files, of, CHUNKS)
