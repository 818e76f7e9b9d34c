from __future__ import annotations

import statistics

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from engram.functions import code, text
from engram.operators import chunking, codebase, graph, lifecycle, memory, monitor, temporal
from engram.sources import files, tables
from engram.streaming import windows

SAMPLE = """import os
from typing import List


def total(rows, start=0):
    \"\"\"Sum of rows.\"\"\"
    return sum(rows) + start


@cached
class Ledger(Base):
    def __init__(self):
        self.rows = []

    @staticmethod
    def _clean(row):
        return row

    def post(self, row):
        if row and self.rows:
            self.rows.append(total(row))
        return Entry(row)


class Fast(Ledger):
    async def stream(self):
        yield len(self.rows)
"""
PAGE = "# Title\n\nSome **bold** and *thin* text, ~~old~~, with a [link](http://x.org/a) and <http://y.org>.\n\n## Part one ##\n\n- first\n2. second\n> quoted _word_\n\n```python\nx = 1\n```\n\n### Deep\n\nEnd `code` ![](p.png).\n"

try:
    from hypothesis import given, settings
    from hypothesis import strategies as st
except ImportError:
    given = None


def test_merge_small(spark):
    def of(parts, least=5):
        return spark.createDataFrame([(parts,)], "p array<string>").select(chunking.merge_small(F.col("p"), least)).first()[0]

    assert of(["abc", "defghi", "x"]) == ["abcdefghix"]
    assert of(["abcdef", "a", "b", "c"]) == ["abcdef", "abc"]
    assert of(["a"]) == ["a"]
    assert of([]) == []


@pytest.mark.parametrize("n", [0, 1, 512, 513, 974, 975, 2000])
def test_fixed_chunks_cover(spark, n):
    rows = chunking.fixed_chunks(spark.createDataFrame([(1, "é" * n)], "id long, text string"), ["id"]).orderBy("start").collect()
    seen = set()
    for r in rows:
        seen |= set(range(r["start"], r["start"] + len(r["text"])))
    assert seen == set(range(n))
    assert all(b["start"] - a["start"] == 462 for a, b in zip(rows, rows[1:], strict=False))


def test_edits_change_one_version(spark):
    v = tables.versions(spark, DATA)
    row = v.where("version = 1 and valid_to is null").first() or v.where("valid_to is null").first()
    after = temporal.new_version(v, row["memory_id"], -5, "2024-03-01", value=F.lit(9.0))
    assert after.count() == v.count() + 1
    new = after.where("memory_id = -5").first()
    assert (new["version"], new["is_current"], new["value"], new["previous_version_id"]) == (row["version"] + 1, True, 9.0, row["memory_id"])
    old = after.where(F.col("memory_id") == row["memory_id"]).first()
    assert old["valid_to"] == new["valid_from"] and not old["is_current"]
    gone = temporal.soft_delete(v, row["memory_id"], "2024-03-01").where(F.col("memory_id") == row["memory_id"]).first()
    assert gone["valid_to"] is None and gone["transaction_to"] is not None


def test_intervals_hold_one_version_each(spark):
    v = tables.versions(spark, DATA)
    many = v.where(temporal.alive("2024-01-15")).groupBy("file_path").count().where("count > 1")
    assert many.isEmpty()


def test_history_limit(spark):
    with pytest.raises(ValueError):
        temporal.history(tables.versions(spark, DATA), "x", limit=0)


def test_related_uses_no_edge_twice(spark):
    e = spark.createDataFrame([("a", "b", "T", 0.5), ("b", "c", "T", 1.0), ("c", "a", "U", None)], "src string, dst string, type string, strength double")
    got = {(r["id"], r["hops"]): r["strength"] for r in graph.related(e, "a", 2, limit=None).collect()}
    assert got == {("b", 1): 0.5, ("c", 1): 1.0, ("c", 2): 0.75, ("b", 2): 1.0}
    assert {r["id"] for r in graph.related(e, "a", 1, types=["U"]).collect()} == {"c"}
    with pytest.raises(ValueError):
        graph.related(e, "a", 6)


def test_hierarchy_whatever_the_order(spark):
    rows = [("C", ["B"]), ("B", ["A"]), ("A", ["object"]), ("D", []), ("X", ["Y", "A"]), ("Y", ["X"]), ("Z", ["Y"])]
    c = spark.createDataFrame(rows, "name string, bases array<string>")
    got = {r["name"]: (r["depth"], r["n_children"]) for r in graph.class_hierarchy(c).collect()}
    assert got == {"A": (0, 2), "B": (1, 1), "C": (2, 0), "D": (0, 0), "X": (None, 1), "Y": (None, 2), "Z": (None, 0)}
    chain = spark.createDataFrame([(f"k{i}", [f"k{i - 1}"]) for i in range(30)], "name string, bases array<string>")
    assert {r["name"]: r["depth"] for r in graph.class_hierarchy(chain).collect()} == {f"k{i}": i for i in range(30)}
    assert graph.class_hierarchy(chain.limit(0)).count() == 0


def test_write_graph_is_one_document(spark, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    n = spark.createDataFrame([("a", 'A "q" <b> \\ \'', "ORG", 0.5), ("b&", None, "OR<G", None)], "id string, name string, type string, confidence double")
    e = spark.createDataFrame([("a", "b&", "T", 0.5), ("a", "b&", "T", 0.5), ("a", "b&", "is a", None)], "src string, dst string, type string, strength double")

    def text(kind):
        graph.write_graph(n, e, str(tmp_path / kind), kind)
        return "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))

    got = json.loads(text("json"))
    assert {x["id"]: x["properties"].get("name") for x in got["nodes"]} == {"a": 'A "q" <b> \\ \'', "b&": None} and len(got["edges"]) == 3
    got = json.loads(text("cytoscape"))["elements"]
    assert len(got["nodes"]) == 2 and {x["data"]["label"] for x in got["edges"]} == {"T", "is a"}
    root = ET.fromstring(text("graphml"))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f"{ns}key")) == 5 and {x.get("target") for x in root.iter(f"{ns}edge")} == {"b&"}
    assert next(x.text for x in root.iter(f"{ns}data") if x.get("key") == "name") == 'A "q" <b> \\ \''
    lines = text("cypher").strip().splitlines()
    assert len(lines) == 5 and any("[:`is a` {strength: null}]" in x for x in lines) and any('name: "A \\"q\\" <b>' in x for x in lines)


def test_clear_needs_confirmation(spark):
    with pytest.raises(ValueError):
        lifecycle.clear_workspace(None, None, "x")


def test_delete_in_wrong_workspace_does_nothing(spark):
    m = spark.createDataFrame([(1, "en"), (2, "de")], "memory_id long, workspace_id string")
    c = spark.createDataFrame([(1,), (2,)], "memory_id long")
    assert [x.count() for x in lifecycle.delete_memory(m, c, 1, "de")] == [2, 2]
    assert [x.count() for x in lifecycle.delete_memory(m, c, 1, "en")] == [1, 1]


def test_python_source(spark):
    f = spark.createDataFrame([("m.py", SAMPLE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    calls = {(r["caller"], r["callee"], r["type"], r["receiver"]) for r in code.calls(f).collect()}
    assert calls == {("total", "sum", "builtin", None), ("Ledger.post", "append", "method", "self.rows"), ("Ledger.post", "total", "function", None), ("Ledger.post", "Entry", "constructor", None), ("Fast.stream", "len", "builtin", None)}
    s = {r["qualified"]: r for r in code.symbols(f).collect()}
    assert s["Ledger.post"]["complexity"] == 3 and s["total"]["doc"] == "Sum of rows." and s["total"]["params"] == ["rows", "start"]
    assert s["Fast.stream"]["is_async"] and s["Fast.stream"]["is_generator"] and s["Ledger._clean"]["is_static"] and s["Ledger._clean"]["is_private"]
    chunks = [(r["path"], r["kind"], r["first_line"]) for r in code.ast_chunks(f).collect()]
    assert chunks == [("m.py", "imports", 1), ("m.py", "function", 5), ("m.py", "class", 10), ("m.py", "class", 25), ("bad.py", "lines", 1)]
    assert {(r["path"], r["ok"], r["line"]) for r in code.syntax(f).collect()} == {("m.py", True, None), ("bad.py", False, 1), ("none.py", True, None)}
    g = {r["name"]: r["callees"] for r in code.call_graph(code.calls(f), code.symbols(f)).collect()}
    assert g["post"] == ["Entry", "append", "total"] and g["__init__"] == []


def test_other_languages():
    from engram.functions.languages import Source

    ts = """/** A box. */
export abstract class Box<T> extends Base implements A, B {
  constructor(private x: string) { super(); this.init(x); }
  static async make(n: number): Promise<Box> { if (n) { return new Box("a(b"); } return await fetch("x"); }
  get area() { return helper(this.size, [1, 2]); }
}
interface Shape extends Thing { area(): number; }
export function* gen(a, b = 2) { console.log(a); const inner = (z) => foo(z); yield parseInt(b); } // no(call)
"""
    s = Source("a.ts", ts, "typescript")
    by = {x["qualified"]: x for x in s.symbols()}
    assert by["Box"]["bases"] == ["Base", "A", "B"] and by["Box"]["is_abstract"] and by["Box"]["doc"] == "A box." and by["Box"]["end_line"] == 6
    assert by["Box.make"]["is_static"] and by["Box.make"]["is_async"] and by["gen"]["is_generator"] and by["gen"]["params"] == ["a", "b"] and by["Shape"]["kind"] == "interface"
    got = [(x["caller"], x["callee"], x["type"], x["args"]) for x in s.calls()]
    assert got == [("Box.constructor", "init", "method", 1), ("Box.make", "Box", "constructor", 1), ("Box.make", "fetch", "builtin", 1), ("Box.area", "helper", "function", 2), ("gen", "log", "builtin", 1), ("gen", "parseInt", "builtin", 1), ("inner", "foo", "function", 1)]
    go = "package main\n\n// Run runs.\nfunc Run(a int, b string) error {\n\tfmt.Println(a)\n\tx := make([]int, 3)\n\treturn doIt(len(x))\n}\n\ntype Point struct {\n\tX int\n}\n\nfunc (p *Point) move(d int) {\n\tMath.Abs(d)\n}\n"
    s = Source("a.go", go, "go")
    by = {x["qualified"]: x for x in s.symbols()}
    assert by["Run"]["doc"] == "Run runs." and by["Run"]["line"] == 4 and by["Point.move"]["is_private"] and not by["Point"]["is_private"]
    assert [(x["callee"], x["type"]) for x in s.calls()] == [("Println", "method"), ("make", "builtin"), ("doIt", "function"), ("len", "builtin"), ("Abs", "static")]
    rs = "pub struct Point { x: i32 }\ntrait Shape { fn area(&self) -> f64; }\nimpl Shape for Point { fn area(&self) -> f64 { println!(\"{}\", self.x); self.len(1) } }\nimpl Point { pub fn new(x: i32) -> Self { Vec::with_capacity(x); vec![1]; Some(x) } }\n"
    s = Source("a.rs", rs, "rust")
    assert {x["qualified"] for x in s.symbols()} == {"Point", "Shape", "Shape::area", "Point::Shape.area", "Point::new"}
    assert [(x["callee"], x["type"]) for x in s.calls()] == [("println!", "macro"), ("len", "method"), ("with_capacity", "static"), ("vec!", "macro"), ("Some", "constructor")]
    s = Source("a.java", "public class Foo {\n  public int bar(int a) {\n    return baz(a) + this.q(a);\n  }\n}\n", "java")
    assert [(x["kind"], x["name"], x["line"], x["end_line"]) for x in s.symbols()] == [("class", "Foo", 1, 5), ("function", "bar", 2, 4)]
    for broken in ("", "class {", "fn f(", "func (", '"', "function f( {"):
        for language in ("typescript", "go", "rust", "java"):
            x = Source("x", broken, language)
            list(x.symbols()), list(x.calls())


def test_markdown(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "md string")
    got = df.select(text.markdown_sections(F.col("md")), text.markdown_links(F.col("md")), text.markdown_code(F.col("md")), text.markdown_text(F.col("md"))).collect()
    assert [(x["level"], x["title"]) for x in got[0][0]] == [(1, "Title"), (2, "Part one"), (3, "Deep")]
    assert got[0][1] == ["image (p.png)", "link (http://x.org/a)", "http://y.org"]
    assert [(x["language"], x["code"]) for x in got[0][2]] == [("python", "x = 1")]
    assert got[0][3] == "Title\n\nSome bold and thin text, old, with a link (http://x.org/a) and http://y.org.\n\nPart one ##\nfirst\nsecond\nquoted word\n\nx = 1\n\nDeep\n\nEnd code p.png."
    assert got[1][3] is None and got[2][0] == []


def test_html(spark):
    page = """<html><head><title> T </title><meta content='Ann' name="author"><script>var a="</p>";</script></head><body><p>One &amp; <b>two</b>&hellip;</p><A HREF='/x'>l</A><a class="k" href="../y#z">m</a><a href="/x">l</a><a href=mailto:a@b.c>n</a><time datetime="2024-03-01T10:00">t</time></body></html>"""
    got = spark.createDataFrame([(page, "http://h.org/d/e?q")], "h string, u string").select(text.html_text(F.col("h")), text.html_links(F.col("h"), F.col("u")), text.html_title(F.col("h")), text.html_meta(F.col("h"), "author"), text.html_date(F.col("h"))).first()
    assert got[0] == "T One & two … l m l n t" and got[1] == ["http://h.org/x", "http://h.org/y#z", "mailto:a@b.c"] and got[2:] == ("T", "Ann", "2024-03-01")


@pytest.mark.parametrize(("name", "kind", "want"), [
    ("the Python programming language", "TECHNOLOGY", "Python"), ("guido van rossum", "PERSON", "Guido Van Rossum"), ("NASA", "ORG", "NASA"), ("usa", "GPE", "USA"), ("new   york", "GPE", "New York"),
    ("iPhone", "TECHNOLOGY", "iPhone"), ("pandas library", "TECHNOLOGY", "Pandas"), ("Acme Company", "ORG", "Acme"), ("o'neil", "PERSON", "O'Neil"), ("The idea", "CONCEPT", "idea"), ("  ", "ORG", None),
])
def test_entity_names(spark, name, kind, want):
    assert spark.createDataFrame([(name, kind)], "n string, k string").select(text.normalize_entity(F.col("n"), F.col("k"))).first()[0] == want


def test_sanitize(spark):
    for raw, want in (("Hello\x00World", "HelloWorld"), ("  Python   is    great  ", "Python is great"), ("cafe\u0301", "caf\u00e9"), ("a\x7f\tb\n  c\x07 ", "a\x7f\tb\n c"), (None, None)):
        assert spark.createDataFrame([(raw,)], "t string").select(text.sanitize(F.col("t"))).first()[0] == want


def test_dates(spark):
    got = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("no",), (None,)], "t string").select(text.parse_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None]


def test_path_rules(spark):
    paths = ["src/test_a.js", "my_test.py", "src/contest/a.py", "lib/latest.py", "a.spec.ts", "x/__tests__/b.js", "Tests/c.py", "attest/d.py"]
    df = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    assert [r[0] for r in df.select(files.is_test("relative_path")).collect()] == [True, True, True, False, True, True, True, True]
    got = {r[0] for r in df.where(files.ignored("relative_path", ["*.spec.ts", "!b.js", "# x", "Tests/", "latest.py", "attest/*"])).collect()}
    assert got == {"lib/latest.py", "a.spec.ts", "Tests/c.py", "attest/d.py"}
    langs = spark.createDataFrame([(p,) for p in ("a.R", "b.h", "c/Makefile", "d.tsx", "e.xyz", "f.PY")], "p string").select(files.language("p")).collect()
    assert [r[0] for r in langs] == ["r", "cpp", "makefile", "typescript", "unknown", "python"]


def test_model_reply(spark):
    df = spark.createDataFrame([('```json\n[{"name": "A"}]\n```',), ("none",)], "r string")
    got = [r[0] for r in df.select(text.json_array(F.col("r"), "struct<name: string>")).collect()]
    assert got[0][0]["name"] == "A" and not got[1]


def test_scan(spark, tmp_path):
    for name, data in (("src/a.py", b"x = 1\n"), ("src/b.txt", b"t"), ("tests/test_a.py", b"y"), ("build/c.py", b"z"), ("src/l.py", "é".encode("latin-1"))):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {r["relative_path"]: r for r in files.scan(spark, str(tmp_path), languages=["python"], ignore=["build/"]).collect()}
    assert set(got) == {"src/a.py", "src/l.py"} and got["src/l.py"]["text"] == "é" and got["src/a.py"]["lines"] == 2


def test_percentiles_are_exclusive(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "operation string, duration_ms double")
    got = {r["operation"]: r for r in monitor.percentiles(df).collect()}
    q = statistics.quantiles(values, n=100, method="exclusive")
    assert got["a"]["p50"] == pytest.approx(q[49]) and got["a"]["p95"] == pytest.approx(q[94]) and got["b"]["p99"] == 7.0
    both = df.groupBy("operation").agg(F.sort_array(F.collect_list("duration_ms")).alias("v")).select(monitor.exclusive_percentile(F.col("v"), 0.5)).collect()
    assert {r[0] for r in both} == {got["a"]["p50"], 7.0}


def _twin(spark, tmp_path, name, f):
    schema = tables.read(spark, DATA, name).schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}.parquet").load(DATA)
    windows.run_once(f(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    return spark.read.parquet(str(tmp_path / "out")), f(tables.read(spark, DATA, name))


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    got, want = _twin(spark, tmp_path, "events", lambda e: windows.tumbling(e, late="10 minutes"))
    g, w = {tuple(r) for r in got.collect()}, {tuple(r) for r in want.collect()}
    assert g <= w and len(w - g) <= 10  # the last windows stay open behind the watermark


def test_ingest_stream(spark, tmp_path):
    got, want = _twin(spark, tmp_path, "conversations", windows.ingest)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


if given:

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.text("abcXYZ_ 12.", max_size=12), min_size=1, max_size=5))
    def test_tokens_are_lower_case_and_long(spark, texts):
        df = spark.createDataFrame([(x,) for x in texts], "t string").select(text.tokenize(F.col("t")).alias("k"))
        assert all(t == t.lower() and len(t) >= 2 and "_" not in t for r in df.collect() for t in r["k"])


def test_recursive_chunks(spark):
    paragraphs = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(12)) + "." for i in range(9))
    df = spark.createDataFrame([(1, paragraphs), (2, "one"), (3, "  "), (4, None), (5, "x " * 100 + "end")], "id long, text string")
    rows = chunking.recursive_chunks(df, "id", 30, 12, 1).orderBy("id", "chunk_index").collect()
    texts = {1: paragraphs, 2: "one", 5: "x " * 100 + "end"}
    for r in rows:
        assert texts[r["id"]][r["start"] : r["end"]] == r["text"] and len(r["text"].split()) <= 30
    first = [r for r in rows if r["id"] == 1]
    assert {i for r in first for i in range(r["start"], r["end"])} == set(range(len(paragraphs)))
    assert all(a["end"] > b["start"] for a, b in zip(first, first[1:], strict=False))  # whole paragraphs overlap
    assert {r["id"] for r in rows} == {1, 2, 5}
    for bad in ((5, 0, None), (20, 20, None), (20, 5, 30)):
        with pytest.raises(ValueError):
            chunking.checked(*bad)
    assert chunking.checked(512, 50) == 100 and chunking.checked(20, 5) == 4


def test_embedding_falls_back(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    def small(texts):
        if any("worse" in t for t in texts):
            raise RuntimeError("no")
        return [[7.0] for _ in texts]

    df = spark.createDataFrame([("a", "one"), ("b", "bad"), ("c", "bad and worse"), ("d", None)], "key string, text string").coalesce(1)
    got = {r["key"]: r["embedding"] for r in memory.embed_batches(df, model, 2, 32, small).collect()}
    assert got == {"a": [3.0, 1.0], "b": [7.0, 0.0], "c": None, "d": [0.0, 1.0]}


def test_store_and_search(spark):
    rows = [(i, t, "s", ["k"], None, None, "2024-01-01 00:00:00") for i, t in enumerate(["red fish swims", "blue bird flies", "red fish swims", "green tree grows here", " ", None])]
    df = spark.createDataFrame(rows, "memory_id long, text string, source string, tags array<string>, metadata string, workspace_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    cache = spark.createDataFrame([], "key string, embedding array<double>")
    out = memory.add_memories(df, cache)
    assert {r["memory_id"]: r["reason"] for r in out.rejected.collect()} == {4: "blank", 5: "null"}
    assert out.new_vectors.count() == 3 and out.chunks.count() == 4  # a text is embedded once
    again = memory.add_memories(df, out.new_vectors)
    assert again.new_vectors.count() == 0
    m, c = out.memories.cache(), out.chunks.cache()
    v = list(c.where("memory_id = 1").first()["embedding"])
    for mode, want in (("vector", {1}), ("bm25", {1}), ("hybrid", {1}), ("graph", {1})):
        got = memory.search_memory(m, c, "blue bird", ["blue", "bird"], v, 5, mode, least=0.9)
        assert {r["memory_id"] for r in got.collect()} == want, mode
    assert memory.search_memory(m, c, "blue", ["blue"], v, workspace="other").count() == 0
    for bad in ({"query": ""}, {"limit": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            memory.search_memory(**({"memories": m, "chunks": c, "query": "q", "terms": [], "vector": v} | bad))
    m.unpersist(), c.unpersist()


def test_workspaces_and_prune_guard(spark):
    w = spark.createDataFrame([("default", "D", None, None)], "workspace_id string, name string, description string, created_at timestamp_ntz")
    w = memory.create_workspace(w, "a-1", "A", "2024-01-01")
    assert [r["workspace_id"] for r in memory.list_workspaces(w).collect()] == ["default", "a-1"]
    for bad in ("a 1", "a-1", ""):
        with pytest.raises(ValueError):
            memory.create_workspace(w, bad, "x", "2024-01-01")
    with pytest.raises(ValueError):
        memory.delete_workspace(w, None, None, "default", True)
    with pytest.raises(ValueError):
        memory.prune(None, None, None, None, None, "all", dry_run=False)
    with pytest.raises(ValueError):
        memory.ad_hoc(spark, " ")


def test_reindex_marks_what_is_gone(spark):
    f = spark.createDataFrame([("a.py", "def f():\n    pass\n", 10), ("b.md", "text", 4), ("c.go", "package c\n\nfunc Do() {\n}\n", 20)], "relative_path string, text string, size long")
    before, _, _ = codebase.index(f)
    now, _, _ = codebase.index(f.where("relative_path <> 'c.go'"))
    got = {(r["file_path"], r["qualified_name"]): r["stale"] for r in codebase.reindex(before, now).collect()}
    assert got == {("a.py", "f"): False, ("b.md", None): False, ("c.go", "Do"): True}


def test_change_feed_stream(spark, tmp_path):
    v = tables.versions(spark, DATA)
    v.write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "v"))
    windows.run_once(windows.change_feed(stream, "2024-01-10"), str(tmp_path / "out"), str(tmp_path / "check"))
    want = temporal.changes(v, "2024-01-10", limit=None).select("memory_id", "version", "change_type")
    got = spark.read.parquet(str(tmp_path / "out")).select("memory_id", "version", "change_type")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == want.count()


def test_upsert_stream(spark, tmp_path):
    schema = "memory_id string, digest string"
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "check"))
        got = {tuple(r) for r in windows.last_version(spark, str(tmp_path / "t")).collect()}
        assert got == ({("a", "1"), ("b", "1")} if n == 0 else {("a", "1"), ("b", "2"), ("c", "1")})


def test_long_version_chain(spark):
    v = spark.createDataFrame([(i, i + 1, i - 1 if i else None) for i in range(250)] + [(500, 1, 501), (501, 2, 500)], "memory_id long, version long, previous_version_id long")
    got = {r["memory_id"]: r["depth"] for r in temporal.version_chain(v, 249).collect()}
    assert got == {249 - d: d for d in range(250)}
    assert {r["memory_id"] for r in temporal.version_chain(v, 500).collect()} == {500, 501} and temporal.version_chain(v, 999).count() == 0


def test_files_are_dealt_to_all_cores(spark):
    f = spark.createDataFrame([(f"m{i}.py", f"def f{i}():\n    g()\n") for i in range(400)], "path string, text string").coalesce(1)
    for made in (code.symbols(f), code.calls(f), code.ast_chunks(f), code.syntax(f), code.imports(f), code.parts(f)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["path"] for r in code.symbols(f).collect()} == {f"m{i}.py" for i in range(400)}
    one = spark.createDataFrame([("long.py", "".join(f"def f{i}(): pass\n" for i in range(2 * code.BATCH_ROWS + 1)))], "path string, text string")
    assert code.symbols(one).count() == 2 * code.BATCH_ROWS + 1


def test_memories_parse_once(spark):
    rows = [("a.py", "def f():\n    pass\n\nclass C:\n    x = 1\n"), ("b.md", "one\ntwo"), ("c.ts", "interface I { }\n"), ("d.py", "  "), ("e.py", None), ("twice.py", "def f(): 1"), ("twice.py", "def f(): 2")]
    m = codebase.memories(spark.createDataFrame(rows, "relative_path string, text string"))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = sorted((r["file_path"], r["qualified_name"] or "", r["tags"][2], r["first_line"], r["last_line"], r["text"].split("\n", 1)[1]) for r in m.collect())
    assert got == [
        ("a.py", "C", "class", 4, 5, "class C:\n    x = 1"), ("a.py", "f", "function", 1, 2, "def f():\n    pass"), ("b.md", "", "file", 1, 2, "one\ntwo"), ("c.ts", "", "file", 1, 2, "interface I { }\n"),
        ("twice.py", "f", "function", 1, 1, "def f(): 1"), ("twice.py", "f", "function", 1, 1, "def f(): 2"),
    ]


@pytest.mark.parametrize(("page", "want"), [
    ("A&amp B", "A&amp B"), ("x&ampy", "x&ampy"), ("A &amp; B&amp;lt; &#39;&#x41;&eacute;&mdash;", "A & B&lt; 'A\u00e9\u2014"), ("&nosuch; &notit; &not; &", "&nosuch; &notit; \u00ac &"), (None, None),
])
def test_html_references_end_in_semicolons(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(text.html_text(F.col("h"))).first()[0] == want


def test_cooccurrence_parts_grow_with_the_input(spark, tmp_path, monkeypatch):
    rows = [(c, f"e{(c * k) % 7}") for c in range(60) for k in range(4)] * 2
    spark.createDataFrame(rows, "chunk_id long, entity string").coalesce(1).write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    want = {}
    for c in range(60):
        e = sorted({x for d, x in rows if d == c})
        for i, a in enumerate(e):
            for b in e[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for size in (graph.PAIR_BYTES, 40):
        monkeypatch.setattr(graph, "PAIR_BYTES", size)
        for df in (m, spark.createDataFrame(rows, m.schema)):
            got = graph.cooccurrence(df, 3)
            assert {(r["src"], r["dst"]): r["n"] for r in got.collect()} == {k: v for k, v in want.items() if v >= 3}
    assert graph.cooccurrence(m, 3).rdd.getNumPartitions() == graph._parts(m) > 16
