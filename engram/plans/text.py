"""Queries of chunking, cleaning, documents and source code, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import code
from engram.functions import text as fn
from engram.operators import chunking, codebase, graph, lifecycle
from engram.plans.memory import CHUNKS
from engram.sources import files, tables

def _docs(s, d):
    return tables.read(s, d, "documents")


def _pages(s, d):
    return tables.read(s, d, "pages")


def _merged(s, d):
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    m = chunking.merge_small(parts, 100)
    return _docs(s, d).select("doc_id", F.size(m).cast("long").alias("n"), F.sha2(F.array_join(m, "\n"), 256).alias("digest"))


def _listing(s, d):
    """File names made of parts: a listing with every kind of extension."""
    ends = ["py", "ts", "go", "rs", "md", "pdf", "html", "txt", "h"]
    ext = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("p_partkey") % len(ends) + 1).cast("int"))
    top = F.when(F.col("p_partkey") % 4 == 0, F.lit("tests/")).when(F.col("p_partkey") % 5 == 0, F.lit("build/")).otherwise(F.lit("src/"))
    return tables.read(s, d, "part").select(F.concat(top, F.lit("f"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("relative_path"), (F.col("p_size") * 1000).cast("long").alias("size"))


def _validated(s, d):
    v = lifecycle.validate(_docs(s, d).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(F.col("text"))), 20_000)
    return v.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _files(s, d):
    return tables.source_files(s, d)


def _python(s, d):
    return _files(s, d).where("path like '%.py'")


def _classes(s, d):
    """A class for each part, whose base is the one of half its number."""
    k = F.col("p_partkey")
    return tables.read(s, d, "part").select(F.concat(F.lit("C"), k.cast("string")).alias("name"), F.when(k > 1, F.array(F.concat(F.lit("C"), F.floor(k / 2).cast("string")))).otherwise(F.array(F.lit("object"))).alias("bases"))


def _indexed(s, d):
    m, _, _ = codebase.index(_files(s, d), languages=["python", "typescript", "go", "rust"])
    return m.groupBy(F.col("tags")[1].alias("language"), F.col("tags")[2].alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("lines"))


def _delta(s, d):
    """Every tenth file is new, every tenth gone, and in every tenth a function's body is another."""
    f = _files(s, d)
    before = codebase.memories(f.where("key % 10 <> 0"))
    now = codebase.memories(f.where("key % 10 <> 1").withColumn("text", F.when(F.col("key") % 10 == 2, F.replace("text", F.lit("x, 1)"), F.lit("x, 2)"))).otherwise(F.col("text"))))
    return codebase.delta(before, now).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _recursive(s, d):
    c = chunking.recursive_chunks(_docs(s, d), "doc_id", 64, 8)
    return c.select("doc_id", "chunk_index", "start", "end", F.sha2("text", 256).alias("digest"))


QUERIES = {
    "chunk_fixed": lambda s, d: chunking.fixed_chunks(_docs(s, d), ["doc_id"]).select("doc_id", "chunk_index", "start", F.sha2("text", 256).alias("digest")),
    "chunk_merge_small": _merged,
    "chunk_lines": lambda s, d: chunking.line_chunks(_pages(s, d).select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text")), ["page_id"]).select("page_id", "chunk_index", "first_line", "n_lines", F.sha2("text", 256).alias("digest")),
    "token_count_words": lambda s, d: _docs(s, d).select("doc_id", fn.word_count(F.col("text")).alias("n")),
    "sanitize_text": lambda s, d: _docs(s, d).select("doc_id", F.sha2(fn.sanitize(F.concat(F.lit("  "), "text", F.lit("\x07  "))), 256).alias("digest")),
    "validate_split": _validated,
    "text_preview": lambda s, d: _docs(s, d).select("doc_id", fn.preview(F.col("text"), 40).alias("preview")),
    "html_text": lambda s, d: _pages(s, d).select("page_id", fn.html_text(F.col("html")).alias("text")),
    "html_links": lambda s, d: _pages(s, d).select("page_id", F.posexplode(fn.html_links(F.col("html"), F.col("url"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link"),
    "html_metadata": lambda s, d: _pages(s, d).select("page_id", fn.html_title(F.col("html")).alias("title"), fn.html_meta(F.col("html"), "author").alias("author")),
    "lang_script_detect": lambda s, d: _docs(s, d).select(fn.script_language(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "привет").when(F.col("doc_id") % 7 == 0, "日本").otherwise(""))).alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("n")),
    "chunk_recursive": _recursive,
    "text_lines_tidied": lambda s, d: _docs(s, d).select("doc_id", F.sha2(fn.lines_tidied(F.col("text")), 256).alias("digest")),
    "markdown_text": lambda s, d: tables.markdown(s, d).select("doc_id", F.sha2(fn.markdown_text(F.col("md")), 256).alias("digest")),
    "markdown_sections": lambda s, d: tables.markdown(s, d).select("doc_id", F.posexplode(fn.markdown_sections(F.col("md"))).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.level", "x.title", F.sha2("x.content", 256).alias("digest")),
    "markdown_links": lambda s, d: tables.markdown(s, d).select("doc_id", F.posexplode(fn.markdown_links(F.col("md"))).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long")),
    "markdown_code": lambda s, d: tables.markdown(s, d).select("doc_id", F.explode(fn.markdown_code(F.col("md"))).alias("x")).select("doc_id", "x.*"),
    "py_functions": lambda s, d: code.symbols(_python(s, d)).where("kind <> 'class'").select("path", "qualified", "kind", "line", "end_line", "complexity"),
    "py_classes": lambda s, d: code.symbols(_python(s, d)).where("kind = 'class'").select("path", "name", F.array_join("bases", ",").alias("bases"), "line", "end_line"),
    "py_imports": lambda s, d: code.imports(_files(s, d)).select("path", "module", F.coalesce("name", F.lit("-")).alias("name"), "line"),
    "py_calls": lambda s, d: code.calls(_python(s, d)).select("path", "caller", "callee", F.coalesce("receiver", F.lit("-")).alias("receiver"), "line", "col", "type", "args"),
    "py_syntax": lambda s, d: code.syntax(_files(s, d).withColumn("text", F.when(F.col("key") % 8 == 4, F.concat("text", F.lit("def ("))).otherwise(F.col("text")))).groupBy("ok").agg(F.count(F.lit(1)).alias("n")),
    "code_symbols": lambda s, d: code.symbols(_files(s, d)).select("path", "kind", "qualified", "line", "end_line", "is_private"),
    "code_calls": lambda s, d: code.calls(_files(s, d)).select("path", "caller", "callee", "type", "args"),
    "code_call_graph": lambda s, d: code.call_graph(code.calls(_files(s, d)), code.symbols(_files(s, d))).select("path", "name", F.array_join("callees", ",").alias("callees")),
    "code_call_stats": lambda s, d: code.call_stats(code.calls(_files(s, d))).groupBy(F.coalesce("type", F.lit("all")).alias("type")).agg(F.sum("n").alias("n")),
    "codebase_index": _indexed,
    "codebase_delta": _delta,
    "ast_chunks": lambda s, d: code.ast_chunks(_files(s, d)).select("path", "kind", "name", "first_line", "last_line"),
    "class_hierarchy": lambda s, d: graph.class_hierarchy(_classes(s, d)),
    "repo_stats": lambda s, d: files.stats(_listing(s, d).withColumn("language", files.language("relative_path")), "language"),
    "repo_filter": lambda s, d: files.keep(_listing(s, d), ["python", "go", "typescript"], 30_000, ignore=["build/", "*.rs"]),
    "document_dispatch": lambda s, d: _listing(s, d).select(files.reader("relative_path").alias("reader")).groupBy("reader").agg(F.count(F.lit(1)).alias("n")),
}

_PAGE_LINES = "p AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS l FROM pages WHERE length(html) > 0), k AS (SELECT page_id, l, unnest(range(0, greatest(ceil((len(l) - 20) / 15.0), 0)::BIGINT + 1)) AS i FROM p)"
_EXT = "['py', 'ts', 'go', 'rs', 'md', 'pdf', 'html', 'txt', 'h'][p_partkey % 9 + 1]"
_LIST = f"f AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'tests/' WHEN p_partkey % 5 = 0 THEN 'build/' ELSE 'src/' END AS top, 'f' || p_partkey || '.' || {_EXT} AS name, {_EXT} AS ext, (p_size * 1000)::BIGINT AS size FROM part)"

_SRC = "src AS (SELECT p_partkey AS k, p_partkey // 2 AS h, ['py', 'ts', 'go', 'rs'][p_partkey % 4 + 1] AS ext, 'src/m' || p_partkey || '.' || ['py', 'ts', 'go', 'rs'][p_partkey % 4 + 1] AS path FROM part)"
_SYM = """sym AS (SELECT path, 'class' AS kind, 'C' || k AS qualified, CASE ext WHEN 'py' THEN 5 WHEN 'ts' THEN 2 WHEN 'go' THEN 3 ELSE 1 END::BIGINT AS line, CASE ext WHEN 'py' THEN 8 WHEN 'ts' THEN 4 WHEN 'go' THEN 4 ELSE 2 END::BIGINT AS end_line, FALSE AS is_private FROM src
UNION ALL SELECT path, 'method', 'C' || k || CASE ext WHEN 'rs' THEN '::run' ELSE '.run' END, CASE ext WHEN 'py' THEN 6 WHEN 'ts' THEN 3 WHEN 'go' THEN 6 ELSE 5 END, CASE ext WHEN 'py' THEN 8 WHEN 'ts' THEN 3 WHEN 'go' THEN 9 ELSE 8 END, ext = 'go' FROM src
UNION ALL SELECT path, 'function', 'helper' || k, CASE ext WHEN 'ts' THEN 5 ELSE 11 END, CASE ext WHEN 'py' THEN 12 WHEN 'ts' THEN 5 WHEN 'go' THEN 13 ELSE 14 END, ext IN ('go', 'rs') FROM src)"""
_CALLED = """called AS (SELECT path, 'C' || k || CASE ext WHEN 'rs' THEN '::run' ELSE '.run' END AS caller, unnest(['log', 'helper' || k]) AS callee, unnest(['method', 'function']) AS type, unnest([1, 2])::BIGINT AS args FROM src
UNION ALL SELECT path, 'helper' || k, CASE ext WHEN 'ts' THEN 'parseInt' WHEN 'rs' THEN 'println!' ELSE 'len' END, CASE ext WHEN 'rs' THEN 'macro' ELSE 'builtin' END, 1 FROM src
UNION ALL SELECT path, 'helper' || k, 'C' || k, 'constructor', 0 FROM src WHERE ext IN ('py', 'ts'))"""

SQL = {
    "chunk_fixed": f"WITH {CHUNKS} SELECT memory_id AS doc_id, chunk_index, start, sha256(text) AS digest FROM c1",
    "chunk_lines": f"WITH {_PAGE_LINES} SELECT page_id, i AS chunk_index, i * 15 + 1 AS first_line, len(l[i * 15 + 1 : i * 15 + 20])::BIGINT AS n_lines, sha256(array_to_string(l[i * 15 + 1 : i * 15 + 20], chr(10))) AS digest FROM k",
    "token_count_words": "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents",
    "sanitize_text": "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace('  ' || text || chr(7) || '  ', '^\\s+|\\s+$', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), ' {2,}', ' ', 'g')) AS digest FROM documents",
    "text_lines_tidied": "SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM documents",
    "markdown_links": "SELECT doc_id, unnest([0, 1, 2])::BIGINT AS pos, unnest(['pic (p.png)', 'a link (http://x.org/' || doc_id || ')', 'https://y.org/' || doc_id]) AS link FROM documents",
    "markdown_code": "SELECT doc_id, 'python' AS language, 'x = ' || doc_id AS code FROM documents",
    "py_functions": f"WITH {_SRC} SELECT path, 'C' || k || '.run' AS qualified, 'method' AS kind, 6::BIGINT AS line, 8::BIGINT AS end_line, 1::BIGINT AS complexity FROM src WHERE ext = 'py' UNION ALL SELECT path, 'helper' || k, 'function', 11, 12, 1 FROM src WHERE ext = 'py'",
    "py_classes": f"WITH {_SRC} SELECT path, 'C' || k AS name, 'C' || h AS bases, 5::BIGINT AS line, 8::BIGINT AS end_line FROM src WHERE ext = 'py'",
    "py_imports": f"WITH {_SRC} SELECT path, unnest(['os', 'typing']) AS module, unnest(['-', 'List']) AS name, unnest([1, 2])::BIGINT AS line FROM src WHERE ext = 'py'",
    "py_calls": f"WITH {_SRC} SELECT path, unnest(['C' || k || '.run', 'C' || k || '.run', 'helper' || k, 'helper' || k]) AS caller, unnest(['log', 'helper' || k, 'len', 'C' || k]) AS callee, unnest(['self', '-', '-', '-']) AS receiver, unnest([7, 8, 12, 12])::BIGINT AS line, unnest([8, 15, 11, 20])::BIGINT AS col, unnest(['method', 'function', 'builtin', 'constructor']) AS type, unnest([1, 2, 1, 0])::BIGINT AS args FROM src WHERE ext = 'py'",
    "py_syntax": f"WITH {_SRC} SELECT k % 8 <> 4 AS ok, count(*) AS n FROM src WHERE ext = 'py' GROUP BY 1",
    "code_symbols": f"WITH {_SRC}, {_SYM} SELECT path, kind, qualified, line, end_line, is_private FROM sym",
    "code_calls": f"WITH {_SRC}, {_CALLED} SELECT path, caller, callee, type, args FROM called",
    "code_call_graph": f"WITH {_SRC}, {_CALLED} SELECT path, regexp_extract(caller, '[A-Za-z0-9]+$') AS name, string_agg(callee, ',' ORDER BY callee) AS callees FROM called GROUP BY ALL",
    "code_call_stats": f"WITH {_SRC}, {_CALLED} SELECT coalesce(type, 'all') AS type, count(*) AS n FROM called GROUP BY ROLLUP (type)",
    "codebase_index": f"WITH {_SRC}, {_SYM} SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'rust' END AS language, kind, count(*) AS n, sum(end_line - line + 1)::BIGINT AS lines FROM sym JOIN src USING (path) GROUP BY 1, 2",
    "codebase_delta": f"WITH {_SRC}, {_SYM}, c AS (SELECT CASE WHEN k % 10 = 0 THEN 'added' WHEN k % 10 = 1 THEN 'stale' WHEN k % 10 = 2 AND (qualified LIKE '%run' OR (kind = 'class' AND ext IN ('py', 'ts'))) THEN 'changed' ELSE 'kept' END AS change FROM sym JOIN src USING (path)) SELECT change, count(*) AS n FROM c GROUP BY 1",
    "ast_chunks": f"WITH {_SRC} SELECT path, unnest(['imports', 'class', 'function']) AS kind, unnest(['imports', 'C' || k, 'helper' || k]) AS name, unnest([1, 5, 11])::BIGINT AS first_line, unnest([2, 8, 12])::BIGINT AS last_line FROM src WHERE ext = 'py' UNION ALL SELECT path, 'lines', 'lines_1', 1, CASE ext WHEN 'ts' THEN 6 WHEN 'go' THEN 14 ELSE 15 END FROM src WHERE ext <> 'py'",
    "class_hierarchy": "SELECT 'C' || p_partkey AS name, floor(log2(greatest(p_partkey, 1)))::BIGINT AS depth, (SELECT count(*) FROM part q WHERE q.p_partkey > 1 AND q.p_partkey // 2 = p.p_partkey)::BIGINT AS n_children FROM part p",
    "validate_split": "WITH t AS (SELECT CASE doc_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE text END AS text FROM documents) SELECT CASE WHEN text IS NULL THEN 'null' WHEN trim(text) = '' THEN 'blank' WHEN length(text) > 20000 THEN 'too long' WHEN contains(text, chr(1)) THEN 'control' END AS reason, count(*) AS n FROM t GROUP BY 1",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS preview FROM documents",
    "html_links": """WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS r FROM pages), u AS (SELECT page_id, url, unnest(r) AS x, unnest(range(len(r))) AS i FROM l), f AS (SELECT page_id, url, x, min(i) AS i FROM u GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, CASE WHEN regexp_matches(x, '^[a-z]+:') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || x WHEN starts_with(x, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || x ELSE regexp_replace(regexp_extract(url, '^([a-z]+://[^?#]*)', 1), '[^/]*$', '') || x END AS link FROM f""",
    "html_metadata": """SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?is)<meta\\s+name="author"\\s+content="([^"]*)"', 1), '') AS author FROM pages""",
    "html_text": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[A-Za-z/!][^>]*>', ' ', 'g') AS s FROM pages),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&mdash;', '—'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS s FROM a) SELECT page_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS text FROM c""",
    "lang_script_detect": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'ru' WHEN doc_id % 7 = 0 THEN 'zh' ELSE 'en' END AS script, count(*) AS n FROM documents GROUP BY 1",
    "repo_stats": f"WITH {_LIST} SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'html' THEN 'html' WHEN 'h' THEN 'cpp' ELSE 'unknown' END AS language, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1",
    "repo_filter": f"WITH {_LIST} SELECT top || name AS relative_path, size FROM f WHERE top = 'src/' AND ext IN ('py', 'go', 'ts') AND size <= 30000",
    "document_dispatch": f"WITH {_LIST} SELECT CASE ext WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' ELSE 'text' END AS reader, count(*) AS n FROM f GROUP BY 1",
}
