"""Source of TypeScript, JavaScript, Go, Rust and others: declarations and calls by patterns over text without strings and comments.

No grammar is at hand for these languages. Strings and comments are blanked first, so patterns see code alone and places
stay what they are; bodies are found by their brackets. What a pattern doesn't know is left out, never guessed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

# Names whose calls are builtin, by language.
GO_BUILTINS = "append cap close complex copy delete imag len make new panic print println real recover".split()
JS_BUILTINS = "console parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent eval setTimeout setInterval clearTimeout clearInterval fetch require import alert confirm prompt".split()
_NOT_CALLS = frozenset("if for while switch catch return func fn function match loop else do typeof await yield in of with new super go defer range select impl where as unsafe move let const var constructor".split())
_BRACES = {"(": ")", "[": "]", "{": "}"}


def blanked(text: str, language: str) -> str:
    """text with spaces for what stands in strings and comments; the quotes and the line ends stay."""
    quotes = {"go": "\"`'", "rust": '"'}.get(language, "\"'`")
    hash_comments = language not in ("go", "rust", "typescript", "javascript", "java", "c", "cpp", "csharp", "kotlin", "swift", "scala")
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i) or (hash_comments and c == "#"):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in quotes:
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" and not (c == "`" and language == "go") else 1
            blank(i + 1, j)
            i = j + 1
        elif language == "rust" and c == "'" and (m := re.compile(r"'(?:\\.[^']*|[^'\\])'").match(text, i)):
            blank(i + 1, m.end() - 1)
            i = m.end()
        else:
            i += 1
    return "".join(out)


def closing(code: str, at: int) -> int:
    """The place of the bracket that closes the one at a place; the end of the text where none does."""
    depth = 0
    opens, closes = code[at], _BRACES[code[at]]
    for i in range(at, len(code)):
        depth += (code[i] == opens) - (code[i] == closes)
        if not depth:
            return i
    return len(code) - 1


def arguments(inside: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(inside):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and inside[i - 1 : i] not in ("=", "-")))
        if c == "," and depth <= 0:
            out.append(inside[start:i])
            start = i + 1
    return [x.strip() for x in [*out, inside[start:]] if x.strip()]


@dataclass
class Found:
    """A declaration: its place from start to end (exclusive), and where its body begins."""

    kind: str
    name: str
    start: int
    end: int
    body: int
    outer: str = ""
    joint: str = "."
    params: list[str] | None = None
    bases: list[str] | None = None
    marks: set[str] = field(default_factory=set)

    @property
    def qualified(self) -> str:
        return f"{self.outer}{self.joint}{self.name}" if self.outer else self.name


def _callable(code: str, m: re.Match, kind: str, name: str, **more) -> Found | None:
    """A function whose parameters open at the end of a match; without a body its declaration ends where the line does."""
    opens = m.end() - 1
    close = closing(code, opens)
    rest = re.compile(r"[^;{}]*?([;{}]|\n\s*\n|$)", re.S).match(code, close + 1)
    names = [re.sub(r"^(?:\.\.\.|&|mut |public |private |protected |readonly )+", "", re.split(r"[:=?]", p)[0].strip()).split(" ")[0] for p in arguments(code[opens + 1 : close])]
    if rest and rest[1] == "{":
        body = rest.end() - 1
        return Found(kind, name, m.start(), closing(code, body) + 1, body, params=names, **more)
    return Found(kind, name, m.start(), close + 1, close + 1, params=names, **more)


def _block(code: str, m: re.Match, kind: str, **more) -> Found:
    at = m.end() - 1
    end = closing(code, at) + 1 if code[at] == "{" else m.end()
    return Found(kind, m["name"], m.start(), end, at, **more)


_G = r"(?:<[^<>{}()]*(?:<[^<>]*>[^<>{}()]*)*>)?"
_TS = {
    "class": re.compile(rf"(?P<abstract>\babstract\s+)?\bclass\s+(?P<name>[\w$]+)\s*{_G}(?:\s*extends\s+(?P<base>[\w$.]+)\s*{_G})?(?:\s*implements\s+(?P<more>[^{{]+?))?\s*\{{"),
    "interface": re.compile(rf"\binterface\s+(?P<name>[\w$]+)\s*{_G}(?:\s*extends\s+(?P<more>[^{{]+?))?\s*\{{"),
    "enum": re.compile(r"\benum\s+(?P<name>[\w$]+)\s*\{"),
    "type": re.compile(rf"\btype\s+(?P<name>[\w$]+)\s*{_G}\s*="),
}
_TS_FUNCTION = re.compile(rf"(?P<async>\basync\s+)?\bfunction\b\s*(?P<star>\*)?\s*(?P<name>[\w$]+)\s*{_G}\s*\(")
_TS_ARROW = re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+)(?:\s*:[^=;]+)?\s*=\s*(?P<async>async\b\s*)?(?:\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)|(?P<one>[\w$]+))(?:\s*:[^={;]+)?\s*=>\s*")
_TS_METHOD = re.compile(rf"(?:^|[;}}{{\n])\s*(?P<marks>(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|\*)\s*(?=[\s\w$#\[*]))*)(?P<name>[#\w$]+)\s*\??{_G}\s*\(")
_GO_FUNC = re.compile(r"(?m)^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<of>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")
_GO_TYPE = re.compile(r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<what>struct|interface)\s*\{")
_RUST_FN = re.compile(rf"(?P<pub>\bpub(?:\([^)]*\))?\s+)?(?P<marks>(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*)\bfn\s+(?P<name>\w+)\s*{_G}\(")
_RUST_TYPE = re.compile(rf"(?P<pub>\bpub(?:\([^)]*\))?\s+)?\b(?P<what>struct|enum|trait|union)\s+(?P<name>\w+)\s*{_G}(?:\s*:\s*(?P<more>[^{{;(]+))?[^{{;(]*?[{{;(]")
_RUST_IMPL = re.compile(rf"\bimpl\s*{_G}\s*(?:(?P<trait>[\w:]+)\s*{_G}\s+for\s+)?(?P<of>[\w:]+)\s*{_G}[^{{;]*\{{")
_ANY_FUNCTION = re.compile(r"\b(?:function|func|fun|fn|def|sub|proc|method)\s+(?P<name>[A-Za-z_]\w*)\s*\(")
_C_FUNCTION = re.compile(r"(?m)^[ \t]*(?:[A-Za-z_][\w:<>,*&\[\] \t]*?[\s*&])(?P<name>[A-Za-z_]\w*)\s*\((?=[^;{}]*\)[^;{}()]*\{)")
_ANY_TYPE = re.compile(r"\b(?P<what>class|struct|interface|trait|enum|module|protocol|object)\s+(?P<name>[A-Z]\w*)[^{;\n]*(?:\{|\n|;)")


def _typescript(code: str) -> Iterator[Found]:
    for kind, pattern in _TS.items():
        for m in pattern.finditer(code):
            groups = m.groupdict()
            bases = [x.strip() for x in [groups.get("base") or "", *(groups.get("more") or "").split(",")] if x.strip()]
            made = _block(code, m, kind, bases=bases or None, marks={"abstract"} if groups.get("abstract") else set())
            yield made
            if kind == "class":
                inner = code[made.body + 1 : made.end - 1]
                flat = _flat(inner)
                for x in _TS_METHOD.finditer(flat):
                    if x["name"] not in _NOT_CALLS or x["name"] == "constructor":
                        at = re.compile(re.escape(flat[x.start("marks") : x.end()])).match(code, made.body + 1 + x.start("marks"))
                        if at and (f := _callable(code, at, "method", x["name"].lstrip("#"), outer=made.name)) and (f.body < f.end or "abstract" in x["marks"]):
                            f.marks = set(re.findall(r"[a-z]+|\*", x["marks"])) | ({"private"} if x["name"][0] == "#" else set())
                            yield f
    for m in _TS_FUNCTION.finditer(code):
        if f := _callable(code, m, "function", m["name"]):
            f.marks = {k for k, g in (("async", m["async"]), ("*", m["star"])) if g}
            yield f
    for m in _TS_ARROW.finditer(code):
        if code[m.end() : m.end() + 1] == "{":
            end = closing(code, m.end()) + 1
        else:
            end = next((i for i in range(m.end(), len(code)) if code[i] in ";\n"), len(code))
        params = [re.split(r"[:=?]", p)[0].strip() for p in arguments(m["params"] or "")] if m["one"] is None else [m["one"]]
        yield Found("function", m["name"], m.start(), end, m.end(), params=params, marks={"async"} if m["async"] else set())


def _flat(inner: str) -> str:
    """A class body in which what stands in braces is blank."""
    out, depth = list(inner), 0
    for i, c in enumerate(inner):
        if c == "{":
            depth += 1
        if depth and c != "\n" and not (c == "{" and depth == 1):
            out[i] = " "
        if c == "}":
            depth -= 1
            if not depth:
                out[i] = "}"
    return "".join(out)


def _go(code: str) -> Iterator[Found]:
    for m in _GO_TYPE.finditer(code):
        yield _block(code, m, "class" if m["what"] == "struct" else "interface", marks=set() if m["name"][0].isupper() else {"private"})
    for m in _GO_FUNC.finditer(code):
        if f := _callable(code, m, "method" if m["of"] else "function", m["name"], outer=m["of"] or ""):
            f.marks = set() if m["name"][0].isupper() else {"private"}
            yield f


def _rust(code: str) -> Iterator[Found]:
    holders: list[tuple[int, int, str, str]] = []
    for m in _RUST_TYPE.finditer(code):
        kind = {"struct": "class", "union": "class"}.get(m["what"], m["what"])
        made = _block(code, m, kind, bases=[x.strip() for x in (m["more"] or "").split("+") if x.strip()] or None, marks=({"abstract"} if kind == "trait" else set()) | (set() if m["pub"] else {"private"}))
        yield made
        if kind == "trait":
            holders.append((made.body, made.end, m["name"], "::"))
    for m in _RUST_IMPL.finditer(code):
        name = m["of"].rsplit("::", 1)[-1]
        trait = (m["trait"] or "").rsplit("::", 1)[-1]
        holders.append((m.end() - 1, closing(code, m.end() - 1) + 1, f"{name}::{trait}" if trait else name, "." if trait else "::"))
    for m in _RUST_FN.finditer(code):
        holder = next((h for h in sorted(holders, key=lambda h: h[0] - h[1], reverse=True) if h[0] < m.start() < h[1]), None)
        if f := _callable(code, m, "method" if holder else "function", m["name"], outer=holder[2] if holder else "", joint=holder[3] if holder else "."):
            f.marks = set(m["marks"].split()) | (set() if m["pub"] else {"private"}) | ({"static"} if holder and "self" not in f.params else set())
            yield f


def _generic(code: str) -> Iterator[Found]:
    seen = set()
    for m in _ANY_TYPE.finditer(code):
        yield _block(code, m, "class" if m["what"] in ("class", "struct", "object", "module") else m["what"])
    for pattern in (_ANY_FUNCTION, _C_FUNCTION):
        for m in pattern.finditer(code):
            if m["name"] not in _NOT_CALLS and m.start("name") not in seen and (f := _callable(code, m, "function", m["name"])):
                seen.add(m.start("name"))
                yield f


EXTRACTORS = {"typescript": _typescript, "javascript": _typescript, "go": _go, "rust": _rust}


class Source:
    """A file's declarations, in the order of their places."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.text, self.language = path, text, language
        self.code = blanked(text, language)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.found = sorted(EXTRACTORS.get(language, _generic)(self.code), key=lambda f: (f.start, -f.end))

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def _doc(self, f: Found) -> str | None:
        """The comment right above a declaration, without its marks."""
        head = self.text[: f.start].rstrip(" \t")
        head = re.sub(r"(?:export|default|pub(?:\([^)]*\))?|async|abstract|static|public|private|protected|#\[[^\]]*\]|@[\w.]+(?:\([^)]*\))?)\s*$", "", head)
        m = re.search(r"(/\*\*(?:(?!\*/).)*\*/|(?:^[ \t]*//[^\n]*\n)+)\s*\Z", head, re.S | re.M)
        if not m:
            return None
        lines = [re.sub(r"^\s*(?:/\*\*?|\*/|\*|//[/!]?)\s?|\s*\*/\s*$", "", x).strip() for x in m[1].splitlines()]
        return "\n".join(lines).strip() or None

    def symbols(self) -> Iterator[dict]:
        for f in self.found:
            own = self.code[f.body : f.end]
            branches = len(re.findall(r"\b(?:if|for|while|case|catch|match)\b|&&|\|\||\?(?![.?:])", own))
            runs = f.kind in ("function", "method")
            yield {
                "path": self.path, "kind": f.kind, "name": f.name, "qualified": f.qualified, "line": self.line(f.start + len(self.code[f.start : f.end]) - len(self.code[f.start : f.end].lstrip())), "end_line": self.line(max(f.end - 1, f.start)),
                "doc": self._doc(f), "params": f.params, "bases": f.bases, "decorators": [], "is_async": "async" in f.marks, "is_generator": "*" in f.marks, "is_static": "static" in f.marks,
                "is_abstract": "abstract" in f.marks, "is_private": bool(f.marks & {"private", "protected"}), "complexity": 1 + branches if runs else None,
            }

    def calls(self) -> Iterator[dict]:
        """Calls inside functions; those of functions within count for these alone."""
        runs = [f for f in self.found if f.kind in ("function", "method") and f.end > f.body]
        for f in runs:
            inner = [(g.start, g.end) for g in runs if f.body < g.start and g.end <= f.end]
            for m in _CALL.finditer(self.code, f.body, f.end):
                if not any(a <= m.start() < b for a, b in inner) and (made := self._call(m)):
                    opens = m.end() - 1
                    args = len(arguments(self.code[opens + 1 : closing(self.code, opens)]))
                    line = self.line(m.start("path"))
                    yield {"path": self.path, "caller": f.qualified, "callee": made[0], "receiver": made[2], "line": line, "col": m.start("path") - self.lines[line - 1], "type": made[1], "args": args}

    def _call(self, m: re.Match) -> tuple[str, str, str | None] | None:
        """Callee, type of the call and receiver."""
        parts = re.split(r"\?\.|\.|::", m["path"])
        name, receiver = parts[-1], m["path"][: len(m["path"]) - len(parts[-1])].rstrip(".:?") or None
        if name in _NOT_CALLS or (receiver is None and name in _NOT_CALLS):
            return None
        if self.language in ("typescript", "javascript"):
            if m["new"]:
                return name, "constructor", receiver
            if receiver:
                return name, "builtin" if receiver == "console" else "method", receiver
            return name, "builtin" if name in JS_BUILTINS else "constructor" if name[0].isupper() else "function", None
        if self.language == "go":
            if receiver:
                return name, "method" if receiver[0].islower() else "static", receiver
            return name, "builtin" if name in GO_BUILTINS else "constructor" if name[0].isupper() else "function", None
        if self.language == "rust":
            if m["bang"]:
                return f"{name}!", "macro", None
            if receiver:
                return name, "static" if "::" in m["path"][len(receiver) :] else "method", receiver
            return name, "constructor" if name[0].isupper() else "function", None
        return name, "method" if receiver else "constructor" if name[0].isupper() else "function", receiver


_CALL = re.compile(r"(?P<new>\bnew\s+)?(?<![\w$.:#])(?P<path>[A-Za-z_$][\w$]*(?:(?:\?\.|\.|::)[A-Za-z_$][\w$]*)*)(?:(?P<bang>!)\s*[(\[{]|\s*(?:::)?(?:<[\w$,.:&\s]*>)?\()")
