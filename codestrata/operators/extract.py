"""Lexical facts of source text: masked text, definitions, references, imports, bindings, calls.

One pass a file in Arrow batches; the results are rows, so every check is a join
over them (``checks``). Three languages: Go, JavaScript/TypeScript, Python.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import language_tag
from codestrata.session import cpu_tasks

#: Predeclared names that are no reference.
BUILTINS = {
    "go": "append cap clear close complex copy delete imag len make max min new panic print println real recover string int int8 int16 int32 int64"
    " uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 bool byte rune error any",
    "js": "Array Boolean Date Error Function Infinity JSON Map Math NaN Number Object Promise Proxy Reflect RegExp Set String Symbol TypeError WeakMap WeakSet"
    " console parseInt parseFloat isNaN isFinite require setTimeout setInterval setImmediate clearTimeout clearInterval clearImmediate fetch structuredClone queueMicrotask BigInt URL URLSearchParams Buffer process"
    " ArrayBuffer SharedArrayBuffer DataView Atomics Int8Array Uint8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array Float32Array Float64Array BigInt64Array BigUint64Array"
    " AggregateError EvalError RangeError ReferenceError SyntaxError URIError WeakRef FinalizationRegistry Intl WebAssembly globalThis undefined eval decodeURI decodeURIComponent encodeURI encodeURIComponent"
    " escape unescape atob btoa alert confirm prompt requestAnimationFrame cancelAnimationFrame addEventListener removeEventListener dispatchEvent window document navigator location history"
    " AbortController AbortSignal Blob Event EventTarget CustomEvent File FormData Headers Request Response TextDecoder TextEncoder ReadableStream WritableStream TransformStream WebSocket Worker MessageChannel"
    " performance crypto module exports Iterator super this",
    "python": "abs all any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float"
    " format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord pow"
    " print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip __import__ aiter anext exit quit copyright credits license"
    " NotImplemented Ellipsis BaseException BaseExceptionGroup Exception ExceptionGroup ArithmeticError AssertionError AttributeError BlockingIOError BrokenPipeError BufferError BytesWarning ChildProcessError"
    " ConnectionAbortedError ConnectionError ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError EncodingWarning EnvironmentError FileExistsError FileNotFoundError FloatingPointError"
    " FutureWarning GeneratorExit IOError ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError"
    " NotADirectoryError NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError ProcessLookupError PythonFinalizationError RecursionError ReferenceError ResourceWarning RuntimeError"
    " RuntimeWarning StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError TypeError UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError"
    " UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning ZeroDivisionError __name__ __file__ __doc__",
}
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "js": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return"
    " static super switch this throw try typeof var void while with yield constructor",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass"
    " raise return try while with yield match case",
}
_SKIP = {k: frozenset((BUILTINS[k] + " " + KEYWORDS[k]).split()) for k in BUILTINS}

_LITERALS = {
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)*'?"),
    "js": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"),
    "python": re.compile(
        r"\#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
    ),
}


def mask(lang: str, text: str) -> str:
    """The same length with comments and the insides of literals blanked.

    Expressions inside f-strings and templates are kept, as they are code.
    """
    rx = _LITERALS.get(lang)
    if rx is None:
        return text
    code = re.compile(r"\$\{[^{}`]*\}" if lang == "js" else r"(?<!\{)\{[^{}\n]*\}(?!\})")

    def blank(m: re.Match) -> str:
        piece = m[0]
        held = lang == "js" and piece[0] == "`" or lang == "python" and piece[:2].lower().strip("\"'r") == "f"
        out = [c if c == "\n" else " " for c in piece]
        if held:
            for e in code.finditer(piece):
                inner = mask(lang, e[0].lstrip("${")[:-1])
                out[e.end() - 1 - len(inner) : e.end() - 1] = list(inner)
        return "".join(out)

    return rx.sub(blank, text)


def literal_spans(lang: str, text: str) -> list[tuple[int, int]]:
    """Offsets of literals and comments that hold a line end."""
    rx = _LITERALS.get(lang)
    return [m.span() for m in rx.finditer(text) if "\n" in m[0]] if rx else []


_DEFS = {
    "go": re.compile(r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<n>\w+)|^type\s+(?P<t>\w+)", re.M),
    "js": re.compile(r"\b(?:function\s*\*?|class|interface|enum|type)\s+(?P<n>[A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+(?P<t>[A-Za-z_$][\w$]*)"),
    "python": re.compile(r"^[ \t]*(?:async\s+)?(?:def|class)\s+(?P<n>\w+)|^(?P<t>[A-Z][A-Z0-9_]+)\s*(?::[^=\n]+)?=(?!=)", re.M),
}
_DEFS["shell"] = re.compile(r"^[ \t]*(?:function\s+(?P<n>[\w:.-]+)|(?P<t>[\w:.-]+)\s*\(\))", re.M)
_DEFS["rust"] = re.compile(r"\b(?:fn|struct|enum|trait|union|mod)\s+(?P<n>\w+)|\b(?:const|static|type)\s+(?:mut\s+)?(?P<t>\w+)")
_DEFS["ruby"] = re.compile(r"^[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!=]?)|^[ \t]*(?:class|module)\s+(?P<t>[\w:]+)", re.M)
#: Languages of which only definitions are taken.
DEFINITION_ONLY = {".sh": "shell", ".bash": "shell", ".rs": "rust", ".rb": "ruby"}
_LITERALS["shell"] = re.compile(r"(?<![^\s;&|()])\#[^\n]*|'[^']*(?:'|\Z)|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|<<-?\s*(['\"]?)(\w+)\1[^\n]*\n[\s\S]*?(?:^[ \t]*\2$|\Z)", re.M)
_LITERALS["rust"] = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(\#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'(?:[^'\\\n]|\\.)'")
_LITERALS["ruby"] = re.compile(r"\#[^\n{]*|'(?:[^'\\]|\\[\s\S])*(?:'|\Z)|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|<<[~-]([A-Z]\w*)[^\n]*\n[\s\S]*?(?:^[ \t]*\1$|\Z)", re.M)
_CALL = re.compile(r"(?<![\w.$])([A-Za-z_]\w*)\s*(?:\[[\w\s,.*\[\]]*\])?\(")
_CONST = re.compile(r"(?<![\w.])([A-Z][A-Z0-9]*_[A-Z0-9_]*|[A-Z]{3,}[A-Z0-9]*)(?![\w(])")
_QUALIFIED = re.compile(r"(?<![\w.)\]])([A-Za-z_]\w*)\.([A-Za-z_]\w*)")


def definitions(lang: str, masked: str) -> Iterator[tuple[str, int, str]]:
    """(name, offset, receiver type or '')."""
    for m in _DEFS[lang].finditer(masked):
        group = "n" if m["n"] else "t"
        recv = ""
        if lang == "go" and m["recv"]:
            names = re.findall(r"[A-Za-z_]\w*", m["recv"].split("[")[0])
            recv = names[-1] if names else ""
        yield m[group], m.start(group), recv


def references(lang: str, masked: str) -> Iterator[tuple[str, int]]:
    """Bare calls, and constants in capitals in Python; qualified names and builtins are no references."""
    defined = {at for _, at, _ in definitions(lang, masked)}
    for m in _CALL.finditer(masked):
        if m[1] not in _SKIP[lang] and m.start(1) not in defined:
            yield m[1], m.start(1)
    if lang == "python":
        for m in _CONST.finditer(masked):
            if m.start(1) not in defined:
                yield m[1], m.start(1)


_PLAIN_IMPORTS = {
    "shell": re.compile(r"^[ \t]*(?P<word>source|\.)[ \t]+[\"']?(?P<module>[^\s\"';|&]+)", re.M),
    "ruby": re.compile(r"^[ \t]*(?P<word>require(?:_relative)?)[ \t(]+[\"'](?P<module>[^\"'\n]+)[\"']", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?P<word>use)[ \t]+(?P<module>[^;{]+)", re.M),
}
_GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?P<alias>[\w.]+\s+)?"(?P<path>[^"]+)"', re.M)
_GO_BLOCK = re.compile(r"^import\s*\((?P<body>[^)]*)\)|^import\s+(?P<one>[^\n(]+)", re.M)


def imports(lang: str, text: str, masked: str) -> Iterator[tuple[str, int, str]]:
    """(bound name, offset, module)."""
    if lang == "go":
        for block in _GO_BLOCK.finditer(text):
            part = "body" if block["body"] is not None else "one"
            for m in _GO_IMPORT.finditer(block[part]):
                path = m["path"]
                last = path.rsplit("/", 1)[-1]
                if re.fullmatch(r"v\d+", last) and "/" in path:
                    last = path.rsplit("/", 2)[-2]
                yield (m["alias"] or last).strip(), block.start(part) + m.start("path"), path
    elif lang == "python":
        for m in re.finditer(r"^[ \t]*(?:from\s+(?P<mod>[\w.]+)\s+import\s+(?P<names>\([^)]*\)|[^\n]+)|import\s+(?P<plain>[^\n]+))", masked, re.M):
            for item in (m["names"] or m["plain"]).strip("() \n").split(","):
                words = item.split()
                if words:
                    name = words[-1] if len(words) == 3 and words[1] == "as" else words[0] if m["mod"] else words[0].split(".")[0]
                    yield name, m.start(), m["mod"] or words[0]
    elif lang in _PLAIN_IMPORTS:
        for m in _PLAIN_IMPORTS[lang].finditer(text):
            if masked[m.start("word")] != " ":  # not inside a literal or comment
                module = m["module"].strip()
                yield re.split(r"::|/|\s+as\s+", module)[-1].strip("{}; "), m.start("module"), module
    else:
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?P<clause>[^;\n'\"]*?\{[^}]*\}|[^;\n'\"]+?)\s+from\b|\b(?:const|let|var)\s+(?P<req>\{[^}]*\}|\w+)\s*=\s*require\(", masked):
            clause = m["clause"] or m["req"]
            for name in re.findall(r"(?:\bas\s+|:\s*)?([A-Za-z_$][\w$]*)(?=\s*(?:[,}]|$))", clause):
                yield name, m.start(), ""


def bindings(lang: str, text: str, masked: str) -> set[str]:
    """Names bound anywhere in the file besides definitions and imports; over-inclusive."""
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return set(re.findall(r"(?<![\w.])([A-Za-z_]\w*)\s*(?:=(?!=)|:=)", masked)) | set(re.findall(r"\bfor\s+(\w+)", masked))
        out = set()
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                out.add(n.id)
            elif isinstance(n, ast.arg):
                out.add(n.arg)
            elif isinstance(n, ast.ExceptHandler) and n.name:
                out.add(n.name)
        return out
    if lang == "go":
        out = {w for m in re.finditer(r"([\w, \t]+):=", masked) for w in re.findall(r"[A-Za-z_]\w*", m[1])}
        out |= {w for m in re.finditer(r"^\s*(?:var|const)\s+([\w, ]+)", masked, re.M) for w in re.findall(r"[A-Za-z_]\w*", m[1])}
        for m in re.finditer(r"\bfunc\b[^{\n]*", masked):
            out |= set(re.findall(r"([A-Za-z_]\w*)\s+[\w*\[\].]+", m[0]))
        return out - _SKIP["go"]
    out = set()
    for m in re.finditer(r"\(([^()]*)\)\s*(?::[^={;]+)?(?:=>|\{)|\b([A-Za-z_$][\w$]*)\s*=>|\bcatch\s*\((\w+)\)|\b(?:const|let|var)\s*[\[{]([^=]*)[\]}]\s*=", masked):
        out |= set(re.findall(r"[A-Za-z_$][\w$]*", " ".join(g for g in m.groups() if g)))
    return out


def python_calls(text: str) -> Iterator[tuple[str, int, list[str], bool]]:
    """(callee, line, keywords, has star arguments) of calls by bare name; nothing for text that does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            star = any(isinstance(a, ast.Starred) for a in n.args) or any(k.arg is None for k in n.keywords)
            yield n.func.id, n.lineno, [k.arg for k in n.keywords if k.arg], star


def python_signatures(text: str) -> Iterator[tuple[str, int, list[str], bool, bool]]:
    """(name, line, accepted keywords, takes any, decorated) of top-level functions."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [a.arg for a in (*n.args.args, *n.args.kwonlyargs)]
            yield n.name, n.lineno, names, n.args.kwarg is not None, bool(n.decorator_list)


_LINE_END = re.compile("\n")
_BRACKETS = re.compile(r"[][(){}]")
#: Fixed value: deepest nesting of brackets that is looked into.
DEEPEST = 1_000


def too_deep(masked: str) -> bool:
    """Whether brackets nest so deeply that no facts are taken from the text."""
    depth = 0
    for m in _BRACKETS.finditer(masked):
        depth = depth + 1 if m[0] in "([{" else max(0, depth - 1)
        if depth > DEEPEST:
            return True
    return False


_GO_TOP = re.compile(r"^(?:func[ \t]+(?P<func>\w+)[ \t]*[(\[]|(?P<word>type|var|const)[ \t]+(?P<names>\w+(?:[ \t]*,[ \t]*\w+)*)|(?P<block>type|var|const)[ \t]*\()", re.M)
_GO_NAMES = re.compile(r"[ \t]*(\w+(?:[ \t]*,[ \t]*\w+)*)")


def go_exports(text: str) -> set[str] | None:
    """Exported top-level names of a Go file without methods; None where its brackets do not match, so that nothing is known of it."""
    masked = mask("go", text)
    depths, depth = [], 0
    for m in _BRACKETS.finditer(masked):
        depth += 1 if m[0] in "([{" else -1
        if depth < 0:
            return None
        depths.append((m.start(), depth))
    if depth or not re.search(r"^[ \t]*package[ \t]+\w", masked, re.M):
        return None
    starts = [a for a, _ in depths]
    at_depth = lambda k: depths[n - 1][1] if (n := bisect_left(starts, k)) else 0
    found: set[str] = set()
    for m in _GO_TOP.finditer(masked):
        if at_depth(m.start()):
            continue
        if m["block"]:
            end = next((a for a, d in depths[bisect_left(starts, m.end()) :] if d == 0), len(masked))
            at = m.end()
            for row in re.split(r"[\n;]", masked[at:end]):
                if at_depth(at + len(row) - len(row.lstrip())) == 1 and (names := _GO_NAMES.match(row)):
                    found.update(n.strip() for n in names[1].split(","))
                at += len(row) + 1
        else:
            found.update(n.strip() for n in (m["func"] or m["names"]).split(","))
    return {n for n in found if n[:1].isupper()}


def package_exports(files: DataFrame) -> DataFrame:
    """(package, status, name) of Go packages from (package, content), test files left out before.

    A package with a file that cannot be read in full is ``unknown`` and has one row without a
    name: exports that may lack some would make checks report what exists.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for package, content in zip(part["package"], part["content"], strict=True):
                names = go_exports(content)
                rows += [(package, False, None)] if names is None else [(package, True, n) for n in names or [None]]
            yield pd.DataFrame(rows, columns=["package", "whole", "name"])

    types = files.schema["package"].dataType.simpleString()
    rows = files.filter("content is not null").select("package", "content").mapInPandas(run, f"package {types}, whole boolean, name string")
    broken = rows.groupBy("package").agg(F.min("whole").alias("resolved"))
    names = rows.filter("whole").select("package", "name").distinct()
    known = broken.join(names, "package", "left").withColumn("name", F.when(F.col("resolved"), F.col("name")))
    return known.select("package", F.when(F.col("resolved"), "resolved").otherwise("unknown").alias("status"), "name").distinct().filter("status = 'unknown' or name is not null")


_PY_ALL = re.compile(r"^__all__\s*(?::[^=\n]+)?\+?=\s*[\[(](?P<names>[^\])]*)[\])]", re.M)
_JS_EXPORT = re.compile(
    r"\bexport\s+(?:(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|interface|type|enum|const|let|var|namespace)\s+(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?:type\s+)?\{(?P<list>[^}]*)\}|(?P<star>\*)(?:\s+as\s+(?P<as>[\w$]+))?\s+from\b|(?P<default>default)\b)"
)
_GO_TYPE_BODY = re.compile(r"^type\s+(?P<type>\w+)(?:\[[^\]\n]*\])?\s+(?P<kind>struct|interface)\s*\{", re.M)
_GO_MEMBER = re.compile(r"^[ \t]*(?P<names>\w+(?:[ \t]*,[ \t]*\w+)*)(?P<after>[ \t]*\(|[ \t]+[\w*\[\]({.<]|[ \t]*$)", re.M)
_TS_MEMBER = re.compile(r"(?:^|(?<=[;{,]))[ \t]*(?:readonly\s+|static\s+|public\s+|private\s+|protected\s+)*(?P<name>[A-Za-z_$][\w$]*)\??\s*(?P<after>[:(])", re.M)
_TS_BODY = re.compile(r"\binterface\s+(?P<type>[A-Za-z_$][\w$]*)[^{;]*\{")
_LISTED = re.compile(r"[\w$]+(?:\s+as\s+(?P<as>[\w$]+))?")
_BRACE = re.compile(r"[{}]")


def _closing(masked: str, at: int) -> int:
    """Offset of the brace that closes the one before ``at``; the end of the text if none does."""
    depth = 1
    for m in _BRACE.finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(masked)


def _outer(masked: str, start: int, end: int) -> str:
    """The text between two braces with what nested braces hold blanked."""
    out, depth = [], 0
    for c in masked[start:end]:
        depth -= c == "}"
        out.append(c if not depth or c == "\n" else " ")
        depth += c == "{"
    return "".join(out)


def exported(lang: str, text: str, masked: str) -> Iterator[tuple[str, int, str]]:
    """(name, offset, how) of what a file shows to others: ``__all__``, JavaScript exports and wildcards, capital names in Go."""
    if lang == "python":
        for m in _PY_ALL.finditer(text):
            if masked[m.start()] == "_":
                for name in re.finditer(r"[\"']([\w.]+)[\"']", m["names"]):
                    yield name[1], m.start("names") + name.start(1), "all"
    elif lang == "js":
        for m in _JS_EXPORT.finditer(masked):
            if m["list"] is not None:
                for x in _LISTED.finditer(m["list"]):
                    if x[0] != "type":
                        yield x["as"] or x[0], m.start("list") + x.start(), "list"
            elif m["star"]:
                yield m["as"] or "*", m.start("star"), "wildcard"
            else:
                yield (m["name"] or "default"), m.start(), "declaration" if m["name"] else "default"
    elif lang == "go":
        for name in sorted(go_exports(text) or ()):
            at = re.search(rf"\b{re.escape(name)}\b", masked)
            yield name, at.start() if at else 0, "capital"


def members(lang: str, masked: str) -> Iterator[tuple[str, int, str]]:
    """(type.name, offset, field or method) of struct fields and interface members in Go, interface members in TypeScript."""
    opening, member = {"go": (_GO_TYPE_BODY, _GO_MEMBER), "js": (_TS_BODY, _TS_MEMBER)}.get(lang, (None, None))
    if opening is None:
        return
    for t in opening.finditer(masked):
        body = _outer(masked, t.end(), _closing(masked, t.end()))
        for m in member.finditer(body):
            call = m["after"].strip() == "("
            if lang == "go":
                if t["kind"] == "struct" and (call or not m["after"].strip()) or t["kind"] == "interface" and not call:
                    continue
                for name in re.finditer(r"\w+", m["names"]):
                    yield f"{t['type']}.{name[0]}", t.end() + m.start("names") + name.start(), "method" if call else "field"
            else:
                yield f"{t['type']}.{m['name']}", t.end() + m.start("name"), "method" if call else "field"


def signature_hash(lang: str, text: str, at: int) -> str:
    """First 12 hex digits of the SHA-256 of a definition's head: its line from the name to the body, white space folded."""
    end = text.find("\n", at)
    head = text[at : end if end >= 0 else len(text)]
    body = r":\s*(?:\#.*)?$" if lang == "python" else r"\{.*$"
    return hashlib.sha256(" ".join(re.sub(body, "", head).split()).encode("utf-8", "replace")).hexdigest()[:12]


_DOC_MARK = re.compile(r"^\s*(?://[/!]?|\#+|/\*\*?|\*(?!/))\s?|\s*\*/\s*$")
_DOCSTRING = re.compile(r"[^\n]*:[ \t]*\n\s*[rRuU]?(\"{3}|'{3}|\"|')\s*([^\n]*)")


def doc_line(lang: str, text: str, at: int) -> str:
    """First line of the comment that ends on the line above a definition; of the docstring in Python; '' if there is none."""
    if lang == "python":
        m = _DOCSTRING.match(text, at)
        return m[2].split(m[1])[0].strip()[:200] if m else ""
    first = ""
    end = text.rfind("\n", 0, at)
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        line = text[start:end].strip()
        if not line.startswith(("//", "#", "/*", "*")) or line.startswith(("#[", "#!")):
            break
        first = _DOC_MARK.sub("", line).strip() or first
        end = start - 1
    return first[:200]


def file_facts(lang: str, text: str) -> Iterator[tuple[str, str, int, str]]:
    """(fact, name, line, detail) of one file."""
    masked = mask(lang, text)
    if too_deep(masked):
        return
    ends = [m.start() for m in _LINE_END.finditer(masked)]
    line = lambda at: bisect_left(ends, at) + 1
    for name, at, recv in definitions(lang, masked):
        yield "def", name, line(at), recv
        yield "signature_hash", name, line(at), signature_hash(lang, text, at)
        if doc := doc_line(lang, text, at):
            yield "doc", name, line(at), doc
    for name, at, how in exported(lang, text, masked):
        yield "export", name, line(at), how
    for name, at, kind in members(lang, masked):
        yield "member", name, line(at), kind
    if lang in DEFINITION_ONLY.values():
        for name, at, module in imports(lang, text, masked):
            yield "import", name, line(at), module
        return
    for name, at in references(lang, masked):
        yield "ref", name, line(at), ""
    for name, at, module in imports(lang, text, masked):
        yield "import", name, line(at), module
    for name in sorted(bindings(lang, text, masked)):
        yield "binding", name, 0, ""
    for m in _QUALIFIED.finditer(masked):
        yield "qualified", m[2], line(m.start()), m[1]
    if lang == "go":
        for m in re.finditer(r"^func\s+\(\s*(\w+)\s+\*?(\w+)", masked, re.M):
            yield "receiver", m[1], line(m.start()), m[2]
        for m in re.finditer(r"(?<![\w.])(\w+)\s*:?=\s*&?([A-Z]\w*)\{|\bvar\s+(\w+)\s+\*?([A-Z]\w*)\b", masked):
            yield "var_type", m[1] or m[3], line(m.start()), m[2] or m[4]
    if lang == "python":
        for name, at, keywords, star in python_calls(text):
            yield "call", name, at, ("*" if star else "") + ",".join(keywords)
        for name, at, keywords, anything, decorated in python_signatures(text):
            yield "signature", name, at, ("**" if anything or decorated else "") + ",".join(keywords)


def _language(path: Column) -> Column:
    out = language_tag(path)
    for suffix, lang in DEFINITION_ONLY.items():
        out = F.when(path.endswith(suffix), lang).otherwise(out)
    return out


def extract_facts(files: DataFrame) -> DataFrame:
    """(source_id, repo_id, lang, fact, name, line, detail) of every supported file; null content gives none.

    Facts: def, signature_hash, doc, export, member and import of all languages, as far as they have them; ref,
    binding, qualified, receiver, var_type, call and signature of Go, JavaScript, TypeScript and Python. A file whose
    brackets nest deeper than ``DEEPEST`` gives none.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (s, r, lang, *fact)
                for s, r, lang, text in zip(part["source_id"], part["repo_id"], part["lang"], part["content"], strict=True)
                for fact in file_facts(lang, text)
            ]
            yield pd.DataFrame(rows, columns=["source_id", "repo_id", "lang", "fact", "name", "line", "detail"])

    rows = files.filter("content is not null").select("source_id", "repo_id", _language(F.col("path")).alias("lang"), "content").filter("lang <> ''")
    schema = "source_id long, repo_id long, lang string, fact string, name string, line int, detail string"
    return rows.repartition(cpu_tasks(rows), "source_id").mapInPandas(run, schema)


def masked_files(files: DataFrame) -> DataFrame:
    """(source_id, masked)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source_id": part["source_id"], "masked": [mask(lang, t) for lang, t in zip(part["lang"], part["content"], strict=True)]})

    rows = files.filter("content is not null").select("source_id", language_tag(F.col("path")).alias("lang"), "content").filter("lang <> ''")
    return rows.mapInPandas(run, "source_id long, masked string")
