"""Languages by file extension: parse a whole text, report failure or definitions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from codestrata.llm.peg import golang, javascript, python, ruby, rust, shell
from codestrata.llm.peg.engine import Grammar

#: Extensions and their languages.
EXTENSIONS = {
    ".go": "go", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".sh": "shell", ".bash": "shell", ".rs": "rust", ".rb": "ruby",
}

_GRAMMARS: dict[str, tuple[Grammar, Callable]] = {
    "go": (golang.GRAMMAR, golang.layout),
    "python": (python.GRAMMAR, python.layout),
    "javascript": (javascript.GRAMMAR, javascript.layout),
    "typescript": (javascript.TYPED, javascript.layout),
    "shell": (shell.GRAMMAR, shell.layout),
    "rust": (rust.GRAMMAR, rust.layout),
    "ruby": (ruby.GRAMMAR, ruby.layout),
}
_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t].*)?$")
_NAME = {
    "ruby": re.compile(r"[\w:]+[?!=]?|\[\]=?|[^\s\w(]+"),
    "shell": re.compile(r"[^\s()]+"),
}
_PLAIN_NAME = re.compile(r"[#]?[\w$]+")
_SPLIT_CALLS = re.compile(r"\r\n?")


@dataclass
class Definition:
    """A function or method with a body, in offsets of the normalised text."""

    name: str
    path: str
    start: int
    docstring: str | None = None
    #: where its decorators begin, if it has any before it
    head: int | None = None


@dataclass
class FileParse:
    """``ok`` is None where the text is nested too deeply to tell."""

    ok: bool | None
    line: int = 0
    column: int = 0
    cause: str = ""
    definitions: list[Definition] = field(default_factory=list)


def normalise(content: str) -> str:
    """Without a leading byte order mark and with plain line ends; both are valid everywhere."""
    content = content[1:] if content.startswith("\ufeff") else content
    return _SPLIT_CALLS.sub("\n", content)


def _laid(language: str, text: str) -> tuple[str, list[int]]:
    laid = _GRAMMARS[language][1](text)
    return laid if isinstance(laid, tuple) else (laid, [])


def _original(at: int, inserted: list[int]) -> int:
    low, high = 0, len(inserted)
    while low < high:
        mid = (low + high) // 2
        if inserted[mid] < at:
            low = mid + 1
        else:
            high = mid
    return at - low


def _cause(language: str, text: str, at: int) -> str:
    """conflict, truncated, extension (valid in another language) or syntax."""
    head = text.rfind("\n", 0, at) + 1
    tail = text.find("\n", at)
    around = text[max(0, head - 40) : len(text) if tail < 0 else tail]
    if _MARKER.search(around):
        return "conflict"
    for other in _GRAMMARS:
        if other not in (language, "shell") and {language, other} != {"javascript", "typescript"}:
            if _GRAMMARS[other][0].accepts(_laid(other, text)[0]):
                return "extension"
    if not text[at:].strip():
        return "truncated"
    return "syntax"


def _definitions(language: str, laid: str, captures: tuple, inserted: list[int]) -> list[Definition]:
    found: list[Definition] = []
    stack: list[dict] = []
    heads = {end: start for kind, start, end in captures if kind == "deco" and start < end}

    def close(node: dict) -> None:
        if node["kind"] == "cls":
            return
        if node["name"] and node["body"]:
            own = node["name"]
            around = [n["name"] for n in stack if n["name"]]
            path = ".".join([*around, *([node["owner"]] if node["owner"] else []), own])
            head = heads.get(node["start"])
            found.append(Definition(own, path, _original(node["start"], inserted), node["doc"], None if head is None else _original(head, inserted)))

    for kind, start, end in captures:
        while stack and start >= stack[-1]["end"]:
            node = stack.pop()
            close(node)
        if kind in ("fn", "arrow", "cls"):
            stack.append({"kind": kind, "start": start, "end": end, "name": "", "body": False, "owner": "", "doc": None})
            continue
        if not stack:
            continue
        node, piece = stack[-1], laid[start:end]
        if kind == "name" and not node["name"]:
            m = _NAME.get(language, _PLAIN_NAME).match(piece.strip("\"'"))
            node["name"] = m[0] if m and not piece.startswith("[") or language == "ruby" and m else ""
        elif kind == "body":
            node["body"] = True
        elif kind == "recv":
            node["owner"] = _PLAIN_NAME.match(piece)[0]
        elif kind == "type":
            m = re.match(r"[&*\s]*(?:'\w+\s*)?(?:(?:mut|dyn)\s+)?([\w:]+)", piece)
            node["name"] = m[1].split("::")[-1] if m else ""
        elif kind == "doc" and node["doc"] is None:
            node["doc"] = piece
    while stack:
        close(stack.pop())
    return sorted(found, key=lambda d: d.start)


def accepts(language: str, content: str) -> bool | None:
    """Whether a whole file is valid; None if it is nested too deeply to tell."""
    return _GRAMMARS[language][0].accepts(_laid(language, normalise(content))[0])


def failure(language: str, content: str) -> FileParse:
    """Where and why a file stops being valid."""
    text = normalise(content)
    laid, inserted = _laid(language, text)
    at = min(_original(_GRAMMARS[language][0].furthest(laid), inserted), len(text))
    line = text.count("\n", 0, at) + 1
    column = at - (text.rfind("\n", 0, at) + 1) + 1
    return FileParse(False, line, column, _cause(language, text, at))


def parse_file(language: str, content: str, explain: bool = True) -> FileParse:
    """Parse a whole file; empty and blank contents are valid except where the grammar asks for more."""
    laid, inserted = _laid(language, normalise(content))
    parsed = _GRAMMARS[language][0].parse(laid)
    if parsed.ok:
        return FileParse(True, definitions=_definitions(language, laid, parsed.captures, inserted))
    if parsed.ok is None:
        return FileParse(None, cause="depth")
    return failure(language, content) if explain else FileParse(False)
