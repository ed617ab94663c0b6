"""Which documentation belongs to a definition, and whether it says anything."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from codestrata.llm.peg.languages import Definition

#: Words that may stand between a block comment and what it documents.
MODIFIERS = frozenset(
    "export default const let var declare async abstract static public private protected readonly override accessor".split()
)
#: The articles and work markers that say nothing.
ARTICLES = frozenset(["the", "a", "an"])
_MARKER = re.compile(r"(?:TODO|FIXME|XXX)(?![A-Za-z])")
_WORDS = re.compile(r"\w+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


def _back(text: str, at: int) -> int:
    """The end of the last text before ``at`` that is no white space."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _block_before(text: str, at: int) -> str | None:
    """The ``/** */`` block that ends before ``at``, with only blanks and modifiers between."""
    at = _back(text, at)
    while True:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$"):
            start -= 1
        if text[start:at] not in MODIFIERS:
            break
        at = _back(text, start)
    if not text.endswith("*/", 0, at):
        return None
    low = max(text.rfind("*/", 0, at - 2) + 2, 0) if text.rfind("*/", 0, at - 2) >= 0 else 0
    starts = [m.start() for m in _OPEN.finditer(text, low, at - 2)]
    if not starts:
        return None
    lined = [s for s in starts if not text[text.rfind("\n", 0, s) + 1 : s].strip()]
    start = (lined or starts[-1:])[0]
    block = text[start:at]
    return block if block.startswith("/**") and len(block) > 4 else None


_OPEN = re.compile(r"/\*")


def _lines_above(text: str, at: int) -> Iterator[tuple[int, str]]:
    """(start, bare line) of the lines above the one ``at`` stands in, the nearest first."""
    end = text.rfind("\n", 0, at)
    while end >= 0:
        start = text.rfind("\n", 0, end) + 1
        yield start, text[start:end].strip()
        end = start - 1


def _rust_lines(text: str, at: int) -> str | None:
    out: list[str] = []
    for _, bare in _lines_above(text, at):
        if bare.startswith("///") and not bare.startswith("////"):
            out.append(bare)
        elif not (bare.startswith(("#[", "//")) or not bare or bare.endswith(")]")):
            break
    return "\n".join(reversed(out)) or None


def _hash_lines(text: str, at: int) -> str | None:
    out: list[str] = []
    for start, bare in _lines_above(text, at):
        if not bare.startswith("#") or (start == 0 and bare.startswith("#!")):
            break
        out.append(bare)
    return "\n".join(reversed(out)) or None


def _go_comment(text: str, at: int) -> str | None:
    out: list[str] = []
    end = text.rfind("\n", 0, at)
    while end >= 0:
        start = text.rfind("\n", 0, end) + 1
        bare = text[start:end].strip()
        if bare.startswith("//"):
            if not bare.startswith("//go:"):
                out.append(bare)
            end = start - 1
        elif bare.endswith("*/"):
            open_at = text.rfind("/*", 0, end)
            if open_at < 0 or text[text.rfind("\n", 0, open_at) + 1 : open_at].strip():
                break
            out.append(text[open_at:end].strip())
            end = text.rfind("\n", 0, open_at)
        else:
            break
    return "\n".join(reversed(out)) or None


def documentation_of(language: str, text: str, definition: Definition) -> str | None:
    """Raw documentation with its marks, or None."""
    if language == "python":
        if definition.docstring is None:
            return None
        try:
            return ast.literal_eval(f"({definition.docstring.replace(chr(0x1E), '')})")
        except (SyntaxError, ValueError):
            return definition.docstring
    if language in ("javascript", "typescript"):
        block = _block_before(text, definition.start)
        return block if block or definition.head is None else _block_before(text, definition.head)
    if language == "rust":
        return _rust_lines(text, definition.start)
    if language == "go":
        return _go_comment(text, definition.start)
    return _hash_lines(text, definition.start)


def clean(language: str, raw: str) -> list[str]:
    """Lines of the text without comment marks."""
    if language == "python":
        return [line.strip() for line in raw.split("\n")]
    if language in ("ruby", "shell"):
        return [line.strip().lstrip("#").strip() for line in raw.split("\n")]
    lines = []
    for line in raw.split("\n"):
        bare = re.sub(r"^\s*(?:/\*+!?|\*+/|\*+(?!/)|/{2,}!?)", "", line)
        lines.append(re.sub(r"\*+/\s*$", "", bare).strip())
    return lines


def name_words(name: str) -> frozenset[str]:
    """A name and its words, split at case and ``_``, in lower case."""
    bare = name.lstrip("#")
    words = {bare.lower(), *bare.lower().split("_")}
    for part in re.split(r"[_\W]+", bare):
        words.add(part.lower())
        words.update(w.lower() for w in _PARTS.findall(part))
        words.update(w.lower() for w in re.findall(r"[A-Z]?[^\WA-Z_]+|[A-Z]+(?![^\WA-Z_\d])", part))
    return frozenset(words)


def informative(language: str, name: str, raw: str) -> bool:
    """At least one word is left after taking away marks, tag lines, work-marker lines, the name, its words and articles."""
    own = name_words(name)
    for line in clean(language, raw):
        if line.startswith("@") or _MARKER.match(line):
            continue
        for word in _WORDS.findall(line):
            low = word.lower()
            if low.strip("_") and low not in ARTICLES and low not in own:
                return True
    return False


def description(language: str, raw: str) -> str:
    """The documentation as plain text, blank edges taken off."""
    return "\n".join(clean(language, raw)).strip()
