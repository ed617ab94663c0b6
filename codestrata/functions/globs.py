"""Two glob dialects compiled to regular expressions.

Both compile on the driver, once a pattern; matching is ``rlike`` in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(text: str) -> str:
    """One path segment: ``*`` and ``?`` stay inside it, ``[...]`` is a class with ``^`` for negation."""
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", k + 2)) > 0:
            body = text[k + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("^") else body).replace("\\", "\\\\") + "]"
            k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out += re.escape(text[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def scope_regex(glob: str) -> str:
    """Path-scope dialect: a medial ``**`` is any number of segments, a trailing one at least one; a bare directory is its subtree."""
    bare = glob.strip("/")
    parts = bare.split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}(?:/.*)?$" if glob.endswith("/") else f"^{out}$"


def lookup_regex(glob: str) -> str:
    """Lookup dialect: without ``**`` plain segments (a bare directory is its subtree); with it the other segments are literal."""
    if "**" not in glob:
        body = "/".join(_segment(p) for p in glob.strip("/").split("/"))
        return f"^{body}(?:/.*)?$" if not re.search(r"[*?\[]", glob) else f"^{body}$"
    parts = glob.strip("/").split("/")
    out, after_star = "", True
    for part in parts:
        if part == "**":
            out += "(?:/[^/]+)*" if out else "(?:[^/]+/)*"
            after_star = not out
        else:
            out += ("/" if out and not out.endswith("/)*") else "") + re.escape(part)
    del after_star
    return f"^{out}$"


def in_scope(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Last matching pattern wins; ``(glob, negated)`` in order. Nothing matches: out of scope."""
    result = F.lit(False)
    for glob, negated in patterns:
        result = F.when(path.rlike(scope_regex(glob)), F.lit(not negated)).otherwise(result)
    return result


def parse_scope(text: str) -> tuple[dict[str, str], list[tuple[str, bool]]]:
    """Headers (name, description) and ordered (glob, negated) patterns of a path-scope file."""
    headers: dict[str, str] = {}
    patterns: list[tuple[str, bool]] = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        head = re.match(r"(name|description)\s*:\s*(.*)", bare)
        if head and not patterns:
            headers[head[1]] = head[2].strip()
        elif bare.startswith("!"):
            patterns.append((bare[1:].strip(), True))
        else:
            patterns.append((bare, False))
    return headers, patterns


def has_positive(patterns: list[tuple[str, bool]]) -> bool:
    """Without a positive pattern a scope abstains."""
    return any(not negated for _, negated in patterns)
