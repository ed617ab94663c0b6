"""Code symbols that a text claims: names in backticks, declarations, methods, members of declaration blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

_NAME = r"[\p{L}_][\p{L}\p{N}_]*"
_LIST = r"\p{Lu}[\p{L}\p{N}_]*(?:\s*,\s*\p{Lu}[\p{L}\p{N}_]*)*"
_TICKED = regex.compile(rf"`({_NAME}(?:\.{_NAME})*)`")
_METHOD = regex.compile(rf"\bfunc\s+\(\s*(?:{_NAME}\s+)?\*?(\p{{L}}[\p{{L}}\p{{N}}_]*)(?:\[[^\]]*\])?\s*\)\s+(\p{{Lu}}[\p{{L}}\p{{N}}_]*)")
_DECLARED = regex.compile(rf"\b(?:func|type|var|const)\s+({_LIST})")
_WORDED = regex.compile(r"\b(?:class|function|let|const|def)\s+(\p{L}[\p{L}\p{N}_]*)")
_OPENS = regex.compile(r"^\s*(?:var|const|type)\s*\(\s*$")
_MEMBER = regex.compile(rf"^\s*({_LIST})(?:\s|=|$)")
_UPPER, _LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")


def claimed(text: str) -> dict[str, str]:
    """Symbol -> the first line that claims it; only names of at least three characters with letters of either case.

    A block is open from its opening line until its brackets are closed; lines inside
    braces of a block are fields, not members.
    """
    found: dict[str, str] = {}
    depth = braces = 0
    for line in text.split("\n"):
        names = [m[1] for m in _TICKED.finditer(line)]
        names += [f"{m[1]}.{m[2]}" for m in _METHOD.finditer(line)]
        names += [n for m in _DECLARED.finditer(line) for n in m[1].split(",")]
        names += [m[1] for m in _WORDED.finditer(line)]
        if depth <= 0:
            depth, braces = (1, 0) if _OPENS.match(line) else (0, 0)
        else:
            if braces == 0 and (m := _MEMBER.match(line)):
                names += m[1].split(",")
            braces = max(0, braces + line.count("{") - line.count("}"))
            depth = max(0, depth + line.count("(") - line.count(")"))
        for name in map(str.strip, names):
            if len(name) > 2 and name not in found and _UPPER.search(name) and _LOWER.search(name):
                found[name] = line
    return found


def claimed_symbols(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, symbol, line) of each text; null texts claim nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, s, line) for k, t in zip(part[key], part[text], strict=True) for s, line in claimed(t).items()]
            yield pd.DataFrame(rows, columns=[key, "symbol", "line"])

    rows = texts.filter(f"{text} is not null").select(key, text)
    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, symbol string, line string")
