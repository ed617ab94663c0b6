"""Source files that do not parse, and functions paired with their documentation.

Method: one packrat parsing-expression grammar per language must consume the
whole file. A failure reports the furthest position reached and its cause; a
success keeps the offsets of definitions, and semantic actions pair each with
its documentation before uninformative documentation is filtered out.

Files are spread over all tasks by id (parsing is bound by CPU, so splits of the
input are no measure of work); there is no shuffle besides. A repository with a
third of all files changes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.peg.documentation import description, documentation_of, informative
from codestrata.llm.peg.languages import EXTENSIONS, FileParse, accepts, failure, normalise, parse_file
from codestrata.llm.spread import spread

_LINE_END = re.compile("\n")


def language_of(path: Column) -> Column:
    """Language by the path's extension, in lower or upper case as written; null if unsupported."""
    suffix = F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)
    pairs = [F.lit(x) for item in EXTENSIONS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix)


def _supported(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.col("content").isNotNull() & F.col("source_id").isNotNull())
        .select("source_id", "repo_id", language_of(F.col("path")).alias("lang"), "content")
        .filter(F.col("lang").isNotNull())
    )


def _unparsable(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        bad = [accepts(lang, content) is False for lang, content in zip(part["lang"], part["content"], strict=True)]
        yield part.loc[bad, ["source_id"]]


def unparsable_files(files: DataFrame) -> DataFrame:
    """(source_id) of every file with content and a supported extension that is not valid.

    As ``checked_files``, without looking for places and causes.
    """
    return spread(_supported(files), "source_id").mapInPandas(_unparsable, "source_id long")


def _check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        got = []
        for lang, content in zip(part["lang"], part["content"], strict=True):
            ok = accepts(lang, content)
            got.append(FileParse(True) if ok else FileParse(None, cause="depth") if ok is None else failure(lang, content))
        yield pd.DataFrame(
            {
                "source_id": part["source_id"], "repo_id": part["repo_id"], "lang": part["lang"],
                "ok": pd.array([g.ok for g in got], dtype="boolean"), "line": [g.line for g in got], "col": [g.column for g in got],
                "cause": [g.cause for g in got],
            }
        )


def checked_files(files: DataFrame) -> DataFrame:
    """(source_id, repo_id, lang, ok, line, col, cause) of every file with content and a supported extension.

    ``cause`` of a failure: conflict (a merge marker where parsing stopped),
    truncated (the text ends too early), extension (valid in another language)
    or syntax; empty where ``ok``. A text nested too deeply for the parser's memory
    has a null ``ok`` and cause depth: it is not flagged. Null content and other
    extensions are left out; empty content is parsed like any other (an empty Go
    file is invalid).
    """
    schema = "source_id long, repo_id long, lang string, ok boolean, line int, col int, cause string"
    return spread(_supported(files), "source_id").mapInPandas(_check, schema)


def parse_rates(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Rates per repository and language beside the counters the last index run stored.

    Files of repositories that ``repos`` does not list keep null counters.
    """
    rates = checked_files(files).groupBy("repo_id", "lang").agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("ok")).alias("unparsable"),
        F.count_if(F.col("cause") == "conflict").alias("conflicts"),
        F.count_if(F.col("cause") == "truncated").alias("truncated"),
        F.count_if(F.col("cause") == "extension").alias("wrong_extension"),
    )
    known = repos.groupBy("repo_id").agg(
        F.min("parse_errors").alias("parse_errors"), F.min("supported_seen").alias("supported_seen")
    )
    return rates.withColumn("rate", F.col("unparsable") / F.col("files")).join(known, "repo_id", "left")


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for source_id, lang, content in zip(part["source_id"], part["lang"], part["content"], strict=True):
            parsed = parse_file(lang, content, explain=False)
            text = normalise(content) if parsed.definitions else ""
            ends = [m.start() for m in _LINE_END.finditer(text)]
            for d in parsed.definitions:
                raw = documentation_of(lang, text, d)
                if raw and informative(lang, d.name, raw):
                    line = bisect_left(ends, d.start) + 1
                    rows.append((source_id, lang, d.path, line, description(lang, raw)))
        yield pd.DataFrame(rows, columns=["source_id", "lang", "name", "line", "doc"])


def documented_functions(files: DataFrame) -> DataFrame:
    """(source_id, lang, name, line, doc) of every named function or method with informative documentation.

    ``name`` joins enclosing classes and functions by dots. Two functions of one
    name in a file give two rows. Files that do not parse give none.
    """
    schema = "source_id long, lang string, name string, line int, doc string"
    return spread(_supported(files), "source_id").mapInPandas(_pairs, schema)
