"""Scalar text functions of the edit checks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a secret in displayed context.
SECRET_PAIR = r"(?i)((?:api[_-]?key|secret|token|password|passwd|bearer|auth(?:orization)?)[\t\n\f\r ]*[:=][\t\n\f\r ]*)[^\t\n\f\r ]+"
LONG_TOKEN = r"[A-Za-z0-9+_=-]{32,}"
#: Languages by suffix.
SUFFIX_LANGUAGES = {".go": "go", ".py": "python", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mjs": "js", ".cjs": "js", ".gs": "js"}


def redact(text: Column) -> Column:
    """Values of credential assignments and long token-like runs blanked; a path's parts are short runs."""
    return F.regexp_replace(F.regexp_replace(text, SECRET_PAIR, "$1[REDACTED]"), LONG_TOKEN, "[REDACTED]")


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$", "")


def truncate_bytes(text: Column, n: int) -> Column:
    """At most n bytes of the text without blank edges, cut between characters, with ``...`` where something was cut."""
    text = stripped(text)
    fits = F.octet_length(text) <= n
    # the longest prefix of at most n characters that has at most n bytes: characters have 1 to 4
    ascii_only = F.octet_length(F.left(text, F.lit(n))) == F.least(F.length(text), F.lit(n))
    sizes = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(F.octet_length(F.left(text, k)) <= n, k))
    longest = F.left(text, F.coalesce(F.array_max(sizes), F.lit(0)))
    return F.when(fits, text).when(ascii_only, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(F.concat(longest, F.lit("...")))


def is_code_symbol(name: Column) -> Column:
    """At least three characters with an upper-case and a lower-case letter."""
    return (F.length(name) > 2) & name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}")


def language_tag(path: Column) -> Column:
    out = F.lit("")
    for suffix, lang in SUFFIX_LANGUAGES.items():
        out = F.when(path.endswith(suffix), lang).otherwise(out)
    return out


def byte_levenshtein(a: Column, b: Column, bound: int) -> Column:
    """Edit distance over UTF-8 bytes, -1 beyond the bound."""
    as_bytes = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b), bound)


def first_doc_line(doc: Column) -> Column:
    """The first non-blank line, at most 200 characters."""
    lines = F.filter(F.transform(F.split(doc, "\n"), stripped), lambda x: x != "")
    return F.left(F.try_element_at(lines, F.lit(1)), F.lit(200))


def first_backticked(message: Column) -> Column:
    return F.regexp_extract(message, "`([^`]*)`", 1)


#: Characters shown of a path, and what stands for the rest.
SHOWN, CUT = 200, "\u2026(truncated)"


def safe_for_display(text: Column) -> Column:
    """Control characters and line and paragraph separators become ``?``; what is longer than 200 characters is cut and says so."""
    shown = F.regexp_replace(F.left(text, F.lit(SHOWN)), r"[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}]", "?")
    return F.when(F.length(text) > SHOWN, F.concat(shown, F.lit(CUT))).otherwise(shown)


def is_test_file(path: Column) -> Column:
    """Test files by the conventions of Go, Python and JavaScript, or anywhere below a ``tests`` directory."""
    base = F.element_at(F.split(path, "/"), -1)
    by_name = base.endswith("_test.go") | base.endswith("_test.py") | (base.startswith("test_") & base.endswith(".py")) | base.contains(".test.") | base.contains(".spec.")
    return by_name | path.startswith("tests/") | path.contains("/tests/")


def edit_fingerprint(tool: Column, old: Column, new: Column, content: Column, edits: Column) -> Column:
    """First 12 hex digits of the SHA-256 over tool, old, new, content and each edit's old and new, every one followed by a NUL.

    Nulls are empty texts; an edit without a tool has an empty fingerprint.
    """
    ended = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\x00"))
    pairs = F.array_join(F.transform(F.coalesce(edits, F.array()), lambda e: F.concat(ended(e["old"]), ended(e["new"]))), "")
    whole = F.concat(ended(tool), ended(old), ended(new), ended(content), pairs)
    return F.when(F.coalesce(tool, F.lit("")) == "", F.lit("")).otherwise(F.left(F.sha2(whole, 256), F.lit(12)))


def derived_name(path: Column) -> Column:
    """The last two segments of a path joined by ``-``; the last alone at a file system root."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return F.when(parent.isNull() | (parent == last), last).otherwise(F.concat(parent, F.lit("-"), last))


def version_parts(version: Column) -> Column:
    """(major, minor, patch) of a semantic version with or without ``v``, null for anything else; structs compare as versions."""
    n = lambda k: F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)", k).try_cast("bigint")
    return F.when(version.rlike(r"^v?\d+\.\d+\.\d+"), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch")))
