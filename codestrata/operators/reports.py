"""Reports over facts: hash folds, verdict maps, benchmark scores, payloads, line states, synthetic cases."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.extract import literal_spans, mask

#: Reasons for which a check declines a candidate by its own design.
GATE_REASONS = (
    "shadowed-qualifier", "unexported-selector", "ambiguous-receiver", "ambiguous-local", "name-known-elsewhere", "no-indexed-members",
    "unreliable-call-shape", "shadowed-callee", "nested-def-shadow", "ambiguous-decl-shapes", "unusable-decl-shape",
    "unparseable-added-signature", "decl-edited-in-hunk",
)
#: Directories of generated files.
GENERATED = ("node_modules", "dist", "build", "vendor", ".venv", "_astro", "coverage", "immutable", ".next", "out", "target")


def folded_symbols(symbols: DataFrame) -> DataFrame:
    """One row per (path, kind, name): hashes of repeats folded in source order, line and doc of the first.

    A repeat's hash is the SHA-256 of the hash so far and its own, side by side. Input
    has ``ordinal``, the place in the file.
    """
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "hash", "line", "doc")))
    one = symbols.groupBy("path", "kind", "name").agg(rows.alias("r"))
    fold = F.aggregate(
        F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.col("r")[0]["hash"],
        lambda acc, x: F.sha2(F.concat(acc, x["hash"]), 256),
    )
    return one.select("path", "kind", "name", fold.alias("hash"), F.col("r")[0]["line"].alias("line"), F.col("r")[0]["doc"].alias("doc"))


def legacy_shape(symbols: DataFrame) -> DataFrame:
    """(path, content_hash, functions, classes, exports, imports, symbol_hashes, symbol_lines): the older structure shape.

    Symbols come once each, as ``folded_symbols`` gives them.
    """
    names = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name"))))
    key = F.concat("kind", F.lit(":"), "name")
    hashed = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("hash") != "", F.struct(key.alias("k"), F.col("hash").alias("v"))))))
    lines = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.struct(key.alias("k"), F.col("line").alias("v"))))))
    return symbols.groupBy("path", "content_hash").agg(
        names("function").alias("functions"), names("class").alias("classes"), names("export").alias("exports"), names("import").alias("imports"),
        hashed.alias("symbol_hashes"), lines.alias("symbol_lines"),
    )


def cache_misses(packages: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Packages whose source text, under this extractor version, the export cache does not hold: (import_path, key)."""
    sources = F.array_sort(F.collect_list(F.struct("file", F.sha2("content", 256).alias("h"))))
    text = F.array_join(F.transform(sources, lambda x: F.concat(x["file"], F.lit(":"), x["h"])), "\n")
    keyed = packages.groupBy("import_path").agg(F.sha2(F.concat(F.lit(version + "\n"), F.col("import_path"), F.lit("\n"), text), 256).alias("key"))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def verdict_maps(results: DataFrame) -> DataFrame:
    """(event, checks, reasons) from (event, check, verdict, reason); ``ok`` keeps no reason."""
    entry = lambda v: F.struct("check", F.col(v).alias("v"))
    return results.groupBy("event").agg(
        F.map_from_entries(F.array_sort(F.collect_set(entry("verdict")))).alias("checks"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when((F.col("verdict") != "ok") & (F.col("reason") != ""), entry("reason"))))).alias("reasons"),
    )


def without_reported(symbols: Column, reported: Column) -> Column:
    """Sorted distinct symbols without those that another check has reported; null reports nothing."""
    return F.array_sort(F.array_distinct(F.array_except(symbols, F.coalesce(reported, F.array().cast("array<string>")))))


def degraded_unknowns(results: DataFrame) -> DataFrame:
    """(event, n): unknown verdicts whose reason is no gate; an empty reason is none."""
    bad = (F.col("verdict") == "unknown") & ~F.coalesce(F.col("reason").isin(*GATE_REASONS), F.lit(False))
    return results.groupBy("event").agg(F.count_if(bad).alias("n"))


def ask_reason(fired: list[str], order: list[str]) -> Column:
    """Names of the boolean columns that fired, in fixed order, joined by ``+``."""
    return F.concat_ws("+", *[F.when(F.col(c), F.lit(c)) for c in order if c in fired])


def scorecard(cases: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts, recall, false-positive rate, precision and F1 by the given columns; ratios of nothing are 0."""
    n = lambda flag, bad, a: F.count_if((F.col("flagged") == flag) & (F.col("label") == bad)).alias(a)
    c = cases.groupBy(*by).agg(n(True, True, "tp"), n(False, True, "fn"), n(True, False, "fp"), n(False, False, "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select(
        "*", ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fp_rate"), ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def captured_cases(cases: DataFrame) -> DataFrame:
    """Validated captured cases: the line must hold the symbol, and the label agree with membership in the known names.

    Adds ``position`` from the notes. An invalid case raises.
    """
    known = F.array_contains("known_symbols", F.col("referenced_symbol"))
    fine = F.contains("source_line", "referenced_symbol") & ((F.col("label") == "hallucinated") != known)
    checked = F.when(fine, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid case "), F.col("id"))))
    return cases.withColumn("id", checked).withColumn("position", F.regexp_extract("notes", "position=([^;, ]*)", 1))


def triage(findings: DataFrame) -> DataFrame:
    """(repo, findings, generated, genuine, fp_rate) of detector findings; paths are full, and generated below certain directories."""
    generated = F.lit(False)
    for name in GENERATED:
        generated = generated | F.contains("path", F.lit(f"/{name}/"))
    rows = findings.withColumn("generated", generated)
    return rows.groupBy("repo").agg(
        F.count("*").alias("findings"), F.count_if("generated").alias("generated"), F.count_if(F.col("genuine") & ~F.col("generated")).alias("genuine"),
        F.try_divide(F.count_if(~F.col("genuine") & ~F.col("generated")), F.count_if(~F.col("generated"))).alias("fp_rate"),
    )


def triage_verdict(report: DataFrame) -> DataFrame:
    """Worth building with at least three genuine findings in at least two repositories."""
    t = report.agg(F.sum("genuine").alias("genuine"), F.count_if(F.col("genuine") > 0).alias("repos"))
    return t.withColumn("worth", (F.col("genuine") >= 3) & (F.col("repos") >= 2))


def changed_paths(*sources: DataFrame) -> DataFrame:
    """Sorted distinct paths of worktree, staged and untracked listings."""
    out = sources[0].select("path")
    for s in sources[1:]:
        out = out.unionByName(s.select("path"))
    return out.distinct().orderBy("path")


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    """(path, symbols): each file's symbols as an array sorted by line, then name."""
    return symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("symbols"))


def payload(changes: DataFrame) -> DataFrame:
    """(after_id, payload): a diff as one JSON object with snake_case names; no change gives empty arrays, not nulls."""
    paths = lambda s: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("path")))), F.array()).alias(s)
    rows = changes.groupBy("after_id").agg(paths("added"), paths("removed"), paths("modified"))
    return rows.select("after_id", F.to_json(F.struct("added", "removed", "modified")).alias("payload"))


def block_lines(blocks: DataFrame, gap: int = 1) -> DataFrame:
    """(file, block, line_no, text) of edit blocks as one numbering, with a gap between blocks."""
    lines = blocks.select("file", "block", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    sizes = blocks.select("file", "block", (F.size(F.split("text", "\n", -1)) + gap).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select("file", "block", (F.col("offset") + F.col("k") + 1).cast("int").alias("line_no"), "text")


def block_position(old: Column, file_text: Column) -> Column:
    """Line at which an edit's old text starts in the file, 0 if it is not there."""
    at = F.instr(file_text, old)
    return F.when(at > 0, F.size(F.split(F.substring(file_text, F.lit(1), at - 1), "\n", -1))).otherwise(0)


_BRACKET = re.compile(r"[][(){}]")
_OPENING = {"}": "{", "]": "[", ")": "("}


def line_states(files: DataFrame) -> DataFrame:
    """(source_id, line_no, brace, bracket, paren, open): nesting depths before each line and whether a literal or comment is open.

    Depths never fall below zero; what lies in literals and comments does not count.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for sid, lang, text in zip(part["source_id"], part["lang"], part["content"], strict=True):
                masked = mask(lang, text)
                spans = iter(literal_spans(lang, text))
                span = next(spans, None)
                depth = {"{": 0, "[": 0, "(": 0}
                at = 0
                for n, line in enumerate(masked.split("\n"), 1):
                    while span is not None and span[1] <= at:  # spans come in order and do not overlap
                        span = next(spans, None)
                    rows.append((sid, n, depth["{"], depth["["], depth["("], span is not None and span[0] < at < span[1]))
                    for m in _BRACKET.finditer(line):
                        c = m[0]
                        if c in depth:
                            depth[c] += 1
                        else:
                            depth[_OPENING[c]] = max(0, depth[_OPENING[c]] - 1)
                    at += len(line) + 1
            yield pd.DataFrame(rows, columns=["source_id", "line_no", "brace", "bracket", "paren", "open"])

    return files.select("source_id", "lang", "content").mapInPandas(run, "source_id long, line_no int, brace int, bracket int, paren int, open boolean")


def synthetic_cases(seed: int, known: list[str], unknown: list[str], per_pool: int) -> list[tuple[str, str, bool, str]]:
    """(line, symbol, hallucinated, category), reproducible by seed: calls of known names and of perturbed ones."""
    rng = random.Random(seed)
    out = []
    for name in rng.sample(known, min(per_pool, len(known))):
        out.append((f"{name}(x)", name, False, "known"))
        k = rng.randrange(len(name))
        for kind, bad in (("dropped-char", name[:k] + name[k + 1 :]), ("flipped-case", name[:k] + name[k].swapcase() + name[k + 1 :])):
            if bad not in known and bad:
                out.append((f"{bad}(x)", bad, True, kind))
    for name in rng.sample(unknown, min(per_pool, len(unknown))):
        if name not in known:
            out.append((f"{name}(x)", name, True, "invented"))
    return out
