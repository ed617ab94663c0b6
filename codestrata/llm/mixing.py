"""Mixing sources to target weights.

Method: temperature mixing. Source token shares are raised to one exponent and
normalised; the exponent is bisected until the entropy of the weights is that of
the targets, or to the last value at which no source needs more repeats than it
may have. The weights are realised as budgeted block permutations: whole passes
over a source, then blocks of its permuted documents until the budget is met.

One exponent keeps the order of the natural shares, whatever the targets ask for,
so these weights cannot come as near to given targets as the repeats allow. That
result (``nearest_quotas``) is computed directly: each source gets its target, or
what its repeats can give; what it lacks stays unspent, as more of any other source
would only move that one away from its own target. Both are realised alike.

Blocks are slices of the permutation by hash of the document id, so a source
with a third of all documents is spread over all tasks. Per source one block holds
the place where the budget ends, and one slice of that block; only the documents
of that slice, a millionth of a source, are ranked one by one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.encode import VOCABULARY, encode_corpus
from codestrata.session import materialise

#: Blocks a source's permutation is cut into, slices a block is cut into, and the permutation's seed.
BLOCKS = 1_024
SEED = 11


#: Exponents that are tried: 0 makes all sources equal, 1 leaves their shares, more than 1 sharpens them.
HIGHEST_EXPONENT, STEPS = 16.0, 60


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of all documents with at least one token, those without a source included."""
    ids = encode_corpus(documents, path, keep=("doc_id", "source"))
    return ids.select("doc_id", "source", F.size("ids").cast("bigint").alias("tokens")).filter("tokens > 0")


class Source(NamedTuple):
    """A source of the targets: its wanted share, how often a document may be used, the tokens it has."""

    name: str
    target: float
    repeats: int
    tokens: int


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares to the exponent, normalised; computed from logarithms, as small shares to high exponents underflow."""
    logs = [exponent * math.log(s) for s in shares]
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def _bisected(low: float, high: float, holds) -> float:
    """The smallest exponent between ``low`` and ``high`` at which ``holds``, which is false below and true above it."""
    if holds(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def temperature_quotas(sources: list[Source], budget: float) -> tuple[list[float], float]:
    """Tokens wanted of each source by temperature mixing, and the exponent.

    The exponent is the one at which the weights have the entropy of the targets, or, if
    that would repeat a source too often, the smallest larger one that does not. Sources
    without tokens, target or repeats get nothing; if even the natural shares need too
    many repeats, every source is held to its limit.
    """
    live = [s for s in sources if s.tokens > 0 and s.target > 0 and s.repeats > 0]
    if not live or budget <= 0:
        return [0.0] * len(sources), 1.0
    shares = [s.tokens / sum(x.tokens for x in live) for s in live]
    wanted = _entropy([s.target / sum(x.target for x in live) for s in live])
    limits = [s.tokens * s.repeats / budget for s in live]
    # entropy falls as the exponent grows; so do the weights of the small sources, which limits bind
    even = _bisected(0.0, HIGHEST_EXPONENT, lambda a: _entropy(tempered(shares, a)) <= wanted)
    fits = lambda a: all(w <= limit * (1 + 1e-12) for w, limit in zip(tempered(shares, a), limits, strict=True))
    exponent = _bisected(even, max(even, 1.0), fits)
    weights = dict(zip((s.name for s in live), tempered(shares, exponent), strict=True))
    return [min(weights.get(s.name, 0.0) * budget, float(s.tokens * s.repeats)) for s in sources], exponent


def nearest_quotas(sources: list[Source], budget: float) -> list[float]:
    """Tokens wanted of each source so that its share of the budget is as near to its target as its repeats allow."""
    return [float(min(max(s.target, 0.0) * budget, s.repeats * s.tokens)) for s in sources]


def exact_quotas(sources: list[Source]) -> list[float]:
    """Tokens of each source in the largest mix in which all sources that have any reach their targets exactly."""
    live = [s for s in sources if s.target > 0 and s.repeats * s.tokens > 0]
    whole = sum(s.target for s in live)
    budget = min((s.repeats * s.tokens * whole / s.target for s in live), default=0.0)
    names = {s.name for s in live}
    return [budget * s.target / whole if s.name in names else 0.0 for s in sources]


class Mix(NamedTuple):
    """What is chosen, the plan by source, the number of all tokens there are, and the exponent of a temperature mix."""

    selection: DataFrame
    plan: DataFrame
    all_tokens: int
    exponent: float | None


_PLAN = "source string, target_share double, max_repeats int, available long, quota double"


def _place(rows: DataFrame, rests: list[tuple[str, int, float]], level: str) -> list[tuple[str, int, float]]:
    """Per source the slice at ``level`` in which its rest ends, and what is left of the rest there.

    ``rests`` has a row a source, and so has what comes back to the driver.
    """
    asked = rows.sparkSession.createDataFrame(rests, "source string, above int, rest double")
    sums = rows.join(asked, "source").groupBy("source", level, "rest").agg(F.sum("tokens").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy("source").orderBy(level)) - F.col("inside")
    ends = sums.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("inside") >= F.col("rest")))
    return [(r["source"], r[level], r["rest"] - r["before"]) for r in ends.select("source", level, "rest", "before").collect()]


def _chosen(sizes: DataFrame, plan: list[tuple]) -> DataFrame:
    """(doc_id, source, tokens, copies): whole passes over each source, then its permutation up to the rest of its quota."""
    spark = sizes.sparkSession
    # float sums may miss a whole pass by a hair
    passes = {s: int(q / n + 1e-9) if n else 0 for s, _, _, n, q in plan}
    rest = {s: max(0.0, q - passes[s] * n) for s, _, _, n, q in plan}
    digit = lambda shift: F.pmod(F.shiftright("hash", shift), F.lit(BLOCKS)).cast("int")
    rows = sizes.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("block", digit(0)).withColumn("slice", digit(20))
    blocks = {s: (b, r) for s, b, r in _place(rows, [(s, 0, r) for s, r in rest.items() if r > 0], "block")}
    held = spark.createDataFrame([(s, b) for s, (b, _) in blocks.items()], "source string, block int")
    slices = {s: (p, r) for s, p, r in _place(rows.join(held, ["source", "block"], "left_semi"), [(s, b, r) for s, (b, r) in blocks.items()], "slice")}
    # a rest that no block ends takes all
    beyond = lambda s: (BLOCKS, 0, 0.0) if rest[s] > 0 else (-1, 0, 0.0)
    at = [(s, passes[s], m, *((blocks[s][0], *slices[s]) if s in slices else beyond(s))) for s, _, m, n, q in plan if n and q > 0]
    # one row a source of the targets; Spark decides by its size how to join it
    cuts = spark.createDataFrame(at, "source string, passes long, max_repeats int, cut_block int, cut_slice int, rest double")
    placed = rows.join(cuts, "source")
    here, there = F.struct("block", "slice"), F.struct(F.col("cut_block").alias("block"), F.col("cut_slice").alias("slice"))
    running = Window.partitionBy("source").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # the document in which the budget ends is taken if that comes nearer
    nearer = F.sum("tokens").over(running) - F.col("tokens") / 2 <= F.col("rest")

    def with_extra(part: DataFrame, extra: Column) -> DataFrame:
        return part.withColumn("copies", F.least(F.col("passes") + extra.cast("int"), F.col("max_repeats")).cast("int"))

    clear = with_extra(placed.filter(here != there), here < there)
    last = with_extra(placed.filter(here == there), nearer)
    return clear.unionByName(last).select("doc_id", "source", "tokens", "copies").filter("copies > 0")


def mixed(documents: DataFrame, targets: DataFrame, how: str = "nearest", path: str = VOCABULARY) -> Mix:
    """Selection: (doc_id, source, tokens, copies) of every chosen document.

    ``how``: ``nearest`` (each source as near to its target share of all tokens as its
    repeats allow), ``temperature`` (see ``temperature_quotas``) or ``exact`` (see
    ``exact_quotas``). The budget of the first two is the number of all tokens of the
    documents, those without a source included; these are never chosen. Rows of
    ``targets`` without source are ignored, of repeated sources the first by share
    counts; sources without a target are not chosen. Ties in the permutation go by doc_id.
    """
    sizes = materialise(token_sizes(documents, path), "token-sizes")
    once = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.min(F.struct("target_share", "max_repeats")).alias("t")
    ).select("source", F.coalesce("t.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("t.max_repeats", F.lit(0)).alias("max_repeats"))
    # one row per source of the targets, whatever the number of documents
    there = {r["source"]: r["tokens"] for r in sizes.join(once.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    all_tokens = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    wanted = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in once.orderBy("source").collect()]
    sources = [Source(s, t, m, int(there.get(s, 0))) for s, t, m in wanted]
    exponent = None
    if how == "temperature":
        quotas, exponent = temperature_quotas(sources, float(all_tokens))
    else:
        quotas = exact_quotas(sources) if how == "exact" else nearest_quotas(sources, float(all_tokens))
    plan = [(*s, q) for s, q in zip(sources, quotas, strict=True)]
    listed = documents.sparkSession.createDataFrame(plan, _PLAN)
    return Mix(_chosen(sizes.filter("source is not null"), plan), listed, all_tokens, exponent)


def share_report(mix: Mix) -> DataFrame:
    """Per source: target, tokens there, wanted and taken, largest number of copies, share of the mix and of all tokens.

    ``unspent`` is the share of all tokens by which the source stays under its target.
    """
    taken = mix.selection.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"),
        F.count("*").alias("documents"),
    )
    rows = mix.plan.join(taken, "source", "left").fillna(0, ["taken", "most_copies", "documents"])
    whole = Window.partitionBy(F.lit(0))
    return rows.select(
        "source", "target_share", "max_repeats", "available", "documents", "taken", "most_copies",
        F.try_divide(F.col("taken"), F.sum("taken").over(whole)).alias("share_of_mix"),
        F.try_divide(F.col("taken"), F.lit(mix.all_tokens)).alias("share_of_all_tokens"),
        F.greatest(F.col("target_share") - F.coalesce(F.try_divide(F.col("taken"), F.lit(mix.all_tokens)), F.lit(0.0)), F.lit(0.0)).alias("unspent"),
    )
