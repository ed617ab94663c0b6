"""Sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming. A text is first divided where the
layout always separates (blank lines, list items). Inside such a block every
place where a sentence might end is a candidate, and the best division into
whole spans is found: a span is scored by its closing words (stops,
abbreviations, ordinals, initials), the opening words of what follows, its
length, and its quotations and brackets, which must be balanced and may make up
the whole span. Scores of a span need both of its ends, which is why spans and
not boundaries are selected.

Which words are abbreviations is known of the common ones and learned for the
rest: in one pass over all documents every short word is counted with and without a
stop behind it, and by whether a lower-case word or a digit follows; what nearly
always has the stop, and is often carried on after, is an abbreviation.

The search from a candidate back over possible starts stops when no longer span
can win any more (the score of the best start so far less the growing cost of
length), so it is exact and near linear in the text's length.

Texts are worked on where they lie after being spread over all tasks; the counts of
words are summed in every batch and bounded by the vocabulary. What is learned is a
list of short words, collected (it is checked to be small) and sent along.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.spread import spread

#: Abbreviations (without their last stop) that never end a sentence ...
NEVER = frozenset(
    "dr prof mr mrs cf vgl ср e.g i.e vs approx resp ca bzw z.b u.a d.h p.ex p.ej pág p pp mme mlle sr sra"
    " srta fig figs sec sect nr núm рис стр гл см т.е incl viz z u d т".split()
)
#: ... and those that end one only where a new one begins.
MAYBE = frozenset("etc usw ltd inc co corp jr bros a.m p.m т.д т.п и.т.д u.s e.s.p".split())
#: Titles and parts of names, which end no sentence before a capital if they have one themselves,
TITLES = frozenset("gen col capt lt sgt cpl maj adm rev hon gov sen rep pres messrs ms st mt ft ste hr fr frau sig dott ing".split())
#: ... and words that end none before a number.
BEFORE_NUMBER = frozenset("no nos vol vols ch art par ed bd abs jan feb mar apr jun jul aug sep sept oct nov dec okt dez núms tel".split())
#: Words before an ordinal number in German.
ORDINAL_AFTER = frozenset("der die das dem den des vom zum zur am im beim seit bis ab ein einen einem".split())
#: Particles that carry on after a quotation (Japanese).
CARRY_ON = ("と", "って", "という", "とか", "は", "が", "を", "に", "の")

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:[-*]|\d+\.)[ \t\u00a0]")
#: Every character with the property, and the ellipsis; those that need no space after them are all but a few.
_TERMINALS = "".join(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))) + "…"
_SPACED = frozenset(".!?…؟۔․‼‽⁇⁈⁉")
_STOP, _PLAIN_STOP = re.compile(f"[{re.escape(_TERMINALS)}]+"), re.compile(r"[.!?]+")
_THAI = re.compile("[\u0e00-\u0e7f]")
_THAI_SPACE = re.compile(r"(?<=[฀-๿])[^\S\n\r\x0b\x0c\x85\u2028\u2029]+(?=[฀-๿])")
_CODE = re.compile(r"`[^`\n]*(?:\n[^`\n]+)?`")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", '"': '"'}
_CLOSERS = frozenset("”“»«」』)）]》\"’'")
_WIDE = frozenset("。！？｡")
_WORD_BEFORE = re.compile(r"(\S+)\Z")
_NEXT = re.compile(r"\s*(\S*)")
_PAIRED = re.compile(r"[“”„«»「」『』()（）\[\]《》\"]")
_LETTERS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_SHORT_BEFORE = re.compile(r"([^\W\d_]{1,2})\.\Z")
_PLAIN_BEFORE = re.compile(r"([^\W\d_]+)\s*\Z")
_IDENTIFIER = re.compile(r"[a-zа-я][A-Z]|_|\w[./-]\w*[./\w]|\d|[()$=@#`]")

SPAN_COST = 0.4
#: Length in characters from which a span costs more, and that cost a character.
LONG, LONG_COST = 400, 0.01
UNBALANCED, WHOLE_QUOTE, EMPTY = -12.0, 4.0, -8.0


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines and before list marks (blanks may stand before one); a list mark belongs to its item."""
    out: list[tuple[int, int]] = []
    start, at, open_block = 0, 0, False
    while True:
        m = _LINE.search(text, at)
        end = m.start() if m else len(text)
        blank = not text[at:end].strip()
        if open_block and (blank or _MARK.match(text, at, end)):
            out.append((start, at))
            open_block = False
        if not blank and not open_block:
            start, open_block = at, True
        if m is None:
            if open_block:
                out.append((start, len(text)))
            return out
        at = m.end()


def _matched(block: str, code: list[tuple[int, int]]) -> dict[int, int]:
    """Opening offset -> closing offset of quotations and brackets that are closed inside the block."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    ends = iter([*code, (len(block), len(block))])
    a, b = next(ends)
    for m in _PAIRED.finditer(block):
        c, k = m[0], m.start()
        while k >= b:
            a, b = next(ends)
        if k >= a:
            continue
        depth = next((n for n in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[n][0]]), None)
        if depth is not None and not (c == '"' and stack[depth][0] != '"'):
            pairs[stack[depth][1]] = k
            del stack[depth:]
        elif c in _PAIRS:
            stack.append((c, k))
    return pairs


class Known(NamedTuple):
    """Learned abbreviations: those that never end a sentence, and those that do where a new one begins."""

    never: frozenset[str] = frozenset()
    maybe: frozenset[str] = frozenset()


def _candidates(block: str, first: int, known: Known) -> tuple[list[int], list[float], dict[int, int]]:
    """Offsets at which a sentence may end, the score of ending there, and matched pairs.

    ``first`` is the offset behind a list mark.
    """
    code = [m.span() for m in _CODE.finditer(block)] if "`" in block else []
    code_starts = [a for a, _ in code]

    def in_code(k: int) -> bool:
        n = bisect_right(code_starts, k) - 1
        return n >= 0 and code[n][0] <= k < code[n][1]

    pairs = _matched(block, code)
    closing = {b: a for a, b in pairs.items()}
    found: dict[int, float] = {}
    size = len(block.rstrip())
    plain = block.isascii()
    for m in (_PLAIN_STOP if plain else _STOP).finditer(block, first):
        stop, end = m.span()
        if code and in_code(stop):
            continue
        closed_at = None
        while end < size:
            k = end
            if block[k] in " \u00a0\u202f" and block[k + 1 : k + 2] == "»":
                k += 1
            c = block[k]
            if c in _CLOSERS and (k in closing or c in "’'" and not block[k + 1 : k + 2].isalnum()):
                closed_at = k
                end = k + 1
            else:
                break
        if end >= size:
            continue
        spaced = block[end - 1 if closed_at is None else stop + len(m[0]) - 1] in _SPACED
        if spaced and not block[end].isspace():
            continue
        found[end] = _ending(block, stop, m[0], end, closed_at, known)
    if not plain and _THAI.search(block):
        for m in _THAI_SPACE.finditer(block, first):
            if not in_code(m.start()):
                found[m.start()] = 40.0
    at = sorted(found)
    return at, [found[k] for k in at], pairs


def _opening(block: str, end: int) -> tuple[str, str]:
    """(kind, word) of what follows: lower, code, digit, quote, capital or caseless."""
    word = _NEXT.match(block, end)[1]
    c = word[:1]
    if c in "“„«「『\"(（[《¿¡":
        return "quote", word
    if c.isupper():
        return "capital", word
    if c.isdigit():
        return "digit", word
    if c == "`" or _IDENTIFIER.search(word.rstrip(".,;:!?")):
        return "code", word
    return ("lower" if c.islower() else "caseless"), word


_OPENS = {"lower": -7.0, "code": 1.0, "digit": 1.0, "quote": 2.0, "capital": 2.0, "caseless": 2.0}


def _ending(block: str, stop: int, stops: str, end: int, closed_at: int | None, known: Known) -> float:
    """Score of a sentence that ends here, of its last words and of the words that follow."""
    last_stop = stops[-1]
    kind, word = _opening(block, end)
    if last_stop in _WIDE:
        if closed_at is not None and block[closed_at] in "”」』":
            # a quotation inside a sentence does not end it; one that is the sentence does (see the span's score)
            return -12.0 if word.startswith(CARRY_ON) else -3.0
        return 4.0
    if last_stop not in _SPACED or last_stop in "؟۔":
        return 4.0
    opens = _OPENS[kind]
    if kind == "lower" and word[-1:] == "." and (bare := word[:-1]) in NEVER | known.never and _NEXT.match(block, block.find(word, end) + len(word))[1][:1].isdigit():
        opens = 1.0  # an abbreviation before a number may open a sentence
    if "!" in stops or "?" in stops or last_stop in "‼‽⁇⁈⁉":
        return 3.0 + opens
    if stops[0] == "…" or len(stops) > 1:
        return 2.0 + opens
    head = block[max(0, stop - 60) : stop]
    m = _WORD_BEFORE.search(head)
    last = m[1].lstrip("(“„«\"[¿¡") if m else ""
    low = last.lower()
    if closed_at is None or block[closed_at] in "’'":
        before = head[: len(head) - len(last)].rstrip() if last else head
        pair = _SHORT_BEFORE.search(before) if before[-1:] == "." else None
        joined = f"{pair[1].lower()}.{low}" if pair else ""
        if low in NEVER or joined in NEVER:
            return -12.0
        if joined in MAYBE or low in MAYBE:
            return opens
        if low in known.never:
            return -12.0
        if low in known.maybe or "." in low and _LETTERS.fullmatch(low):
            return opens
        if kind == "digit" and low in BEFORE_NUMBER:
            return -9.0
        if kind == "capital":
            if len(last) == 1 and last.isalpha() and last.isupper() or low in TITLES and last[:1].isupper():
                return -12.0
            if len(last) <= 2 and last.isdigit():
                previous = _PLAIN_BEFORE.search(before)
                if previous and previous[1].lower() in ORDINAL_AFTER:
                    return -12.0
    return 3.0 + opens


def divide(block: str, known: Known = Known()) -> list[tuple[int, int]]:
    """The best division of one block into spans, edges without white space."""
    m = _MARK.match(block)
    first = m.end() if m else 0
    at, ends, pairs = _candidates(block, first, known)
    if not at:
        return _trim(block, [(0, len(block))])
    # depth of quotation after each candidate: pairs opened before it less those closed before it
    openings, closings = sorted(pairs), sorted(pairs.values())
    around = [bisect_left(openings, k) - bisect_left(closings, k) for k in at] if openings else [0] * len(at)
    cuts = [0, *at, len(block)]
    gain = [0.0, *[e + UNBALANCED * bool(d) for e, d in zip(ends, around, strict=True)], 0.0]
    best = [0.0] * len(cuts)
    back = [0] * len(cuts)
    peak = [0.0] * len(cuts)
    for j in range(1, len(cuts)):
        top, chosen = float("-inf"), j - 1
        for i in range(j - 1, -1, -1):
            length = cuts[j] - cuts[i]
            cost = SPAN_COST + max(0, length - LONG) * LONG_COST
            score = best[i] - cost + _span(block, cuts[i], cuts[j], pairs, first)
            if score > top:
                top, chosen = score, i
            if top >= peak[i] - cost + WHOLE_QUOTE + 9.0:
                break
        best[j] = top + gain[j]
        back[j] = chosen
        peak[j] = max(peak[j - 1], best[j])
    spans, j = [], len(cuts) - 1
    while j > 0:
        spans.append((cuts[back[j]], cuts[j]))
        j = back[j]
    return _trim(block, spans[::-1])


def _span(block: str, start: int, end: int, pairs: dict[int, int], first: int) -> float:
    """What only both ends of a span tell: an empty span, a whole quotation, a whole answer of one word."""
    low = max(start, first) if start == 0 else start
    while low < end and block[low].isspace():
        low += 1
    if end - low > 3 and block[low] not in _PAIRS:
        return 0.0
    piece = block[low:end].rstrip()
    if len(piece) < 4:
        if piece[-1:] == "." and piece[:1].isupper() and piece[:-1].lower() in BEFORE_NUMBER and (start == 0 or _NEXT.match(block, end)[1][:1].isupper()):
            return 12.0
        if not any(c.isalnum() for c in piece):
            return EMPTY
    if pairs.get(low) == low + len(piece) - 1:
        return WHOLE_QUOTE
    return 0.0


def _trim(block: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        piece = block[a:b]
        left = a + len(piece) - len(piece.lstrip())
        right = b - (len(piece) - len(piece.rstrip()))
        if left < right:
            out.append((left, right))
    return out


def sentence_spans(text: str | None, known: Known = Known()) -> list[tuple[int, int]]:
    """Code-point offsets of the sentences of a text; none for null and blank texts."""
    if not text or text.isspace():
        return []
    return [(a + s, a + e) for a, b in blocks(text) for s, e in divide(text[a:b], known)]


_TOKEN = re.compile(r"(?<![\w.])([^\W\d_]{1,6}(?:\.[^\W\d_]{1,4})*)(?:(\.)\s+([^\W_])|(?![\w.]))")


def word_counts(texts: Iterator[str]) -> Counter:
    """(word in lower case, how it stands) -> times; it stands ``bare``, or with a stop and then ``on`` (a lower-case word or a digit) or ``new``."""
    found: Counter = Counter()
    for text in texts:
        found.update(_TOKEN.findall(text))
    out: Counter = Counter()
    for (word, stop, after), n in found.items():
        out[word.lower(), "bare" if not stop else "on" if after.islower() or after.isdigit() else "new"] += n
    return out


#: A word is an abbreviation if it has a stop in this share of at least so many cases and is carried on in this share of those;
#: from the last share on it never ends a sentence.
LEAST, WITH_STOP, CARRIED, ALWAYS = 20, 0.98, 0.25, 0.98
#: More learned words than any language has would mean that something is wrong with the texts.
MOST_LEARNED = 20_000


def learned_abbreviations(documents: DataFrame) -> Known:
    """What the texts themselves show to be abbreviations; every text counts, repeated ones again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*k, n) for k, n in word_counts(part["text"]).items()]
            yield pd.DataFrame(rows, columns=["word", "stands", "n"])

    counts = documents.filter("text is not null").select("text").mapInPandas(run, "word string, stands string, n long")
    n = lambda x: F.coalesce(F.sum(F.when(F.col("stands") == x, F.col("n"))), F.lit(0)).alias(x)
    sums = counts.groupBy("word").agg(n("bare"), n("on"), n("new")).withColumn("stops", F.col("on") + F.col("new"))
    share = F.col("on") / F.col("stops")
    learned = sums.filter(
        (F.col("stops") >= LEAST) & (F.col("stops") >= WITH_STOP * (F.col("stops") + F.col("bare"))) & (share >= CARRIED)
    ).select("word", (share >= ALWAYS).alias("never"))
    rows = learned.limit(MOST_LEARNED + 1).collect()
    if len(rows) > MOST_LEARNED:
        raise ValueError("too many words look like abbreviations")
    return Known(frozenset(r["word"] for r in rows if r["never"]), frozenset(r["word"] for r in rows if not r["never"]))


def sentences(documents: DataFrame, known: Known | None = None) -> DataFrame:
    """(doc_id, seq, start_pos, end_pos, sentence) of every document.

    Offsets are code points, from 0, end exclusive; no white space at either
    edge; together the sentences cover everything but white space. Null and
    blank texts have no rows; a repeated doc_id gives its rows again. ``known`` are
    abbreviations besides the common ones, learned from the documents if not given.
    """
    learned = learned_abbreviations(documents) if known is None else known

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (doc_id, n, a, b, text[a:b])
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True)
                for n, (a, b) in enumerate(sentence_spans(text, learned))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "start_pos", "end_pos", "sentence"])

    schema = "doc_id long, seq int, start_pos long, end_pos long, sentence string"
    rows = documents.select("doc_id", "text").filter("text is not null")
    return spread(rows, "doc_id").mapInPandas(run, schema)
