"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: overlapping chunk encoding. Every text is cut into overlapping chunks;
each chunk is pre-tokenised and encoded by itself, spread over all tasks, so one
huge text is worked on by many; two neighbours are stitched at the first
boundary inside their overlap that both have found, where the pre-tokeniser has
resynchronised. Decoding concatenates the raw bytes of the ids.

The pattern looks only ahead, and at most two characters behind a match's end: so
once two scans share a boundary they agree from there on, and a match that ends
two characters before the end of its chunk is the match of the whole text. No match
goes on past the last of a run of letters or of numbers, so every scan has a
boundary there, wherever it began. Where neighbours share no boundary in their
overlap (one run covers it) the earlier chunk hands over its text from its last sure
boundary on, the later one its text up to the first end of such a run, and what lies
between is encoded when the two are stitched, which is exact as well.

Plan: chunks are cut in the JVM in one pass over a text and spread by (text,
chunk); ids are brought together by text, sorted by chunk, and streamed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.spread import spread
from codestrata.session import cpu_tasks

#: Where the public vocabularies lie; a parameter of every function that reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunk length and overlap in characters.
CHUNK = 2_048
OVERLAP = 128
#: Fixed value: the pre-token pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PieceEncoder(dict):
    """Pre-token text -> ids; a dictionary that computes what it has not seen."""

    LIMIT = 200_000

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        ids = list(self.encoding._encode_single_piece(data))
        if len(piece) < 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> PieceEncoder:
    return PieceEncoder(path)


_PRE = regex.compile(PATTERN)


def boundaries(text: str, start: int = 0) -> list[int]:
    """Pre-token start offsets."""
    return [m.start() for m in _PRE.finditer(text, start)]


def encode_text(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of one text; null and empty texts give an empty list."""
    if not text:
        return []
    pieces = encoder(path)
    return [i for piece in _PRE.findall(text) for i in pieces[piece]]


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes one after another."""
    return encoder(path).encoding.decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")


_SCAN = ["ids", "head", "head_at", "tail", "tail_at", "sure", "lead", "lead_at", "own"]
_RUN_END = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")


def _scan(pieces: PieceEncoder, piece: str, first: bool, last: bool, step: int, overlap: int) -> tuple:
    """One chunk's ids and what its seams need, offsets inside the chunk.

    ``head`` are boundaries in the overlap with the chunk before, ``tail`` in the one
    with the next, each with the number of ids before it. ``sure`` is the last boundary
    that is certain, 0 if none is. ``lead`` is the text up to the first end of a run, with the
    number of ids before it (all of a last chunk; -1 if there is none), ``own`` the text from
    ``sure`` up to where the next chunk begins.
    """
    if first and last:
        return [i for p in _PRE.findall(piece) for i in pieces[p]], [], [], [], [], len(piece), "", 0, ""
    ids: list[int] = []
    head, head_at, tail, tail_at = [], [], [], []
    sure, lead, lead_at = 0, piece, -1
    for m in _PRE.finditer(piece):
        a, b = m.span()
        if not last and b >= len(piece) - 1:
            break
        ids += pieces[m[0]]
        sure = b
        if lead_at < 0 and not first and (b == len(piece) or _RUN_END.match(piece, b)):
            lead, lead_at = piece[:b], len(ids)
        if not first and b <= overlap:
            head.append(b)
            head_at.append(len(ids))
        if not last and b >= step:
            tail.append(b)
            tail_at.append(len(ids))
    return ids, head, head_at, tail, tail_at, sure, "" if first else lead, lead_at, "" if last else piece[sure:step]


def _chunks(path: str, step: int, overlap: int, keep: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = encoder(path)
        for part in parts:
            got = [_scan(pieces, p, k == 0, k == n - 1, step, overlap) for p, k, n in zip(part["piece"], part["k"], part["n"], strict=True)]
            columns = zip(*got, strict=True) if got else [[] for _ in _SCAN]
            yield part[["row", "k", "n", *keep]].assign(**{name: list(c) for name, c in zip(_SCAN, columns, strict=True)})

    return run


class Stitch:
    """The chunks of one text, in order, to its ids."""

    def __init__(self, path: str, step: int):
        self.path, self.step = path, step
        self.done: list[int] = []
        self.ids, self.low = [], 0
        self.shared: dict[int, int] = {}
        # text from the last sure boundary on to the next chunk; how much of that chunk lies before it
        self.open, self.drop = "", 0

    def add(self, first: bool, ids, head, head_at, tail, tail_at, sure: int, lead: str, lead_at: int, own: str) -> None:
        low = 0
        if not first:
            cut = next((n for n in range(len(head)) if head[n] in self.shared), None)
            if cut is not None:
                self.done += self.ids[self.low : self.shared[head[cut]]]
                low = head_at[cut]
            else:
                self.done += self.ids[self.low :]
                if lead_at < 0:
                    self.ids, self.low, self.shared = [], 0, {}
                    self.open += lead[self.drop : self.step]
                    self.drop = 0
                    return
                self.done += encode_text(self.open + lead[self.drop :], self.path)
                low = lead_at
        self.ids, self.low = ids, low
        # boundaries before the one that the two chunks agree on may be wrong
        self.shared = {t - self.step: n for t, n in zip(tail, tail_at, strict=True) if n >= low}
        self.open, self.drop = own, max(0, sure - self.step)

    def finish(self) -> list[int]:
        return self.done + self.ids[self.low :]


def _stitched(path: str, step: int, keep: list[str]):
    """Rows come sorted by text and chunk; a text's chunks may lie in several batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stitch = Stitch(path, step)
        for part in parts:
            n, k = part["n"].to_numpy(), part["k"].to_numpy()
            ids = part["ids"].tolist()
            for at in (n > 1).nonzero()[0].tolist():
                stitch = stitch if k[at] else Stitch(path, step)
                rest = [x.tolist() if hasattr(x, "tolist") else x for x in (part[c].iat[at] for c in _SCAN)]
                stitch.add(k[at] == 0, *rest)
                if k[at] == n[at] - 1:
                    ids[at] = stitch.finish()
            whole = k == n - 1
            yield part.loc[whole, keep].assign(ids=[x for x, w in zip(ids, whole.tolist(), strict=True) if w])

    return run


def encode_corpus(
    documents: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``documents``; ``keep`` names the columns carried instead of doc_id.

    Every row gives one row, whatever its length, with repeated or null doc_ids too.
    Null and empty texts have no ids. Text that looks like a special token is ordinary text.
    """
    if not 2 <= overlap <= chunk // 2:
        raise ValueError("the overlap must be at least 2 characters and at most half a chunk")
    step = chunk - overlap
    names = [f"c{n}" for n in range(len(keep))]
    # a scan's rows have the same places whenever they are read again
    texts = documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "text", F.monotonically_increasing_id().alias("row"))
    cut = texts.withColumn("s", F.expr(f"regexp_extract_all(coalesce(text, ''), '(?s).{{1,{step}}}', 0)")).drop("text")
    # a last piece inside the overlap belongs to the chunk before it
    size = F.size("s")
    short = (size > 1) & (F.length(F.element_at("s", -1)) <= overlap)
    count = F.greatest(size - F.when(size > 1, short.cast("int")).otherwise(0), F.lit(1))
    piece = lambda i: F.concat(F.coalesce(F.get("s", i), F.lit("")), F.substring(F.coalesce(F.get("s", i + 1), F.lit("")), 1, overlap))
    rows = (
        cut.withColumn("n", count).withColumn("p", F.transform(F.sequence(F.lit(0), F.col("n") - 1), piece))
        .select("row", "n", *names, F.posexplode("p").alias("k", "piece"))
    )
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    kept = ", ".join(f"{n} {types[n]}" for n in names)
    scanned = spread(rows, "row", "k").mapInPandas(
        _chunks(path, step, overlap, names),
        f"row long, k int, n int, {kept}, ids array<int>, head array<int>, head_at array<int>, tail array<int>, tail_at array<int>,"
        " sure int, lead string, lead_at int, own string",
    )
    ordered = scanned.repartition(cpu_tasks(documents), "row").sortWithinPartitions("row", "k")
    found = ordered.mapInPandas(_stitched(path, step, names), f"{kept}, ids array<int>")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "ids")
