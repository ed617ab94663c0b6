"""Schemas that drift between files: one consistent table, and each change reported.

Method: similarity flooding. Every file of a stream has a schema graph: the
record, its fields with their types, item fields of nested arrays, value
profiles, and the order in which fields follow one another. For consecutive
files the graphs are joined to one graph of field pairs; first scores from names
and value profiles are propagated along its edges (same neighbour before and
after; an array and its item fields, both ways) until they change no more; from
the converged scores consistent one-to-one correspondences are selected. Fields of
one name correspond by definition; they are where similarity flows from. Fields
without a correspondence were added or removed, those with another name renamed,
those with another type retyped. The correspondences of a stream, chained, give
each field its canonical name, under which all lines are cast and united.

Plan: lines are profiled where they lie, one row per (file, field) and batch; these
are merged per (file, field) as they stream by, so a file or stream with a third of
all lines is spread over its fields and held as one profile a field. A profile is
bounded by design (a bottom-k sketch of values, histograms of shapes), so matching
two files is a small task; pairs of files are spread over all tasks. The share of
common values in two sketches of 96 is within 0.1 of the true one in 95 % of cases.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cpu_tasks, materialise

#: Size of the bottom-k sketch of a field's values.
SKETCH = 96
#: Correspondences need at least this score.
ACCEPT = 0.5
#: Item fields of the structure format's symbols array, in its versions.
SYMBOL_ITEMS = frozenset(["name", "kind", "line", "hash", "doc"])
SYMBOL_KINDS = frozenset(["function", "class", "export", "import", "import_name", "export_wildcard", "unexported", "field"])

_SEP = "\x1f"


_TYPES = {type(None): "", bool: "boolean", int: "integer", float: "fraction", str: "string", dict: "object"}


def json_type(value: object) -> str:
    """Type of a JSON value; '' for null, 'array' for an array without non-null items."""
    got = _TYPES.get(type(value))
    if got is not None:
        return got
    kinds = [_TYPES.get(type(v)) or json_type(v) for v in value if v is not None]
    if not kinds:
        return "array"
    first = kinds[0]
    return f"array<{first if kinds.count(first) == len(kinds) else min(set(kinds), key=lambda k: (-kinds.count(k), k))}>"


def _no_constant(word: str) -> None:
    raise ValueError(word)


_READ = json.JSONDecoder(parse_constant=_no_constant).decode


def read_object(body: str | None) -> dict | None:
    """The JSON object of a line, None for anything else."""
    if not body:
        return None
    try:
        got = _READ(body)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


_SHAPE = [
    (re.compile(r"[0-9a-f]{8,}"), lambda m: f"hex{len(m[0])}"),
    (re.compile(r"\d{4}-\d\d-\d\dT[\d:.]+(?:Z|[+-]\d\d:\d\d)"), lambda m: "time"),
]


def _shape(text: str) -> str:
    """The kinds of a text's words and what stands between them; of a long one the first, and a hash of all."""
    for rx, name in _SHAPE:
        m = rx.fullmatch(text)
        if m and any(c.isdigit() for c in text):
            return name(m)
    shape = _WORD.sub(_word_kind, text)
    return shape if len(shape) <= 24 else f"{shape[:16]}~{xxhash.xxh32_intdigest(shape):08x}"


_WORD = re.compile(r"\w+")
_PIECES = re.compile(r"[,;|+]")


def _word_kind(m: re.Match) -> str:
    """9 digits, s snake case, a lower, U upper, P Pascal, c camel case."""
    w = m[0]
    if w.isdigit():
        return "9"
    if "_" in w:
        return "s"
    return "a" if w.islower() else "U" if w.isupper() else "P" if w[0].isupper() else "c"


_KNOWN: dict[str, tuple[str, ...]] = {}


def _text_features(value: str) -> tuple[str, ...]:
    """Shapes, hashes and length of a text; what is known of short ones is kept."""
    got = _KNOWN.get(value)
    if got is None:
        # prose is of one shape; a list written as one text goes on with the same pieces
        prose = len(value.split(None, 3)) > 2
        pieces = (value,) if prose or _shape(value) == "time" else _PIECES.split(value)
        found = [f"l:{round(math.log2(1 + len(value)) * 2)}"]
        for piece in pieces:
            if piece:
                found += ["s:" + ("text" if prose else _shape(piece)), f"v:{xxhash.xxh64_intdigest(piece):016x}"]
        got = tuple(found)
        if len(value) <= 200:
            if len(_KNOWN) >= 50_000:
                _KNOWN.clear()
            _KNOWN[value] = got
    return got


def _features(value: object, found: list[str]) -> None:
    """Adds what a value says about its field: shapes, hashed values, magnitudes, keys; of all that is nested in it too."""
    if type(value) is str:
        found += _text_features(value)
        return
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            found += _text_features(value)
        elif value is None:
            continue
        elif isinstance(value, bool):
            found.append("s:bool")
        elif isinstance(value, (int, float)):
            scale = 0 if value == 0 or not math.isfinite(value) else round(math.copysign(math.log2(1 + abs(value)), value) * 2)
            found.append(f"m:{scale}")
        elif isinstance(value, dict):
            for k in value:
                found += [f"k:{_shape(k)}", f"v:{xxhash.xxh64_intdigest('k' + k):016x}"]
            todo += value.values()
        else:
            found.append(f"n:{round(math.log2(1 + len(value)) * 2)}")
            for v in value:
                if isinstance(v, dict):
                    found += ["i:" + k for k, x in v.items() if x is not None]
                    todo += v.values()
                elif type(v) is str:
                    found += _text_features(v)
                else:
                    todo.append(v)


def _sketched(features: dict[str, int]) -> dict[str, int]:
    """Without the values beyond the bottom-k sketch."""
    values = [f for f in features if f[0] == "v"]
    if len(values) > SKETCH:
        for f in sorted(values)[SKETCH:]:
            del features[f]
    return features


def _describe(record: dict, fields: dict[str, list[str]]) -> None:
    """Adds what one record says to the features of its fields."""
    names = [k for k, v in record.items() if v is not None]
    for name, before, after in zip(names, ["", *names], [*names[1:], ""], strict=False):
        value = record[name]
        mine = fields[name]
        mine += ("t:" + json_type(value), "b:" + before, "a:" + after)
        _features(value, mine)
        if type(value) is list:
            for item in value:
                if type(item) is dict:
                    for sub, x in item.items():
                        if x is not None:
                            nested = fields[f"{name}{_SEP}{sub}"]
                            nested.append("t:" + json_type(x))
                            _features(x, nested)


def _profile(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines -> (file_id, field, profile), summed over the batch; a profile is a JSON object of counted features."""
    for part in parts:
        files: dict[int, dict[str, list[str]]] = {}
        for key, body in zip(part["file_id"].tolist(), part["body"].tolist(), strict=True):
            record = read_object(body)
            if record is not None:
                if key not in files:
                    files[key] = defaultdict(list)
                _describe(record, files[key])
        rows = [(key, name, json.dumps(_sketched(Counter(f)))) for key, fields in files.items() for name, f in fields.items()]
        yield pd.DataFrame(rows, columns=["file_id", "field", "profile"])


def _merged(keys: list[str]):
    """Profiles of equal keys summed; rows come sorted by the keys, and one sum is held at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        total: dict[str, int] = {}
        alone = ""  # the text of a profile that nothing was added to yet
        columns = [*keys, "profile"]
        for part in parts:
            rows = []
            for *key, profile in part[columns].itertuples(index=False, name=None):
                if key != held:
                    if held is not None:
                        rows.append((*held, alone or json.dumps(total)))
                    held, alone = key, profile
                    continue
                if alone:
                    total, alone = json.loads(alone), ""
                for f, n in json.loads(profile).items():
                    total[f] = total.get(f, 0) + n
                _sketched(total)
            yield pd.DataFrame(rows, columns=columns)
        if held is not None:
            yield pd.DataFrame([(*held, alone or json.dumps(total))], columns=columns)

    return run


def _merge(profiles: DataFrame, *keys: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in profiles.schema}
    rows = profiles.select(*keys, "profile").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(_merged(list(keys)), ", ".join(f"{k} {types[k]}" for k in keys) + ", profile string")


def _identified(lines: DataFrame) -> DataFrame:
    """Lines of files with stream, name and opening time, and a 64-bit identifier of the file."""
    rows = lines.dropna(subset=["stream", "file_name", "opened_at"]).select(
        "stream", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"), "file_name", "line_no", "body"
    )
    return rows.withColumn("file_id", F.xxhash64("stream", "opened_at", "file_name"))


def file_places(lines: DataFrame) -> DataFrame:
    """(file_id, stream, opened_at, file_name, k, next_id): every file's place in its stream, from 1."""
    order = Window.partitionBy("stream").orderBy("opened_at", "file_name")
    files = _identified(lines).select("file_id", "stream", "opened_at", "file_name").distinct()
    return files.withColumn("k", F.row_number().over(order)).withColumn("next_id", F.lead("file_id").over(order))


def file_profiles(lines: DataFrame) -> DataFrame:
    """(file_id, field, profile): one summed profile for each field of every file."""
    rows = _identified(lines).select("file_id", "body")
    return _merge(rows.mapInPandas(_profile, "file_id long, field string, profile string"), "file_id", "field")


class Schema:
    """The schema graph of one file."""

    def __init__(self, profiles: dict[str, dict[str, int]], structured: bool):
        fields = {field: features for field, features in profiles.items() if field}
        self._parts: dict[str, dict[str, dict[str, int]]] = {}
        for field, features in fields.items():
            mine: dict[str, dict[str, int]] = {}
            for f, n in features.items():
                mine.setdefault(f[0], {})[f[2:]] = n
            self._parts[field] = mine
        self.features = fields
        self.top = sorted(f for f in fields if _SEP not in f)
        self.types: dict[str, str] = {}
        for name in fields:
            kinds = {k: n for k, n in self.part(name, "t").items() if k not in ("array", "")}
            self.types[name] = min(kinds, key=lambda k: (-kinds[k], k)) if kinds else ""
        self._items: dict[str, dict[str, str]] = {}
        for f in fields:
            if _SEP in f:
                array, item = f.split(_SEP, 1)
                self._items.setdefault(array, {})[item] = f
        self.before = {f: self._neighbours(f, "b") for f in self.top}
        self.after = {f: self._neighbours(f, "a") for f in self.top}
        self.shares = {(f, m): _spread(_shares(v)) if m == "m" else _shares(v) for f, parts in self._parts.items() for m, v in parts.items()}
        self.symbols = self._symbols_array() if structured else None

    def _neighbours(self, field: str, mark: str) -> dict[str, float]:
        return _shares(self.part(field, mark))

    def items(self, array: str) -> dict[str, str]:
        """Item fields of an array -> their full names."""
        return self._items.get(array, {})

    def _symbols_array(self) -> str | None:
        """The array of symbols, whatever its name: its items carry symbol names, kinds and lines."""
        best, found = 0.0, None
        for f in self.top:
            if self.types[f] != "array<object>":
                continue
            items = self.items(f)
            score = sum(max((name_similarity(i, s) for s in SYMBOL_ITEMS), default=0.0) >= 0.6 for i in items)
            score += f == "symbols"
            if score > best:
                best, found = score, f
        return found

    def part(self, field: str, mark: str) -> dict[str, int]:
        return self._parts[field].get(mark, {})


def _shares(counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values()) or 1
    return {k: n / total for k, n in counts.items()}


def _spread(shares: dict[str, float]) -> dict[str, float]:
    """A histogram of magnitudes with half of each share in the two next classes: files of few lines fill few classes."""
    out: dict[str, float] = {}
    for k, x in shares.items():
        for near, part in ((-1, 0.25), (0, 0.5), (1, 0.25)):
            key = str(int(k) + near)
            out[key] = out.get(key, 0.0) + part * x
    return out


@lru_cache(maxsize=10_000)
def _words(name: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name))


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    """0..1 from shared words and trigrams."""
    if a == b:
        return 1.0
    wa, wb = set(_words(a)), set(_words(b))
    if wa and wa == wb:
        return 0.98
    words = len(wa & wb) / max(1, min(len(wa), len(wb)))
    grams = [{f" {x.lower()} "[k : k + 3] for k in range(len(x))} for x in ("".join(_words(a)), "".join(_words(b)))]
    dice = 2 * len(grams[0] & grams[1]) / max(1, len(grams[0]) + len(grams[1]))
    prefix = min(len(a), len(b)) >= 3 and (a.lower().startswith(b.lower()) or b.lower().startswith(a.lower()))
    return max(0.8 * words, dice, 0.75 * prefix)


_WEIGHTS = (("s", 3.0), ("k", 3.0), ("i", 4.0), ("m", 4.0), ("l", 1.0), ("n", 1.0))


def value_similarity(a: Schema, fa: str, b: Schema, fb: str) -> float:
    """0..1: whether the same kind of values goes on; 0 for different types."""
    ta, tb = a.types[fa], b.types[fb]
    if ta != tb or not ta:
        return 0.0
    total = got = 0.0
    for mark, weight in _WEIGHTS:
        pa, pb = a.shares.get((fa, mark)), b.shares.get((fb, mark))
        if pa or pb:
            if pa and pb:
                if len(pa) > len(pb):
                    pa, pb = pb, pa
                share = sum(min(x, pb[k]) for k, x in pa.items() if k in pb)
                got += weight * (share if mark != "m" else min(1.0, share * 1.5))
            total += weight
    score = got / total if total else 1.0
    va, vb = a.part(fa, "v"), b.part(fb, "v")
    if va and vb:
        # repeated values tell more: a field of few values must go on with the same ones
        few_a, few_b = (1 - len(v) / max(1, sum(v.values())) for v in (va, vb))
        repeating = math.sqrt(max(0.0, few_a) * max(0.0, few_b))
        same = len(va.keys() & vb.keys()) / max(1, min(len(va), len(vb)))
        score = score * (1 - 0.6 * repeating) + same * 0.6 * repeating + 0.25 * same * (1 - repeating) - 0.3 * abs(few_a - few_b)
    return max(0.0, min(1.0, score))


#: Share of a pair's score that comes from the pairs around it; what of that an array takes from
#: its item fields, and a change of scores that counts as none.
FLOW, FROM_ITEMS, STILL = 0.2, 0.5, 1e-4


def _first_scores(a: Schema, fields_a: list[str], b: Schema, fields_b: list[str]) -> dict[tuple[str, str], float]:
    """Scores from names and values alone, 1 for fields of one name."""
    start = {}
    for x in fields_a:
        name = x.rsplit(_SEP, 1)[-1]
        for y in fields_b:
            if x == y:
                start[x, y] = 1.0
                continue
            values = value_similarity(a, x, b, y)
            if values > 0:
                start[x, y] = 0.65 * values + 0.35 * name_similarity(name, y.rsplit(_SEP, 1)[-1]) * min(1.0, 2 * values)
    return start


def flooded(a: Schema, b: Schema, fields_a: list[str] | None = None, fields_b: list[str] | None = None) -> dict[tuple[str, str], float]:
    """Converged scores of field pairs: of top-level fields, and of item fields of arrays that may correspond.

    Edges lead from a pair of fields to the pairs of their neighbours before and
    after in the record, and between a pair of arrays and the pairs of their items.
    Every round moves a pair's score by at most ``FLOW`` times the largest change
    around it, so the scores converge; rounds end when nothing moves by ``STILL``.
    ``fields_a`` and ``fields_b`` limit the pairs; all fields are taken without them.
    """
    tops_a, tops_b = (s.top if f is None else [x for x in f if _SEP not in x] for s, f in ((a, fields_a), (b, fields_b)))
    start = _first_scores(a, tops_a, b, tops_b)
    inner: dict[tuple[str, str], list[tuple[str, str]]] = {}
    parent: dict[tuple[str, str], tuple[str, str]] = {}
    arrays = [p for p in start if a.items(p[0]) and b.items(p[1])]
    if fields_a is not None:  # items without their arrays
        arrays += [p for p in {(x.split(_SEP)[0], y.split(_SEP)[0]) for x in fields_a if _SEP in x for y in fields_b if _SEP in y} if p not in start]
    for x, y in arrays:
        ia, ib = a.items(x), b.items(y)
        # items of one name correspond whatever their arrays are called
        pairs = {(f, g): (1.0 if i == j else s) for i, f in ia.items() for j, g in ib.items() for s in [_first_scores(a, [f], b, [g]).get((f, g))] if i == j or s is not None}
        inner[x, y] = list(pairs)
        for p, s in pairs.items():
            start[p] = s
            parent[p] = (x, y)
    fixed = {p for p in start if p[0].rsplit(_SEP, 1)[-1] == p[1].rsplit(_SEP, 1)[-1] and (p in parent or p[0] == p[1])}
    scores = dict(start)
    moving = [p for p in start if p not in fixed]
    while True:
        change = 0.0
        new = {}
        for pair in moving:
            x, y = pair
            if pair in parent:
                flow = scores.get(parent[pair], 0.0)
            else:
                flow = 0.0
                for na, nb in ((a.before.get(x, {}), b.before.get(y, {})), (a.after.get(x, {}), b.after.get(y, {}))):
                    for p, wp in na.items():
                        if p == "" or (p, p) in scores:
                            flow += min(wp, nb.get(p, 0.0))
                        else:
                            flow += wp * sum(wq * scores.get((p, q), 0.0) for q, wq in nb.items() if q != p) * 0.5
                flow = min(1.0, flow)
                if pair in inner:
                    best: dict[str, float] = {}
                    for f, g in inner[pair]:
                        best[f] = max(best.get(f, 0.0), scores[f, g])
                    flow = (1 - FROM_ITEMS) * flow + FROM_ITEMS * sum(best.values()) / max(len(a.items(x)), len(b.items(y)))
            score = (1 - FLOW) * start[pair] + FLOW * flow
            change = max(change, abs(score - scores[pair]))
            new[pair] = score
        scores.update(new)
        if change < STILL:
            return scores


def select(scores: dict[tuple[str, str], float], gone: list[str], come: list[str]) -> dict[str, str]:
    """One-to-one correspondences, best scores first; old name -> new name."""
    taken: dict[str, str] = {}
    used: set[str] = set()
    order = sorted(((s, x, y) for (x, y), s in scores.items() if x in gone and y in come), key=lambda t: (-t[0], t[1], t[2]))
    for score, x, y in order:
        if score >= ACCEPT and x not in taken and y not in used:
            taken[x] = y
            used.add(y)
    return taken


def compare(a: Schema, b: Schema) -> list[tuple[str, str, str]]:
    """(field, new_field, change) from the earlier schema to the later."""
    out: list[tuple[str, str, str]] = []
    scores: dict[tuple[str, str], float] | None = None

    def sets(fa: dict[str, str], fb: dict[str, str], label) -> None:
        """fa, fb: short name -> full name."""
        nonlocal scores
        gone = sorted(fa.keys() - fb.keys())
        come = sorted(fb.keys() - fa.keys())
        renamed: dict[str, str] = {}
        if gone and come:
            scores = flooded(a, b) if scores is None else scores
            full = select(scores, [fa[g] for g in gone], [fb[c] for c in come])
            short_a, short_b = {v: k for k, v in fa.items()}, {v: k for k, v in fb.items()}
            renamed = {short_a[x]: short_b[y] for x, y in full.items()}
        out.extend((label(x), label(y), "renamed") for x, y in renamed.items())
        out.extend((label(x), "", "removed") for x in gone if x not in renamed)
        out.extend((label(y), "", "added") for y in come if y not in renamed.values())
        for x in sorted(fa.keys() & fb.keys()):
            ta, tb = a.types[fa[x]], b.types[fb[x]]
            if ta and tb and ta != tb:
                out.append((label(x), "", "retyped"))

    sets({f: f for f in a.top}, {f: f for f in b.top}, str)
    array = a.symbols
    if array and array == b.symbols and not any(array in (f, n) for f, n, _ in out):
        sets(a.items(array), b.items(array), lambda item: f"{array}.{item}")
    return out


def _compare_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (pair, later, structured, field, profile) come sorted by pair; one pair of files is held at a time."""
    held: int | None = None
    sides: tuple[dict, dict] = ({}, {})
    structured = False

    def changes() -> list[tuple]:
        a, b = (Schema({f: json.loads(p) for f, p in side.items()}, structured) for side in sides)
        return [(held, *change) for change in compare(a, b)]

    columns = ["file_id", "field", "new_field", "change"]
    for part in parts:
        rows: list[tuple] = []
        for pair, later, kind, field, profile in part.itertuples(index=False, name=None):
            if pair != held:
                if held is not None:
                    rows += changes()
                held, sides, structured = pair, ({}, {}), kind
            sides[later][field] = profile
        yield pd.DataFrame(rows, columns=columns)
    if held is not None:
        yield pd.DataFrame(changes(), columns=columns)


def _all_changes(lines: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Every profile row goes to its file as the later one of a pair, and to the next file as the earlier one."""
    places = materialise(file_places(lines), "file-places")
    known = places.select("file_id", "k", "next_id", F.startswith("stream", F.lit("ir-")).alias("structured"))
    placed = (file_profiles(lines) if profiles is None else profiles).join(known, "file_id")
    sides = F.array(
        F.struct(F.when(F.col("k") > 1, F.col("file_id")).alias("pair"), F.lit(True).alias("later")),
        F.struct(F.col("next_id").alias("pair"), F.lit(False).alias("later")),
    )
    rows = placed.select(F.explode(sides).alias("side"), "structured", "field", "profile").filter("side.pair is not null")
    rows = rows.select("side.pair", "side.later", "structured", "field", "profile")
    sorted_rows = rows.repartition(cpu_tasks(lines, 2), "pair").sortWithinPartitions("pair")
    changes = sorted_rows.mapInPandas(_compare_pairs, "file_id long, field string, new_field string, change string")
    names = places.select("file_id", "stream", F.col("k").alias("pair"), "file_name")
    return changes.join(names, "file_id").select("stream", "pair", "file_name", "field", "new_field", "change")


def schema_changes(lines: DataFrame) -> DataFrame:
    """(file_name, field, new_field, change) of every file against the one before it in its stream.

    Files of a stream are ordered by opened_at, then name; a stream's first file
    has no changes. Lines that are no JSON object are ignored; a file without any
    readable line has no fields. ``new_field`` is '' unless renamed. A field that
    held only empty arrays has no type and is not retyped.
    """
    return _all_changes(lines).select("file_name", "field", "new_field", "change")


def _joined(names: list[str], together: set[tuple[str, str]], evidence: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Name -> its group. Evidence is taken best first; names that stand in one file are different fields."""
    groups = {n: [n] for n in names}
    for x, y in evidence:
        if x not in groups or y not in groups:
            continue
        a, b = groups[x], groups[y]
        if a is b or any((p, q) in together for p in a for q in b):
            continue
        a.extend(b)
        for n in b:
            groups[n] = a
    return groups


def one_schema(
    profiles: dict[str, dict[str, int]], together: set[tuple[str, str]], renames: list[tuple[str, str, int]], first: dict[str, object], structured: bool
) -> dict[str, str]:
    """Field -> canonical field of one kind of stream, from its pooled profile; items as array, separator, item.

    ``together`` has the pairs of fields of one file, in both orders, ``renames`` the
    counted renames of all its streams, ``first`` where a field came first: the
    canonical name of a group.
    """

    def groups(schema: Schema, fields: list[str], pairs: set, moved: list) -> dict[str, list[str]]:
        scores = flooded(schema, schema, fields, fields)
        flowing = sorted((-s, x, y) for (x, y), s in scores.items() if x < y and s >= ACCEPT)
        found = [(x, y) for x, y, _ in sorted(moved, key=lambda m: (-m[2], m[0], m[1]))]
        return _joined(fields, pairs, found + [(x, y) for _, x, y in flowing])

    whole = Schema(profiles, False)
    tops = groups(whole, whole.top, together, [m for m in renames if "." not in m[0]])
    out = {n: min(g, key=lambda m: (first[m], m)) for n, g in tops.items()}
    if not structured:
        return out
    under: dict[str, set[str]] = defaultdict(set)
    for f in whole.features:
        if _SEP in f:
            array, item = f.split(_SEP, 1)
            under[out.get(array, array)].add(item)
    score = lambda array: sum(max(name_similarity(i, s) for s in SYMBOL_ITEMS) >= 0.6 for i in under[array])
    array = max(sorted(under), key=lambda a: (score(a) + (a == "symbols"), a), default=None)
    if array is None or not score(array):
        return out
    same = lambda f: _SEP in f and out.get(f.split(_SEP, 1)[0]) == array
    place = lambda f: f"{array}{_SEP}{f.split(_SEP, 1)[1]}"
    united: dict[str, dict[str, int]] = defaultdict(dict)
    for f in filter(same, profiles):
        for x, n in profiles[f].items():
            united[place(f)][x] = united[place(f)].get(x, 0) + n
    items = Schema({f: _sketched(x) for f, x in united.items()}, False)
    pairs = {(place(x), place(y)) for x, y in together if same(x) and same(y)}
    moved: Counter = Counter()
    for x, y, n in renames:
        head, _, item = x.partition(".")
        if item and out.get(head) == array:
            moved[f"{array}{_SEP}{item}", f"{array}{_SEP}{y.partition('.')[2]}"] += n
    begun: dict[str, object] = {}
    for f in filter(same, first):
        begun[place(f)] = min(begun.get(place(f), first[f]), first[f])
    inner = groups(items, sorted(items.features), pairs, [(x, y, n) for (x, y), n in moved.items()])
    for f in filter(same, whole.features):
        out[f] = min(inner[place(f)], key=lambda m: (begun[m], m))
    return out


def _kind(stream: str = "stream"):
    return F.substring_index(stream, "-", 1)


def canonical_names(lines: DataFrame) -> dict[tuple[str, str], str]:
    """(kind, field) -> canonical field, one consistent schema for all streams of a kind.

    What reaches the driver is bounded by the number of field names: a pooled
    profile (bottom-k sketch of values), pairs of names and counted renames.
    """
    profiles = materialise(file_profiles(lines), "file-profiles")
    places = file_places(lines).select("file_id", _kind().alias("kind"), "opened_at", "stream", "file_name")
    placed = profiles.join(places, "file_id")

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Profiles summed over the batch, as there are few fields and many files."""
        for part in parts:
            sums: dict[tuple, dict[str, int]] = {}
            for kind, field, profile in part.itertuples(index=False, name=None):
                mine = sums.setdefault((kind, field), {})
                for f, n in json.loads(profile).items():
                    mine[f] = mine.get(f, 0) + n
            yield pd.DataFrame([(*k, json.dumps(_sketched(f))) for k, f in sums.items()], columns=["kind", "field", "profile"])

    pooled = _merge(placed.select("kind", "field", "profile").mapInPandas(within, "kind string, field string, profile string"), "kind", "field")
    sets = placed.groupBy("kind", "file_id").agg(F.array_sort(F.collect_set("field")).alias("x")).select("kind", "x").distinct()
    pairs = sets.select("kind", "x", F.explode("x").alias("a")).select("kind", "a", F.explode("x").alias("b")).filter("a <> b").distinct()
    order = F.min(F.struct("opened_at", "stream", "file_name"))
    firsts = placed.groupBy("kind", "field").agg(order.alias("first"))
    moves = _all_changes(lines, profiles).filter("change = 'renamed'").groupBy(_kind().alias("kind"), "field", "new_field").agg(F.count("*").alias("n"))
    by: dict[str, tuple[dict, set, list, dict]] = defaultdict(lambda: ({}, set(), [], {}))
    for r in pooled.collect():
        by[r["kind"]][0][r["field"]] = json.loads(r["profile"])
    for r in pairs.collect():
        by[r["kind"]][1].add((r["a"], r["b"]))
    for r in moves.collect():
        by[r["kind"]][2].append((r["field"], r["new_field"], r["n"]))
    for r in firsts.collect():
        by[r["kind"]][3][r["field"]] = tuple(r["first"])
    return {(k, f): c for k, parts in by.items() for f, c in one_schema(*parts, structured=k == "ir").items()}


_TEXTS = [("text:integer", re.compile(r"0|-?[1-9]\d{0,14}")), ("text:fraction", re.compile(r"-?\d+\.\d+")), ("text:time", _SHAPE[1][0])]


def form(value: object) -> str:
    """Type of a value as casts tell them apart: what a text holds, how many keys the items of an array have."""
    if isinstance(value, str):
        return next((n for n, rx in _TEXTS if rx.fullmatch(value)), "text")
    if isinstance(value, dict):
        parts = value.keys() == {"major", "minor", "patch"} and all(type(x) is int for x in value.values())
        return "version" if parts else "object"
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        keys = {tuple(x) for x in value}
        only = keys.pop() if len(keys) == 1 else ()
        if len(only) == 1 and all(isinstance(x[only[0]], str) for x in value):
            return "array<name>"
        heads = [x[only[0]] for x in value] if len(only) == 2 else []
        if heads and all(isinstance(h, str) for h in heads) and len(set(heads)) == len(heads):
            return "array<entry>"
        return "array<object>"
    if type(value) is int and abs(value) > 2**53:
        return "wide"  # no fraction holds it
    if isinstance(value, list) and len({json_type(x) for x in value if x is not None}) > 1:
        return "array<any>"
    return json_type(value)


def common_type(forms: set[str]) -> str:
    """The type all forms of a field can be cast to without loss."""
    if "wide" in forms:
        return "integer" if forms <= {"wide", "integer", "text:integer"} else "string"
    texts = {f for f in forms if f.startswith("text")}
    rest = forms - texts
    if not rest or "version" in rest and rest == {"version"} and texts:
        return "string"
    if rest == {"version"}:
        return "object"
    if rest <= {"integer", "fraction"} and texts <= {"text:integer", "text:fraction"}:
        return "integer" if rest == {"integer"} and texts <= {"text:integer"} else "fraction"
    if not texts and rest <= {"object", "version", "array<entry>", "array"} and rest & {"object", "version"}:
        return "object"
    if rest <= {"array", "array<string>", "array<name>"}:
        return "array<string>" if texts or "array<string>" in rest else "array<object>" if "array<name>" in rest else "array"
    if rest <= {"array", "array<string>", "array<name>", "array<entry>", "array<object>"}:
        return "array<object>"
    typed = rest - {"array"}
    return next(iter(typed)) if not texts and len(typed) == 1 and (len(rest) == 1 or next(iter(typed)).startswith("array")) else "string"


def _time_text(ms: int) -> str:
    at = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    return at.isoformat(timespec="milliseconds" if ms % 1000 else "seconds") + "Z"


def cast(value: object, to: str, times: bool = False, lead: str = "name", kind_item: str = "") -> object:
    """A value as the common type of its field.

    ``times``: integers beside texts of times are milliseconds since 1970. ``lead`` is the item
    field that names in an array without item fields have; ``kind_item`` that of a kind before a colon.
    """
    if to == "string" and not isinstance(value, str):
        if times and type(value) is int and abs(value) < 250_000_000_000_000:
            return _time_text(value)
        if form(value) == "version":
            return f"{value['major']}.{value['minor']}.{value['patch']}"
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    if to == "integer":
        return int(value)
    if to == "fraction":
        return float(value)
    if to == "object" and isinstance(value, list):
        return dict(tuple(x.values()) for x in value)
    if to in ("array<string>", "array<object>"):
        items = [x for x in (p.strip() for p in re.split("[,+]", value)) if x] if isinstance(value, str) else value
        if to == "array<string>":
            return [next(iter(x.values())) if isinstance(x, dict) else x for x in items]

        def item(text: str) -> dict:
            head, colon, name = text.partition(":")
            return {kind_item: head, lead: name} if kind_item and colon and head in SYMBOL_KINDS else {lead: text}

        return [item(x) if isinstance(x, str) else x for x in items]
    return value


def _leads(counts: dict[tuple[str, str], Counter]) -> dict[tuple[str, str], str]:
    """Array -> the item field its items begin with most often."""
    return {k: min(c, key=lambda i: (-c[i], i)) for k, c in counts.items()}


def consistent_table(lines: DataFrame) -> DataFrame:
    """Every readable line as (stream, file_name, line_no, field, type, value), fields under their canonical names.

    One row per non-null field; ``type`` is the common type of the field in all
    streams of its kind, ``value`` the value cast to it as JSON text (strings as they
    are). Item fields of the symbols array are renamed and cast inside it. Lines
    delivered several times count once.
    """
    names = canonical_names(lines)
    inner: dict[tuple[str, str], dict[str, str]] = defaultdict(dict)
    for (kind, f), c in names.items():
        if _SEP in f:
            inner[kind, c.split(_SEP, 1)[0]][f.split(_SEP, 1)[1]] = c.split(_SEP, 1)[1]
    inner = dict(inner)

    def read(kind: str, body: str) -> Iterator[tuple[str, object]]:
        for field, value in (read_object(body) or {}).items():
            if value is not None:
                name = names.get((kind, field), field)
                items = inner.get((kind, name))
                if items and isinstance(value, list):
                    value = [{items.get(k, k): x for k, x in v.items()} if isinstance(v, dict) else v for v in value]
                yield name, value

    def forms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: Counter = Counter()
            for kind, body in part.itertuples(index=False, name=None):
                for name, value in read(kind, body):
                    seen[kind, name, form(value), ""] += 1
                    for v in value if isinstance(value, list) else ():
                        if isinstance(v, dict) and v:
                            seen[kind, name, "", next(iter(v))] += 1
                            if (kind, name) in inner:
                                for k, x in v.items():
                                    if x is not None:
                                        seen[kind, f"{name}{_SEP}{k}", form(x), ""] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "field", "form", "lead", "n"])

    once = _identified(lines).drop("file_id").withColumn("kind", _kind())
    found: dict[tuple[str, str], set[str]] = defaultdict(set)
    heads: dict[tuple[str, str], Counter] = defaultdict(Counter)
    told = once.select("kind", "body").mapInPandas(forms, "kind string, field string, form string, lead string, n long")
    for r in told.groupBy("kind", "field", "form", "lead").agg(F.sum("n").alias("n")).collect():
        if r["form"]:
            found[r["kind"], r["field"]].add(r["form"])
        else:
            heads[r["kind"], r["field"]][r["lead"]] += r["n"]
    types = {k: common_type(f) for k, f in found.items()}
    times = {k for k, f in found.items() if "text:time" in f}
    leads = _leads(heads)
    # the item fields that a kind and a name go on under
    kinds = {k: items.get("kind", "kind") for k, items in inner.items()}

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for stream, name, line, kind, body in part.itertuples(index=False, name=None):
                for field, value in read(kind, body):
                    at = (kind, field)
                    to = types[at]
                    value = cast(value, to, at in times, leads.get(at, "name"), kinds.get(at, ""))
                    if at in inner and isinstance(value, list):
                        value = [
                            {k: x if x is None else cast(x, types.get((kind, f"{field}{_SEP}{k}"), ""), (kind, f"{field}{_SEP}{k}") in times) for k, x in v.items()}
                            if isinstance(v, dict) else v for v in value
                        ]
                    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
                    rows.append((stream, name, line, field, to, text))
            yield pd.DataFrame(rows, columns=["stream", "file_name", "line_no", "field", "type", "value"])

    schema = "stream string, file_name string, line_no int, field string, type string, value string"
    rows = once.distinct().select("stream", "file_name", "line_no", "kind", "body")
    return rows.mapInPandas(explode, schema)
