"""A packrat parser generator: grammar text in, Python functions out.

Grammar notation, one rule per ``Name <- expression``:

====================  =====================================================
``"text"``            literal token; a word must end at a word boundary
```` `regex` ````     token given by a regular expression
``Name``              another rule
``a b``, ``a | b``    sequence, ordered choice
``=`regex` ``          the same without the skipped text after it
``@nl``               holds where a line ended in the skipped text before
``a* a+ a? &a !a``    repetition, option, look-ahead, negative look-ahead
``Name{kind} <- ...`` each match is captured as (kind, start, end)
``-Name <- ...``      not memoised (cheap rules)
====================  =====================================================

Every token also takes the skippable text after it. A parse keeps one memo
table per rule, so any position is tried at most once per rule. Offsets are those
of the text parsed. Captures of abandoned alternatives are taken back, and a memo
entry carries its captures.

A grammar is compiled into three programs as they are needed: one that only
recognises, one that captures as well, and one that records the furthest position
at which a token failed, which is run over texts that the others have refused.
Before any sub-expression that begins with known characters the next character is
asked, so most alternatives cost one look-up; rules that are not memoised are put
in where they are used.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

try:
    from re import _constants as _sc
    from re import _parser as _sp
except ImportError:  # pragma: no cover - other Python versions
    import sre_constants as _sc
    import sre_parse as _sp

_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n\s*)*(?:(?P<rule>(?P<plain>-?)(?P<name>[A-Z]\w*)(?:\{(?P<kind>\w+)\})?\s*<-)"""
    r"""|(?P<lit>"(?:[^"\\]|\\.)*")|(?P<raw>=`[^`]*`)|(?P<rx>`[^`]*`)|(?P<ref>[A-Z]\w*)|(?P<nl>@nl)|(?P<op>[()|*+?&!])|(?P<end>\Z))"""
)

#: Depth of rule calls a text may always use, and what its length may add to it. A text that
#: needs more is neither valid nor invalid: a frame takes memory, and no grammar bounds nesting.
DEPTH, DEEPEST, PER_CHARACTER = 40_000, 200_000, 40


@dataclass(frozen=True)
class Parsed:
    """``ok`` if the whole text was consumed, None if it is nested too deeply to tell."""

    ok: bool | None
    captures: tuple[tuple[str, int, int], ...]


def _read(text: str) -> dict[str, tuple]:
    """Rules as name -> (expression, kind, memoised)."""
    at, rules = 0, {}
    tokens: list[tuple[str, str, re.Match]] = []
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        tokens.append((m.lastgroup if m.lastgroup not in ("plain", "name", "kind") else "rule", m[0], m))
        at = m.end()
        if m.lastgroup == "end":
            break
    pos = 0

    def group(m: re.Match) -> str:
        return next(g for g in ("rule", "lit", "raw", "rx", "ref", "nl", "op", "end") if m[g] is not None)

    kinds = [group(t[2]) for t in tokens]

    def choice() -> tuple:
        nonlocal pos
        parts = [sequence()]
        while kinds[pos] == "op" and tokens[pos][2]["op"] == "|":
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("choice", tuple(parts))

    def sequence() -> tuple:
        nonlocal pos
        parts = []
        while kinds[pos] in ("lit", "raw", "rx", "ref", "nl") or (kinds[pos] == "op" and tokens[pos][2]["op"] in "(&!"):
            parts.append(item())
        return parts[0] if len(parts) == 1 else ("seq", tuple(parts))

    def item() -> tuple:
        nonlocal pos
        m = tokens[pos][2]
        if m["op"] in ("&", "!"):
            pos += 1
            return ("and" if m["op"] == "&" else "not", item())
        if m["op"] == "(":
            pos += 1
            e = choice()
            if tokens[pos][2]["op"] != ")":
                raise ValueError("grammar: ) missing")
        elif m["lit"]:
            word = m["lit"][1:-1].replace('\\"', '"').replace("\\\\", "\\")
            e = ("tok", re.escape(word) + (r"(?![\w$])" if re.match(r"\w", word[-1]) else ""))
        elif m["rx"]:
            e = ("tok", m["rx"][1:-1])
        elif m["raw"]:
            e = ("raw", m["raw"][2:-1])
        elif m["nl"]:
            e = ("nl",)
        else:
            e = ("ref", m["ref"])
        pos += 1
        while kinds[pos] == "op" and tokens[pos][2]["op"] in ("*", "+", "?"):
            e = ({"*": "star", "+": "plus", "?": "opt"}[tokens[pos][2]["op"]], e)
            pos += 1
        return e

    while kinds[pos] != "end":
        m = tokens[pos][2]
        if kinds[pos] != "rule":
            raise ValueError(f"grammar: {tokens[pos][1]!r} outside a rule")
        pos += 1
        rules[m["name"]] = (choice(), m["kind"], not m["plain"])
    return rules


def line_ended(text: str, at: int) -> bool:
    """Whether the blanks and comments that end at ``at`` hold a line end (or the text ends there)."""
    if at == len(text):
        return True
    while at > 0:
        c = text[at - 1]
        if c in "\n\r\u2028\u2029":
            return True
        if c.isspace() or c == "\ufeff":
            at -= 1
        elif c == "/" and text[at - 2 : at] == "*/":
            start = text.rfind("/*", 0, at - 2)
            if start < 0:
                return False
            if "\n" in text[start:at]:
                return True
            at = start
        else:
            return False
    return False


_ASCII = frozenset(map(chr, range(128)))


#: ASCII characters a match can begin with (None if that is unclear), and whether it can be empty.
First = tuple[frozenset | None, bool]
_NONE: First = (frozenset(), False)


def _either(parts: list[First]) -> First:
    sets = [s for s, _ in parts]
    return (None if any(s is None for s in sets) else frozenset().union(*sets)), any(empty for _, empty in parts)


def _after(parts: Iterator[First]) -> First:
    """Of a sequence: what its parts can begin with up to the first that cannot be empty."""
    got: frozenset | None = frozenset()
    for mine, empty in parts:
        got = None if got is None or mine is None else got | mine
        if not empty:
            return got, False
    return got, True


def _first_of_regex(pattern: str, flags: int) -> First:
    return _of_pattern(_sp.parse(pattern, flags))


_CATEGORIES = {
    _sc.CATEGORY_DIGIT: r"\d", _sc.CATEGORY_NOT_DIGIT: r"\D", _sc.CATEGORY_SPACE: r"\s", _sc.CATEGORY_NOT_SPACE: r"\S",
    _sc.CATEGORY_WORD: r"\w", _sc.CATEGORY_NOT_WORD: r"\W",
}


def _of_pattern(pattern) -> First:
    def of(op, arg) -> First:
        if op is _sc.LITERAL:
            return frozenset([chr(arg)]), False
        if op is _sc.NOT_LITERAL:
            return _ASCII - {chr(arg)}, False
        if op is _sc.ANY:
            return _ASCII, False
        if op is _sc.IN:
            chars: set[str] = set()
            negate = False
            for o, a in arg:
                if o is _sc.NEGATE:
                    negate = True
                elif o is _sc.LITERAL:
                    chars.add(chr(a))
                elif o is _sc.RANGE:
                    chars.update(chr(c) for c in range(a[0], min(a[1], 127) + 1))
                elif o is _sc.CATEGORY:
                    chars.update(c for c in _ASCII if re.match(_CATEGORIES[a], c))
            return (_ASCII - chars if negate else frozenset(chars) & _ASCII), False
        if op is _sc.BRANCH:
            return _either([_of_pattern(x) for x in arg[1]])
        if op is _sc.SUBPATTERN:
            return _of_pattern(arg[3])
        if op in (_sc.MAX_REPEAT, _sc.MIN_REPEAT, _sc.POSSESSIVE_REPEAT):
            got, empty = _of_pattern(arg[2])
            return got, empty or arg[0] == 0
        if op in (_sc.AT, _sc.ASSERT, _sc.ASSERT_NOT):
            return frozenset(), True
        return None, True

    return _after(of(op, arg) for op, arg in pattern)


def _skip_starts(skip: str, flags: int) -> frozenset | None:
    """Characters with which skippable text can begin; None if unclear."""
    return _first_of_regex(skip, flags)[0]


class Grammar:
    """Compiled rules; ``parse`` runs the rule ``start`` over a whole text."""

    def __init__(self, text: str, skip: str, start: str = "File", flags: int = 0, memo: str = ""):
        """``memo`` names the rules that are memoised, if not all are: those tried more than once at a position."""
        self.rules = _read(text)
        if memo:
            kept = frozenset(memo.split())
            self.rules = {n: (e, kind, m and n in kept) for n, (e, kind, m) in self.rules.items()}
        self.plain = frozenset(re.findall(r"^\s*-([A-Z]\w*)", text, re.M))
        self.skip, self.flags, self.start = skip, flags, start
        self._firsts: dict[str, First] = {}
        self._regex_firsts: dict[str, First] = {}
        self._programs: dict[str, Callable] = {}
        self._capturing = {name for name, (_, kind, _) in self.rules.items() if kind}
        grown = True
        while grown:
            more = {n for n, (e, _, _) in self.rules.items() if n not in self._capturing and self.captures(e)}
            self._capturing |= more
            grown = bool(more)
        for e in (e for e, _, _ in self.rules.values()):
            self._known(e)
        self._compute_firsts()

    def _known(self, e: tuple) -> None:
        if e[0] == "ref" and e[1] not in self.rules:
            raise ValueError(f"grammar: no rule {e[1]}")
        for x in e[1] if e[0] in ("seq", "choice") else e[1:] if e[0] not in ("tok", "raw", "ref", "nl") else ():
            self._known(x)

    def captures(self, e: tuple) -> bool:
        """Whether a match of the expression can capture."""
        if e[0] == "ref":
            return e[1] in self._capturing
        if e[0] in ("seq", "choice"):
            return any(self.captures(x) for x in e[1])
        return e[0] in ("star", "plus", "opt") and self.captures(e[1])

    def _program(self, kind: str) -> Callable:
        if kind not in self._programs:
            self._programs[kind] = _Writer(self, capture=kind == "capture", track=kind == "track").program()
        return self._programs[kind]

    def _run(self, kind: str, text: str) -> tuple[int | None, object]:
        program = self._program(kind)
        limit = min(DEEPEST, max(DEPTH, PER_CHARACTER * len(text)))
        if sys.getrecursionlimit() < limit:
            sys.setrecursionlimit(limit)
        try:
            return program(text)
        except RecursionError:
            return None, None

    def accepts(self, text: str) -> bool | None:
        """Whether the whole text matches; None if it is nested too deeply to tell."""
        end, _ = self._run("plain", text)
        return None if end is None else end == len(text)

    def parse(self, text: str) -> Parsed:
        end, found = self._run("capture", text)
        ok = None if end is None else end == len(text)
        return Parsed(ok, tuple(found) if ok else ())

    def furthest(self, text: str) -> int:
        """The furthest position at which a token failed; the length of a text that matches."""
        end, furthest = self._run("track", text)
        return 0 if end is None else len(text) if end == len(text) else max(furthest, end)

    # -- first sets

    def _compute_firsts(self) -> None:
        """Least solution for all rules at once, as they refer to each other."""
        self._firsts = dict.fromkeys(self.rules, _NONE)
        changed = True
        while changed:
            changed = False
            for name, (e, _, _) in self.rules.items():
                got = self.first(e)
                if got != self._firsts[name]:
                    self._firsts[name] = got
                    changed = True

    def first(self, e: tuple) -> First:
        op = e[0]
        if op in ("tok", "raw"):
            if e[1] not in self._regex_firsts:
                self._regex_firsts[e[1]] = _first_of_regex(e[1], self.flags)
            return self._regex_firsts[e[1]]
        if op == "ref":
            return self._firsts[e[1]]
        if op == "choice":
            return _either([self.first(x) for x in e[1]])
        if op == "seq":
            return _after(self.first(x) for x in e[1])
        if op in ("star", "opt"):
            return self.first(e[1])[0], True
        if op == "plus":
            return self.first(e[1])
        return frozenset(), True

    def begins(self, e: tuple) -> frozenset | None:
        """The ASCII characters one of which every match begins with, None if it can be empty, is unclear or begins with almost any."""
        got, empty = self.first(e)
        return None if got is None or empty or len(got) >= _FEW else got


_PLAIN_TOKEN = re.compile(r"(?:\\[^\w\s]|[^\w\s\\.^$*+?{}\[\]()|])+")
#: Longer first sets do not pay for asking; deeper blocks become functions of their own.
_FEW, _DEEP = 100, 40
#: Rules without memo and of at most so many parts are put in where they are used.
_SMALL = 4


def _size(e: tuple) -> int:
    """Number of parts of an expression."""
    if e[0] in ("seq", "choice"):
        return 1 + sum(map(_size, e[1]))
    return 1 if e[0] in ("tok", "raw", "ref", "nl") else 1 + _size(e[1])


class _Writer:
    """Writes one program of a grammar as Python source: one function a rule, all sharing the text and the memo tables.

    The tables are emptied, not made anew, for each text: closures made for each would be cyclic garbage.
    """

    def __init__(self, grammar: Grammar, capture: bool, track: bool):
        self.g, self.capture, self.track = grammar, capture, track
        self.space: dict[str, object] = {"line_ended": line_ended, "skip": re.compile(grammar.skip, grammar.flags).match}
        self.tokens: dict[str, str] = {}
        self.sets: dict[frozenset, str] = {}
        self.tables: dict[tuple, str] = {}
        self.helpers: list[str] = []
        self.n = self.parts = 0
        self.inlining: list[str] = []
        starts = _skip_starts(grammar.skip, grammar.flags)
        self.may_skip = None if starts is None else self._set(starts)

    def program(self) -> Callable:
        body: list[str] = []
        for name, (e, kind, memo) in self.g.rules.items():
            body += self._rule(name, e, kind, memo)
        memos = "".join(f"D_{name}, " for name, (_, _, memo) in self.g.rules.items() if memo)
        lines = ["def program():", " s, C, F, sw = '', [], 0, ''.startswith"]
        lines += [f" {line}" for line in [*body, *self.helpers]]
        lines += [
            f" memos = ({memos})", " def run(text):", "  nonlocal s, F, sw", "  s, F, sw = text, 0, text.startswith", "  C.clear()",
            "  for D in memos: D.clear()", f"  end = r_{self.g.start}(skip(s, 0).end())", f"  return end, {'F' if self.track else 'C'}", " return run",
        ]
        exec(compile("\n".join(lines), "<grammar>", "exec"), self.space)  # noqa: S102 - our own generated text
        return self.space["program"]()

    def _var(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def _set(self, chars: frozenset) -> str:
        if chars not in self.sets:
            self.sets[chars] = f"s{len(self.sets)}"
            self.space[self.sets[chars]] = chars
        return self.sets[chars]

    def _cannot(self, e: tuple) -> str | None:
        """Name of the set of characters (and the end of the text, '') with which no match begins."""
        first = self.g.begins(e)
        return None if first is None else self._set((_ASCII - first) | {""})

    def _token(self, pattern: str, skip: str) -> str:
        key = f"(?:{pattern})(?:{skip})"
        if key not in self.tokens:
            self.tokens[key] = f"t{len(self.tokens)}"
            self.space[self.tokens[key]] = re.compile(key, self.g.flags).match
        return self.tokens[key]

    def _caps(self, e: tuple) -> bool:
        return self.capture and self.g.captures(e)

    def _failed(self, at: str, pad: str) -> list[str]:
        return [f"{pad}if {at} > F: F = {at}"] if self.track else []

    def _head(self, name: str, argument: str = "p") -> list[str]:
        return [f"def {name}({argument}):", *([" nonlocal F"] if self.track else [])]

    def _rule(self, name: str, e: tuple, kind: str | None, memo: bool) -> list[str]:
        kind = kind if self.capture else None
        caps = self.capture and name in self.g._capturing
        out = [f"D_{name} = {{}}", f"G_{name} = D_{name}.get"] if memo else []
        out += self._head(f"r_{name}")
        if memo:
            out += [f" r = G_{name}(p)", " if r is not None:"]
            out += ["  if r[1]: C.extend(r[1])", "  return r[0]"] if caps else ["  return r"]
        if caps:
            out += [" n0 = len(C)"]
        if kind:
            out += [f" C.append(({kind!r}, p, -1))"]
        self.n = 0
        v = self._var()
        self.inlining = [name]
        out += self._gen(e, "p", v, " ")
        if kind:
            # a captured end leaves out the skipped text after the last token
            out += [f" if {v} >= 0: C[n0] = ({kind!r}, p, {v})"]
        if caps:
            out += [f" if {v} < 0 and len(C) > n0: del C[n0:]"]
        if memo:
            out += [f" D_{name}[p] = ({v}, tuple(C[n0:]) if len(C) > n0 else None)" if caps else f" D_{name}[p] = {v}"]
        return [*out, f" return {v}"]

    def _gen(self, e: tuple, at: str, out: str, pad: str, char: str | None = None) -> list[str]:
        """Statements that set ``out`` to the end of a match at ``at``, or -1; ``char`` holds the character there."""
        if len(pad) > _DEEP and e[0] in ("seq", "choice", "star", "plus", "opt"):
            self.parts += 1
            name, v = f"h_{self.parts}", self._var()
            self.helpers += [*self._head(name), *self._gen(e, "p", v, " "), f" return {v}"]
            return [f"{pad}{out} = {name}({at})"]
        # what an expression keeps inside is done with at its end: few locals make cheap calls
        n = self.n
        lines = getattr(self, f"_{e[0]}")(e, at, out, pad, char)
        self.n = n
        return lines

    def _nl(self, e, at, out, pad, char) -> list[str]:
        return [f"{pad}{out} = {at} if line_ended(s, {at}) else -1"]

    def _tok(self, e, at, out, pad, char) -> list[str]:
        pattern = e[1]
        if self.may_skip and _PLAIN_TOKEN.fullmatch(pattern):
            word = re.sub(r"\\(.)", r"\1", pattern)
            test = f"{char or f's[{at}:{at} + 1]'} == {word!r}" if len(word) == 1 else f"sw({word!r}, {at})"
            return [
                f"{pad}if {test}:", f"{pad} {out} = {at} + {len(word)}", f"{pad} c = s[{out}:{out} + 1]",
                f"{pad} if c in {self.may_skip} or c > '\\x7f': {out} = skip(s, {out}).end()",
                f"{pad}else:", f"{pad} {out} = -1", *self._failed(at, pad + " "),
            ]
        t = self._token(pattern, self.g.skip)
        return [f"{pad}m = {t}(s, {at})", f"{pad}if m is not None: {out} = m.end()", f"{pad}else:", f"{pad} {out} = -1", *self._failed(at, pad + " ")]

    def _raw(self, e, at, out, pad, char) -> list[str]:
        t = self._token(e[1], "")
        return [f"{pad}m = {t}(s, {at})", f"{pad}if m is not None: {out} = m.end()", f"{pad}else:", f"{pad} {out} = -1", *self._failed(at, pad + " ")]

    def _ref(self, e, at, out, pad, char) -> list[str]:
        name = e[1]
        body, kind, memo = self.g.rules[name]
        small = name in self.g.plain or _size(body) <= _SMALL
        if not memo and small and not (kind and self.capture) and name not in self.inlining and len(pad) < _DEEP:
            self.inlining.append(name)
            lines = self._gen(body, at, out, pad, char)
            self.inlining.pop()
            return lines
        return [f"{pad}{out} = r_{name}({at})"]

    def _seq(self, e, at, out, pad, char) -> list[str]:
        parts = e[1]
        if not parts:
            return [f"{pad}{out} = {at}"]
        lines, cur = [f"{pad}{out} = -1"] if len(parts) > 1 else [], at
        for k, x in enumerate(parts):
            last = k == len(parts) - 1
            v = out if last else self._var()
            lines += self._gen(x, cur, v, pad, char if k == 0 else None)
            if not last:
                lines += [f"{pad}if {v} >= 0:"]
                pad += " "
                if len(pad) > _DEEP and len(parts) - k > 2:
                    return [*lines, *self._gen(("seq", parts[k + 1 :]), v, out, pad)]
            cur = v
        return lines

    def _choice(self, e, at, out, pad, char) -> list[str]:
        firsts = [self.g.begins(x) for x in e[1]]
        asked = any(f is not None for f in firsts)
        caps, lines, n = self._caps(e), [], self._var()
        if caps:
            lines += [f"{pad}{n} = len(C)"]
        k = self._var()
        if asked:
            if char is None:
                char = self._var()
                lines += [f"{pad}{char} = s[{at}:{at} + 1]"]
            key = tuple(firsts)
            if key not in self.tables:
                self.tables[key] = f"T{len(self.tables)}"
                always = sum(1 << i for i, f in enumerate(firsts) if f is None)
                table = {**dict.fromkeys(_ASCII, always), "": always}
                for i, f in enumerate(firsts):
                    for c in f or ():
                        table[c] |= 1 << i
                self.space[self.tables[key]] = table.get
            lines += [f"{pad}{k} = {self.tables[key]}({char}, {(1 << len(firsts)) - 1})"]
        lines += [f"{pad}{out} = -1"]
        for i, (x, f) in enumerate(zip(e[1], firsts, strict=True)):
            tests = ([f"{out} < 0"] if i else []) + ([f"{k} & {1 << i}"] if f is not None else [])
            inner = pad
            if tests:
                lines += [f"{pad}if {' and '.join(reversed(tests))}:"]
                inner = pad + " "
            lines += self._gen(x, at, out, inner, char)
            if self._caps(x):
                lines += [f"{inner}if {out} < 0 and len(C) > {n}: del C[{n}:]"]
        if asked and self.track:
            lines += [f"{pad}if {out} < 0:", *self._failed(at, pad + " ")]
        return lines

    def _loop(self, x: tuple, start: str, out: str, pad: str) -> list[str]:
        """Matches of ``x`` from ``start`` on until none follows; ``out`` ends up at the last one's end."""
        cannot, v, n, c = self._cannot(x), self._var(), self._var(), self._var()
        caps = self._caps(x)
        lines = [f"{pad}{out} = {start}"] if out != start else []
        lines += [f"{pad}while True:"]
        if cannot:
            lines += [f"{pad} {c} = s[{out}:{out} + 1]", f"{pad} if {c} in {cannot}:", *self._failed(out, pad + "  "), f"{pad}  break"]
        if caps:
            lines += [f"{pad} {n} = len(C)"]
        lines += self._gen(x, out, v, pad + " ", c if cannot else None)
        lines += [f"{pad} if {v} <= {out}:"]
        if caps:
            lines += [f"{pad}  if len(C) > {n}: del C[{n}:]"]
        return [*lines, f"{pad}  break", f"{pad} {out} = {v}"]

    def _star(self, e, at, out, pad, char) -> list[str]:
        cur = self._var()
        return [*self._loop(e[1], at, cur, pad), f"{pad}{out} = {cur}"]

    def _plus(self, e, at, out, pad, char) -> list[str]:
        first = self._var()
        return [*self._gen(e[1], at, first, pad, char), f"{pad}if {first} >= 0:", *self._loop(e[1], first, first, pad + " "), f"{pad}{out} = {first}"]

    def _opt(self, e, at, out, pad, char) -> list[str]:
        x = e[1]
        cannot, caps, n, v = self._cannot(x), self._caps(x), self._var(), self._var()
        lines = []
        inner = pad
        if cannot:
            if char is None:
                char = self._var()
                lines += [f"{pad}{char} = s[{at}:{at} + 1]"]
            lines += [f"{pad}if {char} in {cannot}:", f"{pad} {v} = -1", *self._failed(at, pad + " "), f"{pad}else:"]
            inner = pad + " "
        if caps:
            lines += [f"{inner}{n} = len(C)"]
        lines += self._gen(x, at, v, inner, char if cannot else None)
        if caps:
            lines += [f"{inner}if {v} < 0 and len(C) > {n}: del C[{n}:]"]
        return [*lines, f"{pad}{out} = {v} if {v} >= 0 else {at}"]

    def _look(self, e, at, out, pad, wanted: bool) -> list[str]:
        x, v, n, f = e[1], self._var(), self._var(), self._var()
        lines = [f"{pad}{n} = len(C)"] if self._caps(x) else []
        lines += [f"{pad}{f} = F"] if self.track and not wanted else []
        lines += self._gen(x, at, v, pad)
        lines += [f"{pad}if len(C) > {n}: del C[{n}:]"] if self._caps(x) else []
        lines += [f"{pad}F = {f}"] if self.track and not wanted else []
        return [*lines, f"{pad}{out} = {at} if {v} {'>=' if wanted else '<'} 0 else -1"]

    def _and(self, e, at, out, pad, char) -> list[str]:
        return self._look(e, at, out, pad, True)

    def _not(self, e, at, out, pad, char) -> list[str]:
        return self._look(e, at, out, pad, False)
