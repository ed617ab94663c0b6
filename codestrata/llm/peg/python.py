"""Python 3 (the language reference's full grammar, 3.13)."""

from __future__ import annotations

import re

from codestrata.llm.peg.engine import Grammar

#: The hard keywords.
KEYWORDS = (
    "False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global"
    "|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield"
)
NEWLINE, INDENT, DEDENT, BAD = "\x1e", "\x0e", "\x0f", "\x00"
_LEX = re.compile(
    r"""(?P<str>(?:(?<=[fF])|(?<=[fF][rR]))(?:\"{3}(?:[^\\{]|\\[\s\S]|\{)*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}"""
    r"""|"(?!"")(?:[^"\\\n{]|\\[\s\S]|\{\{|\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\})*"|'(?!'')(?:[^'\\\n{]|\\[\s\S]|\{\{|\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\})*')"""
    r"""|\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?!"")(?:[^"\\\n\x1e]|\\[\s\S])*"|'(?!'')(?:[^'\\\n\x1e]|\\[\s\S])*')"""
    r"""|(?P<flat>\([^()\[\]{}\n"'\#\\]*\)|\[[^()\[\]{}\n"'\#\\]*\])"""
    r"""|(?P<note>\#[^\n]*)|(?P<join>\\\r?\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<nl>\n)"""
)
_BLANKS = " \t\f\r"
_CODE = frozenset(["str", "flat", "open", "close"])


def _width(blanks: str) -> int:
    column = 0
    for c in blanks:
        column = column + 8 - column % 8 if c == "\t" else 0 if c == "\f" else column + (c == " ")
    return column


def layout(text: str) -> tuple[str, list[int]]:
    """Logical line ends marked in place; INDENT and DEDENT marks inserted.

    Returns the text and the offsets (in it) of the inserted characters. Only literals,
    comments, brackets and line ends are looked at; what lies between is code.
    """
    out: list[str] = []
    inserted: list[int] = []
    stack, depth, fresh, used = [0], 0, True, False
    copied = line = behind = 0

    def mark(c: str, at: int) -> None:
        nonlocal copied
        out.append(text[copied:at] + c)
        copied = at
        inserted.append(at + len(inserted))

    def begin(at: int) -> None:
        """The first code of a logical line stands at ``at``."""
        column = _width(text[line:at])
        if column > stack[-1]:
            stack.append(column)
            mark(INDENT, at)
            return
        while column < stack[-1]:
            stack.pop()
            mark(DEDENT, at)
        if column != stack[-1]:
            mark(BAD, at)

    for m in _LEX.finditer(text):
        kind = m.lastgroup
        at, end = m.span()
        if not used or fresh:
            code = text[behind:at].lstrip(_BLANKS)
            if code or kind in _CODE:
                if fresh and depth == 0:
                    fresh = False
                    if not used:
                        begin(at - len(code))
                used = True
        behind = end
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "nl" and depth == 0:
            if used:
                out.append(text[copied:at] + NEWLINE)
                copied = behind
                used = False
            fresh, line = True, behind
    if text[behind:].lstrip(_BLANKS):
        if fresh and depth == 0 and not used:
            begin(behind + len(text[behind:]) - len(text[behind:].lstrip(_BLANKS)))
        used = True
    if used:
        mark(NEWLINE, len(text))
    for _ in stack[1:]:
        mark(DEDENT, len(text))
    return "".join(out) + text[copied:], inserted


#: The four ways to quote a format string: rule, quotes, the text between fields, the text of a field's format.
_QUOTED = (
    ("FormatD3", '"{3}', r'[^"\\{}]|"(?!"")', r'[^"{}]|"(?!"")'), ("FormatS3", "'{3}", r"[^'\\{}]|'(?!'')", r"[^'{}]|'(?!'')"),
    ("FormatD", '"(?!"")', r'[^"\\\n\x1e{}]', r'[^"{}\n]'), ("FormatS", "'(?!'')", r"[^'\\\n\x1e{}]", r"[^'{}\n]"),
)


def _formats() -> str:
    """Format strings: text, doubled braces and escapes, and fields, which hold expressions and formats with fields of their own."""
    rules = ["Format <- FormatD3 | FormatS3 | FormatE | FormatD | FormatS"]
    # the empty ones, which are no beginning of three quotes
    rules += [r"""-FormatE <- `(?:[fF][rR]?|[rR][fF])(?:""(?!")|''(?!'))`"""]
    for name, quotes, text, spec in _QUOTED:
        close = quotes.split("(")[0]
        rules += [
            rf"{name} <- =`(?:[fF][rR]?|[rR][fF]){quotes}` (=`(?:{text}|\\N\{{[^{{}}]*\}}|\\[^{{}}]|\\(?=[{{}}])|\{{\{{|\}}\}})+` | {name}Field)* `{close}`",
            rf"{name}Field <- `\{{` (Yield | StarExprs) (`=(?!=)`)? (`![rsa](?!\w)`)? (=`\}}` | =`:` (=`(?:{spec})+` | {name}Field)* =`\}}`)",
        ]
    return "\n".join(rules)


GRAMMAR = Grammar(
    r"""
File <- Stmt* `\Z`
-NL <- `\x1e`
-Name <- `(?!(?:KEYWORDS)\b)[^\W\d]\w*`
-Plain <- `(?:[uU]|[rR])?(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?!"")(?:[^"\\\n\x1e]|\\[\s\S])*"|'(?!'')(?:[^'\\\n\x1e]|\\[\s\S])*')`
-Bytes <- `(?:[bB][rR]?|[rR][bB])(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|"(?!"")(?:[^"\\\n\x1e]|\\[\s\S])*"|'(?!'')(?:[^'\\\n\x1e]|\\[\s\S])*')`
FORMATS
-Number <- `(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*+\.?+(?:\d(?:_?\d)*+)?|\.\d(?:_?\d)*+)(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?)(?!\w)`

Stmt <- Compound | Simple
Simple <- Small (";" Small)* `;?` NL
Small <- Return | Import | Raise | "pass" | Del | Assert | "break" | "continue" | `(?:global|nonlocal)\b` Name ("," Name)* | TypeAlias | StarExprs &`[;\x1e]` | Assignment | Yield
Return <- "return" StarExprs?
Raise <- "raise" (Expr ("from" Expr)?)?
Del <- "del" Target ("," Target)* `,?` &`[;\x1e]`
Assert <- "assert" Expr ("," Expr)?
Import <- "import" Dotted ("as" Name)? ("," Dotted ("as" Name)?)* | "from" (`\.+` Dotted? | Dotted) "import" (`\*` | "(" ImportAs ("," ImportAs)* `,?` ")" | ImportAs ("," ImportAs)*)
Dotted <- Name ("." Name)*
ImportAs <- Name ("as" Name)?
TypeAlias <- `type\b` Name TypeParams? `=(?!=)` Expr
Assignment <- (SingleSub | Name | "(" SingleTarget ")") ":" Expr (`=(?!=)` (Yield | StarExprs))?
      | (Targets `=(?!=)`)+ (Yield | StarExprs) !`=(?!=)`
      | SingleTarget `(?:\*\*|//|<<|>>|[-+*/%@&|^])=` (Yield | StarExprs)
SingleTarget <- SingleSub | Name | "(" SingleTarget ")"
SingleSub <- Atom &Look (Trailer &Look)* (`\.` Name | "[" Slices "]") !Look
-Look <- `[(\[.]`
Targets <- StarTarget ("," StarTarget)* `,?`
StarTarget <- `\*?` Target
Target <- SingleSub | Name | "(" Targets? ")" | "[" Targets? "]"

Compound <- If | With | For | Try | While | Def | Class | Match | Decorated | Async
Block <- NL `\x0e` Stmt+ `\x0f` | Simple
FuncBlock <- NL `\x0e` (DocString (";" Small)* `;?` NL)? Stmt* `\x0f` | DocString (";" Small)* `;?` NL | Simple
DocString{doc} <- Plain+ &`[;\x1e]`
If <- "if" Named ":" Block ("elif" Named ":" Block)* Else?
Else <- "else" ":" Block
While <- "while" Named ":" Block Else?
For <- "for" Targets "in" StarExprs ":" Block Else?
With <- "with" ("(" WithItem ("," WithItem)* `,?` ")" ":" | WithItem ("," WithItem)* ":") Block
WithItem <- Expr ("as" StarTarget &`[,):]`)?
Try <- "try" ":" Block (Except+ Else? Finally? | ExceptStar+ Else? Finally? | Finally)
Except <- "except" (Expr ("as" Name)?)? ":" Block
ExceptStar <- "except" `\*` Expr ("as" Name)? ":" Block
Finally <- "finally" ":" Block
Decorated <- (`@` Named NL)+ (Def | Class | Async)
Async <- &"async" (Def | `async\b` (For | With))
Def{fn} <- `(?:async\b\s*)?def\b` FuncName TypeParams? "(" Params? ")" (`->` Expr)? ":" Body
Body{body} <- FuncBlock
-FuncName{name} <- Name
Class{cls} <- "class" ClassName TypeParams? ("(" Args? ")")? ":" Block
-ClassName{name} <- Name
TypeParams <- "[" TypeParam ("," TypeParam)* `,?` "]"
TypeParam <- `\*{0,2}` Name (":" Expr)? (`=(?!=)` StarExpr)?
Params <- (Need ("," Need)* ("," `/` ("," Need)*)? ("," Have)* ("," `/` ("," Have)*)? | Have ("," Have)* ("," `/` ("," Have)*)?) ("," Star)? `,?` | Star `,?`
Need <- Name (":" Expr)? !`=(?!=)`
Have <- Name (":" Expr)? `=(?!=)` Expr
Star <- `\*(?!\*)` Name (":" StarExpr)? ("," (Have | Need))* ("," Rest)? | `\*(?!\*)` ("," (Have | Need))+ ("," Rest)? | Rest
Rest <- `\*\*` Name (":" Expr)?
LambdaParams <- (LNeed ("," LNeed)* ("," `/` ("," LNeed)*)? ("," LHave)* ("," `/` ("," LHave)*)? | LHave ("," LHave)* ("," `/` ("," LHave)*)?) ("," LStar)? `,?` | LStar `,?`
LNeed <- Name !`=(?!=)`
LHave <- Name `=(?!=)` Expr
LStar <- `\*(?!\*)` Name ("," (LHave | LNeed))* ("," `\*\*` Name)? | `\*(?!\*)` ("," (LHave | LNeed))+ ("," `\*\*` Name)? | `\*\*` Name
Match <- `match\b` Subject ":" NL `\x0e` Case+ `\x0f`
Subject <- StarNamed "," (StarNamed ("," StarNamed)* `,?`)? | Named
Case <- `case\b` Patterns ("if" Named)? ":" Block
Patterns <- StarPattern ("," StarPattern)* `,?`
StarPattern <- `\*(?!\*)` Name | Pattern
Pattern <- OrPattern ("as" Name)?
OrPattern <- ClosedPattern (`\|` ClosedPattern)*
ClosedPattern <- `-?` Number (`[+-]` Number)? | (Plain | Bytes)+ | `(?:None|True|False)\b` | Name ("." Name)* ("(" (PatArg ("," PatArg)* `,?`)? ")")? | "(" Patterns? ")" | "[" Patterns? "]"
      | "{" (MapPattern ("," MapPattern)* `,?`)? "}"
PatArg <- Name `=(?!=)` Pattern | Pattern
MapPattern <- `\*\*` Name | (`-?` Number (`[+-]` Number)? | Plain+ | Bytes+ | `(?:None|True|False)\b` | Dotted) ":" Pattern

StarExprs <- StarExpr ("," StarExpr)* `,?`
StarExpr <- `\*(?!\*)` BitOr | Expr
StarNamed <- `\*(?!\*)` BitOr | Named
Named <- Name `:=` Expr | Expr !`:=`
Yield <- "yield" ("from" Expr | StarExprs?)
Expr <- Short | Lambda | Or ("if" Or "else" Expr)?
-Short <- `(?:(?!(?:KEYWORDS)\b)[^\W\d]\w*(?:\.(?!(?:KEYWORDS)\b)[^\W\d]\w*)*|[1-9]\d*|None\b|True\b|False\b)(?=[ \t]*[,)\]}:;=\x1e](?!=))`
Lambda <- "lambda" LambdaParams? ":" Expr
Or <- Not (`(?:and|or)\b` Not)*
Not <- "not" Not | Compare
Compare <- BitOr (`[=!]=|[<>]=?(?![<>])|in\b|not\s+in\b|is\b(?:\s+not\b)?` BitOr)*
BitOr <- Unary (`(?:\*\*|//|<<|>>|[-+*/%@&|^])(?!=)` Unary)*
Unary <- `[-+~]` Unary | "await" Primary | Primary
Primary <- Atom Trailer*
Trailer <- `\.(?!\.)` Name | "(" Args? ")" | "[" Slices "]"
Slices <- Slice ("," Slice)* `,?`
Slice <- Expr? ":" Expr? (":" Expr?)? | `\*(?!\*)` BitOr | Named
Args <- GenArg | (Value ("," Value)* ("," Keyed)* ("," Late)* | Keyed ("," Keyed)* ("," Late)* | Late ("," Late)*) `,?`
GenArg <- Named Comp &`,?\s*\)`
Value <- `\*(?!\*)` Expr | !Key Named
-Key <- `(?!(?:KEYWORDS)\b)[^\W\d]\w*\s*=(?!=)`
Keyed <- `\*(?!\*)` Expr | Name `=(?!=)` Expr
Late <- `\*\*` Expr | Name `=(?!=)` Expr
Comp <- (`(?:async\b\s*)?for\b` Targets "in" Or ("if" CompIf)*)+
CompIf <- Name `:=` Or | Or
Atom <- (Plain | Format)+ | Bytes+ | Name | Number | `\.\.\.` | `(?:None|True|False)\b` | Paren | List | Dict
Paren <- "(" (")" | Yield ")" | Named Comp ")" | StarNamed ("," StarNamed)* `,?` ")")
List <- "[" ("]" | Named Comp "]" | StarNamed ("," StarNamed)* `,?` "]")
Dict <- "{" ("}" | Pair Comp "}" | Pair ("," Pair)* `,?` "}" | Named Comp "}" | StarNamed ("," StarNamed)* `,?` "}")
Pair <- `\*\*` BitOr | Expr `:(?!=)` Expr
""".replace("FORMATS", _formats()).replace("KEYWORDS", KEYWORDS),
    skip=r"(?:[ \t\f\r\n]+|\\\r?\n|#[^\n\x1e]*)*+",
    memo="Expr Atom SingleSub Named Trailer Pair Slices Block",
)
