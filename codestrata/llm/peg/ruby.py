"""Ruby 3."""

from __future__ import annotations

import re

from codestrata.llm.peg.engine import Grammar

#: The reserved words.
KEYWORDS = (
    "BEGIN|END|__ENCODING__|__FILE__|__LINE__|alias|and|begin|break|case|class|def|defined\\?|do|else|elsif|end|ensure"
    "|false|for|if|in|module|next|nil|not|or|redo|rescue|retry|return|self|super|then|true|undef|unless|until|when"
    "|while|yield"
)
_LEX = re.compile(
    r"""(?P<doc>^=begin\b[\s\S]*?^=end\b[^\n]*)|(?P<stop>^__END__$[\s\S]*)|'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*"|(?P<note>(?:(?<![^\s;])\#|\#(?!\{))[^\n]*)"""
    r"""|(?<![\w)\]}])<<(?P<kind>[~-]?)(?P<q>["'`]?)(?P<word>[A-Z_]\w*)(?P=q)|(?P<nl>\n)""",
    re.M,
)


def layout(text: str) -> str:
    """Same length: here-document bodies, =begin blocks, comments and what follows __END__ blanked."""
    out, last, at = [], 0, 0
    waiting: list[tuple[str, bool]] = []
    while (m := _LEX.search(text, at)) is not None:
        start, at = m.start(), m.end()
        if m["word"]:
            waiting.append((m["word"], bool(m["kind"])))
            continue
        if m["nl"]:
            if not waiting:
                continue
            start = at
            for word, loose in waiting:
                end = re.compile(rf"^{'[ \t]*' if loose else ''}{re.escape(word)}[ \t]*$", re.M).search(text, at)
                if end is None:  # an open here-document: leave a character no rule takes
                    return "".join(out) + text[last:start] + "\x00" + text[start + 1 :]
                at = end.end()
            waiting = []
        elif not (m["doc"] or m["stop"] or m["note"]):
            continue
        out.append(text[last:start] + re.sub(r"[^\n]", " ", text[start:at]))
        last = at
    return "".join(out) + text[last:]


_EXPR = r"""
ExprStmt <- NotExpr (`(?:and|or)\b` NLs NotExpr)*
NotExpr <- `not\b` NotExpr | Multi | Assign
Multi <- MultiItem ("," NLs MultiItem)+ `,?` `=(?![=~>])` NLs Rhs | `\*(?=[\w@$])` Postfix ("," NLs MultiItem)* `=(?![=~>])` NLs Rhs
Rhs <- RhsItem ("," NLs RhsItem)*
RhsItem <- `\*(?!\s)` Ternary | Assign
Assign <- Ternary (`(?:\*\*|&&|\|\||<<|>>|[-+*/%&|^])?=(?![=~>])` NLs (Multi | Rhs) (`rescue\b` Assign)?)?
Ternary <- Range (`\?(?=\s)` NLs Assign NLs `:(?!:)` NLs Assign)?
Range <- `\.\.\.?(?=[\w(])` Binary | Binary (`\.\.\.?` (!`[)\]\n;]|then\b` Binary)?)?
Binary <- Unary (BinaryOp NLs Unary)*
Unary <- `!(?![=~])|~|[-+](?=[\w(@$:\[])|&(?=[\w:(@])|\*\*?(?=[\w:(@\[])` NLs Unary | `defined\?` Unary | Postfix
Postfix <- (Command | Primary) Tail*
Tail <- TailDot | `(?<![\s])\[` NLs Args? NLs `\]` | `(?<![\s])::` ((ConstName | MethodName) (=`` CallArgs)?) | Blocks
TailDot <- `(?:\s*(?:\#[^\n]*\n\s*)*)(?:&\.|\.(?!\.))` NLs (CallArgs | (MethodName | KeywordName | Op) (CallArgs | CommandArgs)?) BraceBlock? DOBLOCK
Command <- !Keyword (MethodName | ConstName) (CallArgs BraceBlock? DOBLOCK | CommandArgs DOBLOCK | BraceBlock | DOBLOCKREQ | &`` Nothing)
CommandArgs <- &`(?<=[ \t])(?:["'@$\w:%\[\x60({]|->|<<[~-]?["'\x60A-Z]|[-*&!~](?![\s=])|\*\*(?!\s)|/(?![\s=])|\.\.\.?\w)` !`%[\s=]|:(?:[\s:])|\?\s|\{|(?:if|unless|while|until|rescue|and|or|then|do|in|end)\b` Args
"""

_REST = r"""
File <- Terms? Stmts `\Z`
-NLs <- `(?:[\s]|\#[^\n]*)*`
-Terms <- `[;\n](?:[\s;]|\#[^\n]*)*`
-Nothing <- ``
Stmts <- (Stmt (Terms | &`[})]|end\b|else\b|elsif\b|when\b|in\b|rescue\b|ensure\b|\Z`))*
Stmt <- (`alias\b` (Symbol | Var | MethodName | KeywordName | Op) (Symbol | Var | MethodName | KeywordName | Op) | `undef\b` (Symbol | MethodName) | `(?:BEGIN|END)\b` Brace | ExprStmt) Modifier*
Modifier <- `(?:if|unless|while|until|rescue)\b` ExprStmt | `(?:in\b|=>)` Pattern
Brace <- `\{` Terms? Stmts `\}`
-Keyword <- `(?:KEYWORDS)(?![\w?!:])|(?:KEYWORDS)(?=::)`
-KeywordName <- `(?:KEYWORDS)(?!\w)[?!]?`
-Ident <- !Keyword `[^\W\dA-Z]\w*(?![\w?!])|[^\W\dA-Z]\w*`
-MethodName <- !Keyword `[^\W\d]\w*(?:[?!](?!=(?![=~>])))?`
-ConstName <- `[A-Z]\w*`
-Var <- `@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|[!-/:;<=>?@\\\x60~_]|-\w)`
-Op <- `\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[-+!~]@|[-+*/%&|^<>~\x60]`
-BinaryOp <- `\*\*(?!=)|<=>|===?|=~|![=~]|&&(?!=)|\|\|(?!=)|<<(?![=~])|>>(?!=)|<=|>=|[-+*/%&|^](?!=)|<|>`
MultiItem <- `\*(?=[\w@$])` Postfix | "(" MultiItem ("," MultiItem)* ")" | `\*` | Postfix
CallArgs <- `(?<![\s])\(` NLs Args? NLs `\)`
Args <- Arg (NLs2 "," NLs !`[)\]]` Arg)* (NLs2 `,` &(NLs `[)\]]`))?
-NLs2 <- `(?:\s*(?=,))?`
Arg <- `(?:\*\*?|&)(?=[\w@$:(\[{])` Ternary | `(?:\*\*|\*|&)(?=\s*[,)])` | `\.\.\.(?=\s*\))` | Pair | NotExpr (`=>` NLs NotExpr)?
Pair <- (`[^\W\d]\w*[?!]?:(?!:)` | DoubleStr `(?<=["']):(?!:)`) (&`\s*[,)\]}]` | NLs NotExpr)
BlockParams <- `\|` (BlockParam ("," NLs BlockParam)* `,?`)? (`;` Ident ("," Ident)*)? NLs `\|`
BlockParam <- `\*\*?` Ident? | `&` Ident? | "(" BlockParam ("," BlockParam)* ")" | `[^\W\d]\w*:(?!:)` (!`[,|]` Unary)? | Ident (`=(?!=)` Unary)?
BraceBlock <- `\{` NLs BlockParams? Terms? Stmts `\}`
DoBlock <- `do\b` NLs2 (`\s*(?=\|)` BlockParams)? Terms? BodyStmt `end\b`
Blocks <- !`` Nothing

Primary <- Literal | Lambda | If | Unless | While | Case | For | Begin | Def | Class | Module | Jump | `(?:nil|true|false|self|__FILE__|__LINE__|__ENCODING__|redo|retry)(?![\w?!])` 
      | `(?:super|yield)\b` (CallArgs | CommandArgs)? BraceBlock? | `::` ConstName | "(" Terms? NLs Stmts `\)` | `\[` NLs Args? NLs `\]` | Hash | Var | Ident | ConstName
Literal <- Heredoc+ | Number | (DoubleStr | Single)+ | Symbol | Percent | RegexLit | Back | Char
Number <- `-?(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)r?i?(?!\w)`
-Char <- `\?(?:\\.|[^\s\\])(?!\w)`
-Single <- `'(?:[^'\\]|\\[\s\S])*'`
DoubleStr <- =`"(?:[^"\\\#]|\\[\s\S]|\#(?![{]))*` (Interp =`(?:[^"\\\#]|\\[\s\S]|\#(?![{]))*`)* `"`
RegexLit <- =`/(?:[^/\\\#\n]|\\[\s\S]|\#(?![{]))*` (Interp =`(?:[^/\\\#\n]|\\[\s\S]|\#(?![{]))*`)* `/[imxounse]*`
Back <- =`\x60(?:[^\x60\\\#]|\\[\s\S]|\#(?![{]))*` (Interp =`(?:[^\x60\\\#]|\\[\s\S]|\#(?![{]))*`)* `\x60`
Interp <- `\#\{` NLs Stmts NLs =`\}`
Symbol <- `:(?:[^\W\d]\w*[?!=]?(?![=~>]=?)|[^\W\d]\w*[?!]?|@@?\w+|\$\w+|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[-+!~]@|[-+*/%&|^<>~])` | =`:(?=")` DoubleStr | =`:(?=')` Single
Percent <- `%[wWiIqQrsx]?(?:\((?:[^()\\]|\\[\s\S]|\([^()]*\))*\)|\[(?:[^\[\]\\]|\\[\s\S]|\[[^\[\]]*\])*\]|\{(?:[^{}\\]|\\[\s\S]|\{[^{}]*\})*\}|<(?:[^<>\\]|\\[\s\S]|<[^<>]*>)*>|(?P<d>[|!/^+~-])(?:(?!(?P=d))[^\\]|\\[\s\S])*(?P=d))[imxounse]*`
Heredoc <- `<<[~-]?(?:"[^"\n]+"|'[^'\n]+'|\x60[^\x60\n]+\x60|[A-Z_]\w*)`
Hash <- `\{` NLs (HashItem (NLs2 "," NLs !`\}` HashItem)* NLs `,?` NLs)? `\}`
HashItem <- `\*\*` Ternary | Pair | NotExpr NLs `=>` NLs NotExpr
Lambda <- `->` ("(" NLs Params? NLs ")" | BareParams)? (BraceBlock | DoBlock)
Jump <- `(?:return|break|next)(?![\w?!])` (&`(?<=[ \t])[^\s]` !`(?:if|unless|while|until|rescue|and|or|end)\b|[;})]|\?` Rhs)?
Then <- Terms? `then\b` Terms? | Terms
If <- `if\b` ExprStmt Then Stmts (`elsif\b` ExprStmt Then Stmts)* (`else\b` Terms? Stmts)? `end\b`
Unless <- `unless\b` ExprStmt Then Stmts (`else\b` Terms? Stmts)? `end\b`
While <- `(?:while|until)\b` ExprStmtN (Terms? `do\b` Terms? | Terms) Stmts `end\b`
For <- `for\b` MultiItem ("," MultiItem)* `in\b` ExprStmtN (Terms? `do\b` Terms? | Terms) Stmts `end\b`
Case <- `case\b` ExprStmt? Terms? ((`when\b` NLs Args Then Stmts)+ | (`in\b` Pattern (`(?:if|unless)\b` ExprStmt)? Then Stmts)+) (`else\b` Terms? Stmts)? `end\b`
Pattern <- PatternAlt ("," NLs PatternAlt)* `,?`
PatternAlt <- PatternOne (`\|` NLs PatternOne)* (`=>` Ident)?
PatternOne <- `\*\*?(?:nil\b)?` Ident? | `[^\W\d]\w*[?!]?:(?!:)` (!`[,)}\]\n]|then\b|if\b|unless\b` PatternAlt)? | `\^` (Ident | Var | "(" ExprStmt ")") | `\[` NLs Pattern? NLs `\]` | `\{` NLs Pattern? NLs `\}`
      | ConstName (`::` ConstName)* (`(?<!\s)\(` NLs Pattern? NLs `\)` | `(?<!\s)\[` NLs Pattern? NLs `\]`)? (`\.\.\.?` Binary?)? | "(" Pattern ")" | Range
Begin <- `begin\b` Terms? BodyStmt `end\b`
BodyStmt <- Stmts (`rescue\b` (&`[^\s;]` !`then\b|=>` Args)? (`=>` Postfix)? Then Stmts)* (`else\b` Terms? Stmts)? (`ensure\b` Terms? Stmts)?
Def{fn} <- `def\b` (Singleton `\.`)? DefName (`(?<![\s])\(|\(` NLs Params? NLs `\)` EndlessOrBody | `=(?![=~>])` NLs Body1 | (&`(?<=[ \t])[^\s;]` Params)? Terms Body2)
EndlessOrBody <- `=(?![=~>])` NLs Body1 | Terms? Body2
Body1{body} <- NotExpr
Body2{body} <- BodyStmt `end\b`
-Singleton <- `(?:self|[^\W\d]\w*|@\w+)(?=\s*\.)`
-DefName{name} <- Op | `[^\W\d]\w*(?:[?!](?!=(?![=~>]))|=(?![=~>])(?=\s*\())?`
Params <- Param (NLs2 "," NLs Param)*
BareParams <- Param ("," NLs Param)*
Param <- `\*\*?` (Ident | `nil\b`)? | `&` Ident? | `\.\.\.` | "(" Param ("," Param)* ")" | `[^\W\d]\w*:(?!:)` (!`[,)\n|{]|do\b` NLs Ternary)? | Ident (`=(?![=~>])` NLs Ternary)?
Class{cls} <- `class\b` (`<<` ExprStmt | ClassName (`<(?!<)` ExprStmt)?) Terms BodyStmt `end\b`
-ClassName{name} <- `(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*`
Module{cls} <- `module\b` ClassName Terms BodyStmt `end\b`
"""


_MEMO = "Postfix Tail Ternary NotExpr Assign PostfixN TailN TernaryN NotExprN AssignN DoubleStr MultiItem Primary Stmts Arg Param"


def _text() -> str:
    names = re.findall(r"^([A-Z]\w*) <-", _EXPR, re.M)
    plain = _EXPR.replace("DOBLOCKREQ", "DoBlock").replace("DOBLOCK", "DoBlock?")
    no_do = _EXPR.replace("DOBLOCKREQ", "(!`` Nothing)").replace(" DOBLOCK", "")
    for n in names:
        no_do = re.sub(rf"\b{n}\b", n + "N", no_do)
    return (plain + no_do + _REST).replace("KEYWORDS", KEYWORDS)


GRAMMAR = Grammar(_text(), skip=r"(?:[ \t]+|\\\n|\#(?!\{)[^\n]*)*+", flags=re.M, memo=_MEMO)
