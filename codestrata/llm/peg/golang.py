"""Go (the language specification's syntax)."""

from __future__ import annotations

import re

from codestrata.llm.peg.engine import Grammar

#: The 25 keywords of the language.
KEYWORDS = (
    "break|case|chan|const|continue|default|defer|else|fallthrough|for|func|go|goto|if|import|interface|map|package"
    "|range|return|select|struct|switch|type|var"
)
_LEX = re.compile(r"""\n|//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:\\[^\n]'?[^'\n]*|[^'\\\n])'""")
_LAST_WORD = re.compile(r"\w+\Z")
_ENDS = frozenset(["break", "continue", "fallthrough", "return"])
_ALL = frozenset(KEYWORDS.split("|"))
#: Stands for a semicolon that a line end stands for.
MARK = "\x1e"


def _ends(text: str, low: int, high: int) -> bool:
    """Whether a line end after text[low:high] is a semicolon; ``low`` is behind the last literal or comment."""
    piece = text[low:high].rstrip(" \t\r")
    if not piece:
        return False
    c = piece[-1]
    if c in ")]}" or piece.endswith(("++", "--")):
        return True
    if not (c.isalnum() or c == "_"):
        return c == "." and piece[-2:-1].isdigit()
    word = _LAST_WORD.search(piece)[0]
    return word not in _ALL or word in _ENDS


def layout(text: str) -> str:
    """Same length: comments blanked, line ends that are semicolons marked."""
    out: list[str] = []
    last = low = 0
    literal = False  # the last thing before ``low`` is a literal, or code that a comment followed
    for m in _LEX.finditer(text):
        at, end = m.span()
        piece = m[0]
        if piece == "\n":
            if _ends(text, low, at) or literal and not text[low:at].strip(" \t\r"):
                out.append(text[last:at] + MARK)
                last = end
            literal = False
        elif piece[0] == "/":
            if text[low:at].strip(" \t\r"):
                literal = _ends(text, low, at)
            blank = " " * (end - at)
            if "\n" in piece:
                blank = re.sub(r"[^\n]", " ", piece)
                if literal:
                    blank, literal = blank.replace("\n", MARK, 1), False
            out.append(text[last:at] + blank)
            last = end
        else:
            literal = True
        low = end
    return "".join(out) + text[last:]


GRAMMAR = Grammar(
    r"""
File <- Semi* "package" Ident End Semi* (Import End Semi*)* (TopDecl End Semi*)*
-Semi <- `[;\x1e]`
-End <- `[;\x1e]` | &`[)}]` | `\Z`
-Ident <- `(?!(?:KEYWORDS)\b)[^\W\d]\w*`
-Str <- `"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|\x60[^\x60]*\x60`
-Rune <- `'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'`
-Number <- `(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[\d_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)i?(?!\w)`

Import <- "import" (ImportSpec | "(" (ImportSpec End | Semi)* ")")
ImportSpec <- (`\.` | Ident)? Str
TopDecl <- Func | Decl
Decl <- "var" (VarSpec | "(" (VarSpec End | Semi)* ")")
      | "const" (ConstSpec | "(" (ConstSpec End | Semi)* ")")
      | "type" (TypeSpec | "(" (TypeSpec End | Semi)* ")")
VarSpec <- Idents (Type (`=(?!=)` Exprs)? | `=(?!=)` Exprs)
ConstSpec <- Idents (Type? `=(?!=)` Exprs)?
TypeSpec <- Ident (TypeParams `=?` Type | `=?` Type)
Idents <- Ident ("," Ident)*
Func{fn} <- "func" Receiver? FuncName TypeParams? Signature Body?
Body{body} <- Block
-FuncName{name} <- Ident
Receiver <- "(" (Ident &`[^\W\d]|\*|\(`)? RecvBase ","? ")"
RecvBase <- "(" RecvBase ")" | `\*` RecvBase | RecvType ("[" Idents ","? "]")?
-RecvType{recv} <- Ident
Signature <- Params (Params | Type)?
Params <- "(" (Param ("," Param)* ","?)? ")"
Param <- Ident `(?:\.\.\.)?` Type | `(?:\.\.\.)?` Type
TypeParams <- "[" TypeParam ("," TypeParam)* ","? "]"
TypeParam <- Idents Constraint
Constraint <- `~?` Type (`\|(?!\|)` `~?` Type)*

Type <- "func" Signature | "struct" StructBody | "interface" InterfaceBody
      | "map" "[" Type "]" Type | `chan\b` `(?:<-)?` Type | `<-` `chan\b` Type
      | "[" (`\.\.\.` | Expr)? "]" Type | `\*` Type | "(" Type ")" | TypeName
TypeName <- Ident (`\.` Ident)? ("[" Type ("," Type)* ","? "]")?
StructBody <- "{" (Semi | Field End)* "}"
Field <- (Idents Type | `\*?` TypeName) Str?
InterfaceBody <- "{" (Semi | (Ident Signature | Constraint) End)* "}"

Block <- "{" Stmts "}"
Stmts <- Semi* (Stmt (Semi+ | &`\}|(?:case|default)\b`))*
Stmt <- Decl | "return" Exprs? | If | For | Switch | Select | `(?:go|defer)\b` Expr
      | `(?:break|continue)\b` Ident? | "goto" Ident | "fallthrough" | Block | Label | Simple
Label <- Ident `:(?!=)` (&`[\x1e;}]` | Stmt)
Simple <- Exprs (`:=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=)` Exprs | `\+\+|--` | `<-` Expr)?
SimpleH <- ExprsH (`:=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=)` ExprsH | `\+\+|--` | `<-` ExprH)?
If <- "if" (SimpleH? `[;\x1e]`)? ExprH Block ("else" (If | Block))?
For <- "for" (Range | SimpleH? `[;\x1e]` ExprH? `[;\x1e]` SimpleH? | ExprH)? Block
Range <- (ExprsH `:?=(?!=)`)? "range" ExprH
Switch <- "switch" (SimpleH? `[;\x1e]`)? SimpleH? "{" ((`case\b` CaseItem ("," CaseItem)* | `default\b`) `:(?!=)` Stmts)* "}"
CaseItem <- Expr | Type
Select <- "select" "{" ((`case\b` Simple | `default\b`) `:(?!=)` Stmts)* "}"

Exprs <- Expr ("," Expr)*
ExprsH <- ExprH ("," ExprH)*
-Short <- `(?:(?!(?:KEYWORDS)\b)[^\W\d]\w*(?:\.(?!(?:KEYWORDS)\b)[^\W\d]\w*)*|[1-9]\d*|0|"[^"\\\n]*")(?=[ \t]*[,)\]};\x1e])`
Expr <- Short | Unary (Binary Unary)*
ExprH <- UnaryH (Binary UnaryH)*
-Binary <- `\|\||&&|[=!]=|[<>]=|(?:<<|>>|&\^|[*/%&|^])(?!=)|\+(?![+=])|-(?![-=])|<(?![-<])|>`
Unary <- `<-|[-+!^*&~](?!=)` Unary | Operand Tail* Literal? TailAfter*
UnaryH <- `<-|[-+!^*&~](?!=)` UnaryH | Operand Tail*
TailAfter <- Tail | Literal
Operand <- Rune | Str | Number | FuncLit | "(" (Expr | Type) ")" | TypeLit Literal? | Ident
FuncLit <- "func" Signature Block
TypeLit <- "[" (`\.\.\.` | Expr)? "]" Type | "struct" StructBody | "map" "[" Type "]" Type | `chan\b` Type
         | "interface" InterfaceBody | "func" Signature | `<-` `chan\b` Type
Tail <- `\.(?!\.)` (Ident | "(" ("type" | Type) ")") | Call | Index
Call <- "(" (Arg ("," Arg)* `(?:\.\.\.)?` ","?)? ")"
Arg <- Expr | Type
Index <- "[" (Arg ("," Arg)* ","? "]" | Expr? ":" (Expr (":" Expr)?)? "]")
Literal <- "{" (Element ("," Element)* ","?)? "}"
Element <- Value (`:(?!=)` Value)?
Value <- Literal | Expr
""".replace("KEYWORDS", KEYWORDS),
    skip=r"[ \t\r\n]*",
    memo="Expr ExprH ExprsH SimpleH Operand Type Block Arg",
)
