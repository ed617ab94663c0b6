"""Rust, edition 2021."""

from __future__ import annotations

import re

from codestrata.llm.peg.engine import Grammar

#: The strict keywords of the edition.
KEYWORDS = (
    "as|async|await|break|const|continue|crate|dyn|else|enum|extern|false|fn|for|if|impl|in|let|loop|match|mod|move|mut"
    "|pub|ref|return|self|Self|static|struct|super|trait|true|type|unsafe|use|where|while"
    "|abstract|become|box|do|final|macro|override|priv|typeof|unsized|virtual|yield|try"
)
_LEX = re.compile(
    r"""//[^\n]*|/\*|(?:\b(?:br|cr|r))(?P<hash>\#*)"[\s\S]*?"(?P=hash)|\b[bc]?"(?:[^"\\]|\\[\s\S])*"|"(?:[^"\\]|\\[\s\S])*\""""
    r"""|\bb?'(?:[^'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\})[0-9a-fA-F]?)'|'(?:[^'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\})[0-9a-fA-F]?)'"""
)
_NEST = re.compile(r"/\*|\*/")


def layout(text: str) -> str:
    """Same length with comments blanked (block comments nest); an open one becomes invalid text."""
    out, last, at = [], 0, 0
    while (m := _LEX.search(text, at)) is not None:
        at = m.end()
        if not m[0].startswith("/"):
            continue
        if m[0] == "/*":
            depth = 1
            while depth and (n := _NEST.search(text, at)) is not None:
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            if depth:
                return "".join(out) + text[last : m.start()] + "\x00" + text[m.start() + 1 :]
        out.append(text[last : m.start()] + re.sub(r"[^\n]", " ", text[m.start() : at]))
        last = at
    return "".join(out) + text[last:]


GRAMMAR = Grammar(
    r"""
File <- Shebang? (`#!` Attr)* Item* `\Z`
-Shebang <- `#!(?!\s*\[)[^\n]*\n`
-Attr <- "[" TokenTree* "]"
Attrs <- (`#(?!!)` Attr)*
Inner <- (`#!` Attr)*
TokenTree <- "(" TokenTree* ")" | "[" TokenTree* "]" | "{" TokenTree* "}" | Lit | Lifetime | `\w+` | `[^\s\w()\[\]{}"']`
-Ident <- `(?:r#)?(?!(?:KEYWORDS)\b)[^\W\d]\w*`
-Lifetime <- `'[^\W\d]\w*(?!')`
Lit <- Str | `b?'(?:[^'\\\n\t\r]|\\(?:[nrt0'"\\]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,12}\}))'`
     | `0x[0-9a-fA-F_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[^\W\d]\w*)?)` | `(?:true|false)\b`
-Str <- `(?:b|c)?r(?P<h>\#*)"[\s\S]*?"(?P=h)` | `[bc]?"(?:[^"\\]|\\(?:[nrt0'"\\\n]|\r\n|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,12}\}))*"`

Item <- Attrs (Macro2 | Vis? (Func | "mod" Ident (";" | "{" Inner Item* "}") | Struct | Enum | Union | Impl | Trait
      | "use" UseTree ";" | "type" Ident Generics? (":" Bounds?)? Where? ("=" Type)? Where? ";"
      | "const" (Ident | "_") ":" Type ("=" Expr)? ";" | "static" "mut"? Ident ":" Type ("=" Expr)? ";"
      | "unsafe"? "extern" Str? "{" Inner Item* "}" | "extern" "crate" (Ident | "self") ("as" (Ident | "_"))? ";"
      | `macro_rules\b` `!` Ident ("{" TokenTree* "}" | "(" TokenTree* ")" ";" | "[" TokenTree* "]" ";")))
Macro2 <- Path `!(?!=)` ("{" TokenTree* "}" | ("(" TokenTree* ")" | "[" TokenTree* "]") ";")
Vis <- "pub" ("(" ("crate" | "self" | "super" | "in" SimplePath) ")")?
SimplePath <- `(?:::)?` PathWord (`::` PathWord)*
-PathWord <- Ident | `(?:self|super|crate|Self)\b`
UseTree <- (SimplePath `::`)? (`\*` | "{" (UseTree ("," UseTree)* ","?)? "}") | `::` (`\*` | "{" (UseTree ("," UseTree)* ","?)? "}")
         | SimplePath ("as" (Ident | "_"))?
Func{fn} <- "const"? "async"? "unsafe"? ("extern" Str?)? "fn" FuncName Generics? "(" (FnParam ("," FnParam)* ","?)? ")"
            (`->` Type)? Where? (Body | ";")
-FuncName{name} <- Ident
Body{body} <- Block
FnParam <- Attrs (`&` Lifetime? "mut"? `self\b` | "mut"? `self\b` (":" Type)? | `\.\.\.` | Pattern ":" (`\.\.\.` | Type))
Generics <- `<(?![=<-])` (GenericParam ("," GenericParam)* ","?)? `>`
GenericParam <- Attrs (Lifetime (":" (Lifetime (`\+` Lifetime)*)?)? | "const" Ident ":" Type ("=" (Block | `-?` Lit | Ident))? | Ident (":" Bounds?)? ("=" Type)?)
Where <- "where" (WherePred ("," WherePred)* ","?)?
WherePred <- Lifetime ":" (Lifetime (`\+` Lifetime)*)? | ForLifetimes? Type ":" Bounds?
Bounds <- Bound (`\+(?!=)` Bound)* `\+?`
Bound <- Lifetime | "(" `\??` ForLifetimes? TypePath ")" | `\??` ForLifetimes? TypePath
ForLifetimes <- "for" Generics
Struct <- "struct" Ident Generics? (Where? "{" (StructField ("," StructField)* ","?)? "}" | "(" (TupleField ("," TupleField)* ","?)? ")" Where? ";" | Where? ";")
StructField <- Attrs Vis? Ident ":" Type
TupleField <- Attrs Vis? Type
Enum <- "enum" Ident Generics? Where? "{" (Variant ("," Variant)* ","?)? "}"
Variant <- Attrs Vis? Ident ("{" (StructField ("," StructField)* ","?)? "}" | "(" (TupleField ("," TupleField)* ","?)? ")")? (`=(?!=)` Expr)?
Union <- `union\b` Ident Generics? Where? "{" (StructField ("," StructField)* ","?)? "}"
Impl{cls} <- "unsafe"? "impl" (Generics &`[^\s>]`)? (`!` TypePath "for" ImplType | TypeNoBounds "for" ImplType | ImplType) Where? "{" Inner Item* "}"
ImplType{type} <- Type
Trait{cls} <- "unsafe"? `(?:auto\b\s*)?trait\b` TraitName Generics? (":" Bounds?)? Where? "{" Inner Item* "}"
-TraitName{type} <- Ident

Type <- "impl" Bounds | "dyn" Bounds | ForLifetimes Type | TypeNoBounds (`\+(?!=)` Bounds)?
TypeNoBounds <- "(" (Type ("," Type)* ","?)? ")" | `!` | `&&?` Lifetime? "mut"? TypeNoBounds | `\*(?=\s*(?:const|mut)\b)` `(?:const|mut)\b` TypeNoBounds
      | "[" Type (";" Expr)? "]" | "_" | "impl" Bound | "dyn" Bound | FnType | `<(?![=<-])` Type ("as" TypePath)? `>` (`::` PathSeg)+ | ForLifetimes FnType | TypePath (`!(?!=)` ("(" TokenTree* ")" | "[" TokenTree* "]" | "{" TokenTree* "}"))?
FnType <- "unsafe"? ("extern" Str?)? "fn" "(" ((FnTypeArg ("," FnTypeArg)*) ","?)? ")" (`->` TypeNoBounds)?
FnTypeArg <- Attrs (`\.\.\.` | ((Ident | "_") `:(?!:)`)? Type)
TypePath <- `(?:::)?` TypeSeg (`::` TypeSeg)*
TypeSeg <- PathWord (`(?:::)?(?=<)` GenericArgs | `(?:::)?(?=\()` "(" (Type ("," Type)* ","?)? ")" (`->` TypeNoBounds)?)?
GenericArgs <- `<(?![=-])` (GenericArg ("," GenericArg)* ","?)? `>`
GenericArg <- Lifetime | Ident GenericArgs? `=(?!=)` (Type | Block | Lit) | Ident GenericArgs? `:(?!:)` Bounds | Type | Block | `-?` Lit

Path <- `(?:::)?` PathSeg (`::` PathSeg)* | `<(?![=<-])` Type ("as" TypePath)? `>` (`::` PathSeg)+
PathSeg <- PathWord (`::(?=\s*<)` GenericArgs)?

Pattern <- `\|?` PatNoTop (`\|(?!\|)` PatNoTop)*
PatNoTop <- PatRange | `&&?` "mut"? PatNoTop | "(" (Pattern ("," Pattern)* ","?)? ")" | "[" (Pattern ("," Pattern)* ","?)? "]"
      | `_(?!\w)` | `\.\.(?![.=])` | `(?:ref\b\s*)?(?:mut\b\s*)?` Ident !`::|[({!]` (`@` PatNoTop)?
      | Path (`!(?!=)` ("(" TokenTree* ")" | "[" TokenTree* "]" | "{" TokenTree* "}") | "(" (Pattern ("," Pattern)* ","?)? ")" | "{" (FieldPat ("," FieldPat)* ","?)? "}")? | "box" PatNoTop | Block
FieldPat <- Attrs (`\.\.` | (Ident | `\d+`) `:(?!:)` Pattern | `(?:ref\b\s*)?(?:mut\b\s*)?` Ident)
PatRange <- (PatBound (`\.\.=|\.\.\.|\.\.` PatBound? | !`\.\.`) &`[^\s]`) | `\.\.=` PatBound
PatBound <- `-?` Lit | Path !`[({!@]` &`\.\.`

Block <- "{" Inner Stmts "}"
Stmts <- Stmt* Expr?
Stmt <- `;` | Attrs Let | Item | Attrs ExprBlock !`\.(?!\.)|\?` `;?` | Attrs Expr ";"
Let <- "let" Pattern (":" Type)? (`=(?!=)` Expr)? ("else" Block)? ";"
ExprBlock <- If | Match | (Lifetime ":")? (While | "loop" Block | For | Block) | "unsafe" Block | "async" "move"? Block | "const" Block | Path `!(?!=)` "{" TokenTree* "}"
If <- "if" ExprH Block ("else" (If | Block))?
While <- "while" ExprH Block
For <- "for" Pattern "in" ExprH Block
Match <- "match" ExprH "{" Inner (Arm)* "}"
Arm <- Attrs Pattern ("if" ExprH)? `=>` (ExprBlock !`\.(?!\.)|\?|[-+*/%&|^<>=](?!=>)|as\b` `,?` | Expr (`,` | &`\}`))

-Short <- `(?:self\b|(?!(?:KEYWORDS)\b)[^\W\d]\w*)(?:\.(?!(?:KEYWORDS)\b)[^\W\d]\w*)*(?=\s*[,)\]};])|(?:0|[1-9]\d*)(?=\s*[,)\]};])`
Expr <- Short | Attrs (Unary (Binary Unary?)* | `\.\.=?` Unary?)
ExprH <- UnaryH (Binary UnaryH?)* | `\.\.=?` UnaryH?
-Binary <- `\|\||&&|==|!=|<=|>=|(?:<<|>>|[-+*/%^])=?|&=?(?!&)|\|=?(?!\|)|<(?!-)|>|=(?![=>])|\.\.=?`
Unary <- `[-*!]|&&?\s*(?:raw\s+(?:const|mut)\b|mut\b)?` Unary | "let" Pattern `=(?!=)` Unary | Jump | Closure | Primary Tail* As*
UnaryH <- `[-*!]|&&?\s*(?:raw\s+(?:const|mut)\b|mut\b)?` UnaryH | "let" Pattern `=(?!=)` UnaryH | Jump | Closure | PrimaryH Tail* As*
As <- "as" TypeNoBounds
Jump <- "return" Expr? | "break" Lifetime? Expr? | "continue" Lifetime? | "yield" Expr?
Closure <- ForLifetimes? "static"? "async"? "move"? (`\|\|` | `\|` (ClosureParam ("," ClosureParam)* ","?)? `\|`) (`->` TypeNoBounds Block | Expr)
ClosureParam <- Attrs PatNoTop (":" Type)?
Tail <- `\?` | `\.(?!\.)` ("await" | `\d+(?:\.\d+)*` | Ident (`::(?=\s*<)` GenericArgs)?) | "(" Args ")" | "[" Expr "]"
Args <- (Expr ("," Expr)* ","?)?
Primary <- Path !`!(?!=)` StructLit | PrimaryH
StructLit <- "{" ((StructElem ("," StructElem)*)? ","? (`\.\.` Expr?)?) "}"
StructElem <- Attrs ((Ident | `\d+`) `:(?!:)` Expr | Ident &`[,}]`)
PrimaryH <- Lit | ExprBlock | "(" Attrs (Expr ("," Expr)* ","?)? ")" | "[" (Expr (";" Expr | ("," Expr)* ","?))? "]"
      | Path (`!(?!=)` ("(" TokenTree* ")" | "[" TokenTree* "]" | "{" TokenTree* "}"))? | `_(?!\w)`
""".replace("KEYWORDS", KEYWORDS),
    skip=r"\s*",
    memo="Path Attrs Expr ExprBlock PrimaryH TypeNoBounds Type Pattern SimplePath Block Lit",
)
