"""JavaScript modules and TypeScript: one grammar, the typed rules left empty for JavaScript."""

from __future__ import annotations

from codestrata.llm.peg.engine import Grammar

#: Words that can be no identifier in module code.
RESERVED = (
    "await|break|case|catch|class|const|continue|debugger|default|delete|do|else|enum|export|extends|false|finally|for"
    "|function|if|import|in|instanceof|new|null|return|super|switch|this|throw|true|try|typeof|var|void|while|with"
    "|implements|interface|let|package|private|protected|public|static|yield"
)
#: In TypeScript these are contextual words.
TYPED_WORDS = "implements|interface|package|private|protected|public|static"


def layout(text: str) -> str:
    return text


_COMMON = r"""
File <- Hashbang? ModuleItem* `\Z`
-Hashbang <- `#![^\n]*`
-End <- ";" | &`\}` | @nl
ModuleItem <- Import | Export | TopConst | Stmt
TopConst <- `const(?![\w$])(?=[\s\[{/])` TopBinding ("," TopBinding)* End
TopBinding <- ArrowBinding | Binding
-Name <- `(?:(?!\d)[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*`
-Ident <- !`(?:RESERVED)(?![\w$])` Name
-Str <- `"(?:[^"\\\n\r]|\\(?:u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|x[0-9a-fA-F]{2}|\r\n|[^ux1-9]))*"|'(?:[^'\\\n\r]|\\(?:u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})|x[0-9a-fA-F]{2}|\r\n|[^ux1-9]))*'`
-Number <- `(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)(?![\w$])`
-Regex <- `/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*`
Template <- =`\x60(?:[^\x60\\$]|\\[\s\S]|\$(?!\{))*` (`\$\{` Exprs =`\}(?:[^\x60\\$]|\\[\s\S]|\$(?!\{))*`)* `\x60`

Import <- "import" (Str With? | TypeOnly? ImportClause "from" Str With?) End IMPORT_EQ
ImportClause <- ImportStar | ImportNamed | Ident ("," (ImportStar | ImportNamed))?
ImportStar <- `\*` "as" Ident
ImportNamed <- "{" (ImportSpec ("," ImportSpec)* ","?)? "}"
ImportSpec <- TypeOnly? (Name | Str) "as" Ident | TypeOnly? Ident
With <- `with|assert` Object
Export <- Decorators "export" (`default(?![\w$])` (FuncDefault | ClassDefault TYPED_DEFAULT | Assign End)
        | TypeOnly? `\*` ("as" (Name | Str))? "from" Str With? End | TypeOnly? "{" (ExportSpec ("," ExportSpec)* ","?)? "}" ("from" Str With?)? End
        | TopConst | Decl EXPORT_EQ)
ExportSpec <- TypeOnly? (Name | Str) ("as" (Name | Str))?
FuncDefault{fn} <- `async(?![\w$])(?=[ \t]+function)|` "function" `\*?` (!`[(<]` FuncName)? Signature (Body | NOBODY)
ClassDefault{cls} <- Abstract? "class" (!`extends(?![\w$])|\{` ClassName)? ClassRest
Decl <- FuncDecl | ClassDecl | Lexical End | "var" Binding ("," Binding)* End TYPED_DECL
FuncDecl{fn} <- `async(?![\w$])(?=[ \t]+function)|` "function" `\*?` FuncName Signature (Body | NOBODY)
-FuncName{name} <- Ident
-ClassName{name} <- Ident
Body{body} <- Block
ClassDecl{cls} <- Decorators Abstract? "class" ClassName ClassRest
ClassRest <- TypeParams? ("extends" Unary3 TypeArgs?)? Implements? "{" (";" | Member)* "}"
Member <- Decorators (StaticBlock | Method | Field)
StaticBlock <- "static" Block
Method{fn} <- Modifiers (`(?:get|set)(?![\w$])` &`[\w$#"'\[\\]` | `async(?![\w$])` !@nl &`[\w$#"'\[*\\]`)? `\*?` MethodName `[?!]?` Signature (Body | NOBODY_M)
-MethodName{name} <- `#` Name | Name | Str | Number | Computed
Computed <- "[" Assign "]"
Field <- Modifiers `(?:accessor(?![\w$])(?=\s*[\w$#\["']))?` (`#` Name | Name | Str | Number | Computed) `[?!]?` TypeAnn? (`=(?![=>])` Assign)? End TYPED_MEMBER
Modifiers <- `(?:MODIFIERS)(?![\w$])(?=\s*[\w$#\["'*{\\])`*
Signature <- TypeParams? "(" (Param ("," Param)* ","?)? ")" ReturnType?
Param <- Decorators ParamMods (`\.\.\.` Target TypeAnn? | Target `\??` TypeAnn? (`=(?![=>])` Assign)?) THIS_PARAM
Target <- ArrayPattern | ObjectPattern | Ident
ArrayPattern <- "[" (`,` | Element `,?`)* "]"
Element <- `\.\.\.` Target | Target (`=(?![=>])` Assign)?
ObjectPattern <- "{" (PropPattern ("," PropPattern)* ","?)? "}"
PropPattern <- `\.\.\.` Target | (Name | Str | Number | Computed) ":" Target (`=(?![=>])` Assign)? | Ident (`=(?![=>])` Assign)?
Lexical <- `(?:const|let|using)(?![\w$])(?=[\s\[{/])` Binding ("," Binding)*
Binding <- Target `!?` TypeAnn? (`=(?![=>])` Assign)?
ArrowBinding{arrow} <- FuncName TypeAnn? `=(?![=>])` ArrowHead Body
ArrowHead <- `(?:async(?![\w$])(?![ \t]*=>))?` (Signature | Ident) !@nl `=>`

Block <- "{" Stmt* "}"
Stmt <- Block | ";" | FuncDecl | ClassDecl | If | For | While | DoWhile | Switch | Try | Jump | With_ | `debugger(?![\w$])` End | Label
      | Lexical End | "var" Binding ("," Binding)* End TYPED_DECL | !`\{|(?:function|class|import\s*[\w${*"']|export)(?![\w$(])|async[ \t]+function` Exprs End
If <- "if" "(" Exprs ")" Stmt ("else" Stmt)?
For <- "for" `(?:await(?![\w$]))?` "(" ((`(?:const|let|var|using)(?![\w$])` Target TypeAnn? | Unary3) `(?:of|in)(?![\w$])` Exprs
     | (Lexical | "var" Binding ("," Binding)* | Exprs)? ";" Exprs? ";" Exprs?) ")" Stmt
While <- "while" "(" Exprs ")" Stmt
DoWhile <- "do" Stmt "while" "(" Exprs ")" `;?`
Switch <- "switch" "(" Exprs ")" "{" (("case" Exprs | "default") ":" Stmt*)* "}"
Try <- "try" Block (Catch Finally? | Finally)
Catch <- "catch" ("(" Target TypeAnn? ")")? Block
Finally <- "finally" Block
Jump <- `(?:return)(?![\w$])` (!@nl !`[;}]` Exprs)? End | `(?:break|continue)(?![\w$])` (!@nl Ident)? End | "throw" !@nl Exprs End
With_ <- !`` Name
Label <- Ident `:(?!:)` Stmt

Exprs <- Assign ("," Assign)*
-Short <- `(?:this(?![\w$])|null(?![\w$])|true(?![\w$])|false(?![\w$])|(?!(?:RESERVED)(?![\w$]))[A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)*(?=[ \t]*[,)\]};])|(?:0|[1-9]\d*)(?=[ \t]*[,)\]};])|"[^"\\\n\r]*"(?=[ \t]*[,)\]};])|'[^'\\\n\r]*'(?=[ \t]*[,)\]};])`
Assign <- Short | Arrow | Yield | Cond (`(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])?=(?![=>])` Assign)?
Yield <- `yield(?![\w$])` (!@nl `\*?` Assign)?
Arrow <- ArrowHead (Block | !`\{` Assign)
Cond <- Binary (`\?(?![.?])|\?(?=\.\d)` Assign ":" Assign)?
Binary <- Unary (BinaryOp Unary AS_TAIL)*
-BinaryOp <- `(?:\?\?|\|\||&&|\*\*|<<|>>>|>>|[-*/%&|^+])(?!=)|[=!]==?|[<>]=?|instanceof(?![\w$])|in(?![\w$])`
Unary <- `(?:delete|void|typeof|await)(?![\w$])|\+\+|--|[-+~!]` Unary | TYPE_CAST Unary2
Unary2 <- Unary3 (!@nl `\+\+|--`)? AS_TAIL
Unary3 <- New Suffix* | `super(?![\w$])` Suffix+ | `import(?![\w$])` ("(" Assign ("," Assign)? ","? ")" | `\.` Name) Suffix* | Primary Suffix*
New <- "new" (`\.` "target" | (New | Primary) (Dot | "[" Exprs "]" | Template)* TypeArgs? Args?)
Suffix <- Dot | `\?\.` (TypeArgs? Args | "[" Exprs "]" | `#?` Name | Template) | "[" Exprs "]" | TypeArgs? Args | TypeArgs? Template NON_NULL
Dot <- `\.(?!\.)` `#?` Name
Args <- "(" (Arg ("," Arg)* ","?)? ")"
Arg <- `(?:\.\.\.)?` Assign
Primary <- `(?:this|null|true|false)(?![\w$])` | FuncExpr | ClassExpr | Ident | `#` Name &`in(?![\w$])` | Str | Number | Template | Regex | "(" Exprs ")" | Array | Object
FuncExpr <- `async(?![\w$])(?=[ \t]+function)|` "function" `\*?` (!`[(<]` Ident)? Signature Block
ClassExpr <- Decorators Abstract? "class" (!`extends(?![\w$])|\{` Ident)? ClassRest
Array <- "[" (`,` | Arg (`,` | &`\]`))* "]"
Object <- "{" (Property ("," Property)* ","?)? "}"
Property <- `\.\.\.` Assign | ObjMethod | (Name | Str | Number | Computed) ":" Assign | Ident (`=(?![=>])` Assign)?
ObjMethod <- (`(?:get|set)(?![\w$])` &`[\w$"'\[\\]` | `async(?![\w$])` !@nl &`[\w$"'\[*\\]`)? `\*?` (Name | Str | Number | Computed) Signature Block
Decorators{deco} <- (`@` (Ident Dot* Args? | "(" Exprs ")"))*
"""

_JS = r"""
TypeOnly <- !``
Abstract <- !``
Implements <- !``
TypeParams <- !``
TypeArgs <- !``
TypeAnn <- !``
ReturnType <- !``
ParamMods <- ``
"""

_TS = r"""
TypeOnly <- `type(?![\w$])(?!\s+(?:from\s*["']|as(?![\w$])\s+(?!as)[\w$]+\s*[,}]|[,}]))(?!\s*[,}=])`
Abstract <- `abstract(?![\w$])(?=\s+class)`
Implements <- "implements" TypeRef ("," TypeRef)*
ParamMods <- `(?:public|private|protected|readonly|override)(?![\w$])(?=\s*[\w$\[{])`*
TypeParams <- `<` TypeParam ("," TypeParam)* ","? `>`
TypeParam <- `(?:(?:const|in|out)(?![\w$])(?=\s+[\w$]))*` Ident ("extends" Type)? (`=(?![=>])` Type)?
TypeArgs <- `<(?![<=])` Type ("," Type)* ","? `>(?![>=])`
TypeAnn <- `:` Type
ReturnType <- `:` (`asserts(?![\w$])(?=\s+[\w$])` Name ("is" Type)? | Name "is" Type | Type)
Type <- FuncType | CondType
CondType <- UnionType ("extends" UnionType `\?` Type ":" Type)?
FuncType <- `abstract(?![\w$])`? "new"? TypeParams? "(" (FuncParam ("," FuncParam)* ","?)? ")" `=>` (`asserts(?![\w$])(?=\s+[\w$])` Name ("is" Type)? | Name "is" Type | Type)
FuncParam <- `(?:\.\.\.)?` (Target | "this") `\??` TypeAnn?
UnionType <- `[|&]?` PostfixType (`[|&](?![|&=])` PostfixType)*
PostfixType <- `(?:keyof|unique|readonly|infer)(?![\w$])(?=\s*[\w$({\["'\x60])` PostfixType | PrimaryType (!@nl ("[" "]" | "[" Type "]"))*
PrimaryType <- "(" Type ")" | Str | `-?` Number | TemplateType | `typeof(?![\w$])` (`import(?![\w$])` "(" Str ")" Dot* | (Ident | "this") Dot*) TypeArgs? | `import(?![\w$])` "(" Type ")" Dot* TypeArgs?
      | MappedType | ObjectType | TupleType | FuncType | `(?:void|null|this|true|false|undefined)(?![\w$])` | TypeRef
TemplateType <- =`\x60(?:[^\x60\\$]|\\[\s\S]|\$(?!\{))*` (`\$\{` Type =`\}(?:[^\x60\\$]|\\[\s\S]|\$(?!\{))*`)* `\x60`
TypeRef <- Ident (`\.(?!\.)` Name)* TypeArgs?
ObjectType <- "{" (TypeMember (`[;,]` | &`\}` | @nl))* "}"
MappedType <- "{" `(?:[+-]?readonly(?![\w$]))?` "[" Name "in" Type ("as" Type)? "]" `(?:[+-]?\?)?` TypeAnn? `;?` "}"
TypeMember <- "new"? TypeSig | `(?:readonly(?![\w$])(?=\s*[\w$\["']))?` "[" Ident ":" Type "]" TypeAnn?
      | `(?:(?:readonly|get|set)(?![\w$])(?=\s*[\w$\["']))?` (Name | Str | Number | Computed) `\??` (TypeSig | TypeAnn?)
TypeSig <- TypeParams? "(" (FuncParam ("," FuncParam)* ","?)? ")" ReturnType?
TupleType <- "[" (TupleItem ("," TupleItem)* ","?)? "]"
TupleItem <- `(?:\.\.\.)?` (Name `\??` `:(?!:)` Type | Type `\??`)
Interface <- `interface(?![\w$])` Ident TypeParams? ("extends" TypeRef ("," TypeRef)*)? ObjectType
Alias <- `type(?![\w$])` !@nl Ident TypeParams? `=(?![=>])` Type End
Enum <- `(?:const(?![\w$])(?=\s+enum))?` "enum" Ident "{" (EnumItem ("," EnumItem)* ","?)? "}"
EnumItem <- (Name | Str | Computed) (`=(?![=>])` Assign)?
Namespace <- `(?:namespace|module)(?![\w$])(?=\s*[\w$"'])` !@nl (Ident Dot* | Str) (NamespaceBody | End)
NamespaceBody <- "{" ModuleItem* "}"
Declare <- `declare(?![\w$])(?=\s+(?:function|class|abstract|const|let|var|enum|namespace|module|global|interface|type|async)(?![\w$]))` (`global(?![\w$])` NamespaceBody | Ambient)
Ambient <- Interface | Alias | Enum | Namespace | `(?:const|let|var)(?![\w$])` Target TypeAnn? (`=(?![=>])` Assign)? ("," Target TypeAnn?)* End | FuncDecl | ClassDecl
"""


_MEMO = (
    "Assign Exprs Signature ArrowHead Target TypeAnn Type TypeArgs TypeParams Modifiers FuncType Block Decorators Unary3 PrimaryType Object"
    " ObjectPattern ArrayPattern Computed TypeOnly"
)


def _grammar(typed: bool) -> Grammar:
    text = _COMMON + (_TS if typed else _JS)
    words = "|".join(w for w in RESERVED.split("|") if not typed or w not in TYPED_WORDS.split("|"))
    fill = {
        "RESERVED": words,
        "MODIFIERS": "static" + ("|public|private|protected|abstract|readonly|override|declare" if typed else ""),
        " IMPORT_EQ": ' | "import" TypeOnly? Ident `=(?![=>])` ("require" "(" Str ")" | Ident Dot*) End' if typed else "",
        " EXPORT_EQ": " | `=(?![=>])` Assign End | \"as\" \"namespace\" Ident End" if typed else "",
        " TYPED_DEFAULT": " | Interface" if typed else "",
        " TYPED_DECL": " | Declare | Interface | Alias | Enum | Namespace" if typed else "",
        " TYPED_MEMBER": " | Modifiers \"[\" Ident \":\" Type \"]\" TypeAnn End" if typed else "",
        " THIS_PARAM": ' | "this" TypeAnn?' if typed else "",
        "(Body | NOBODY_M)": "(Body | End)" if typed else "Body",
        "(Body | NOBODY)": "(Body | End)" if typed else "Body",
        " AS_TAIL": " (!@nl `(?:as|satisfies)(?![\\w$])` (\"const\" | Type))*" if typed else "",
        "TYPE_CAST ": "`<(?![<=])` Type `>` Unary | " if typed else "",
        " NON_NULL": " | !@nl `!(?!=)`" if typed else "",
    }
    for k in sorted(fill, key=len, reverse=True):
        text = text.replace(k, fill[k])
    return Grammar(text, skip=r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*+", memo=_MEMO)


GRAMMAR = _grammar(typed=False)
TYPED = _grammar(typed=True)
