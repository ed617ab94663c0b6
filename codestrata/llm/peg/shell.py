"""bash."""

from __future__ import annotations

import re

from codestrata.llm.peg.engine import Grammar

_LEX = re.compile(
    r"""'[^']*'|"(?:[^"\\]|\\[\s\S])*"|\\[\s\S]|(?<![^\s;&|()])\#[^\n]*|\$?\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|<<<"""
    r"""|<<(?P<dash>-?)[ \t]*(?P<q>['"\\]?)(?P<word>[A-Za-z_][\w.-]*)(?P=q)?|(?P<nl>\n)"""
)


def layout(text: str) -> str:
    """Same length: the bodies of here-documents blanked (an open one reaches to the end)."""
    out, last, at = [], 0, 0
    waiting: list[tuple[str, bool]] = []
    while (m := _LEX.search(text, at)) is not None:
        at = m.end()
        if m["word"]:
            waiting.append((m["word"], bool(m["dash"])))
        elif m["nl"] and waiting:
            start = at
            for word, dash in waiting:
                end = re.compile(rf"^{'[ \t]*' if dash else ''}{re.escape(word)}$", re.M).search(text, at)
                at = end.end() if end else len(text)
            out.append(text[last:start] + re.sub(r"[^\n]", " ", text[start:at]))
            last = at
            waiting = []
    return "".join(out) + text[last:]


GRAMMAR = Grammar(
    r"""
File <- NL* List? `\Z`
-NL <- `\n`
-B <- ``
List <- AndOr (Sep+ AndOr)* Sep*
Sep <- `;(?![;&])|&(?![&>])` NL* | NL+
AndOr <- Pipeline (`&&|\|\|` NL* Pipeline)*
Pipeline <- (`time(?=\s)` `-p(?=\s)`?)? (`!(?=\s)`)* Command (`\|&?(?!\|)` NL* Command)*
Command <- FuncDef | Compound Redirect* | Coproc | Simple
Coproc <- `coproc(?=\s)` Command
FuncDef{fn} <- (`function(?=[ \t])` FuncName (`\(` `\)`)? | !Reserved FuncName `\(` `\)`) NL* Body
-FuncName{name} <- `[^\s()<>&|;"'$\x60\\={}\#][^\s()<>&|;"'$\x60\\={}]*`
Body{body} <- Compound Redirect*
-Reserved <- `(?:if|then|else|elif|fi|do|done|case|esac|while|until|for|select|function|\{|\}|!|\[\[|time|coproc)(?=[\s;&|()<>]|\Z)`
Compound <- Brace | Arith | Subshell | CondCmd | If | Loop | For | Case
Brace <- `\{(?=\s)` NL* List `\}(?=[\s;&|()<>]|\Z)`
Subshell <- `\(` NL* List `\)`
Arith <- `\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)`
CondCmd <- `\[\[(?=\s)` CondItem+ `\]\](?=[\s;&|)<>]|\Z)`
CondItem <- !`\]\](?=[\s;&|)<>]|\Z)` (NL | Word | `&&|\|\||[<>()|]`)
If <- `if(?=[\s;(])` NL* List `then(?=[\s;(])` NL* List (`elif(?=[\s;(])` NL* List `then(?=[\s;(])` NL* List)* (`else(?=[\s;(])` NL* List)? `fi(?=[\s;&|()<>]|\Z)`
Loop <- `(?:while|until)(?=[\s;(])` NL* List DoGroup
DoGroup <- `do(?=[\s;(])` NL* List `done(?=[\s;&|()<>]|\Z)`
For <- `(?:for|select)(?=[\s(])` (Arith | `[A-Za-z_]\w*`) (NL* `in(?=[\s;])` Word*)? `;?` NL* (DoGroup | Brace)
Case <- `case(?=\s)` Word NL* `in(?=\s)` NL* (CaseItem)* `esac(?=[\s;&|()<>]|\Z)`
CaseItem <- !`esac(?=[\s;&|()<>]|\Z)` `\(?` NL* Word (`\|` Word)* `\)` NL* List? (`;;&|;;|;&` NL* | &`esac\b`)
Simple <- (Assign | Redirect)+ (!Reserved Arg (Arg | Redirect)*)? | !Reserved Arg (Arg | Redirect)*
Assign <- =`[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=` (ArrayLit | Part* B)
ArrayLit <- `\(` (NL | =`\[[^\]\n]*\]=` Part* B | Word)* `\)`
Arg <- =`[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=(?=\()` ArrayLit | Word
Word <- !`\#` Part+ B
Part <- =`(?:[^\s"'\x60$\;&|()<>?*+@!]|\\[\s\S]|[?*+@!](?!\())+` | =`'[^']*'` | Double | Expansion | =`\x60(?:[^\x60\\]|\\[\s\S])*\x60` | =`[?*+@!]\((?:[^()\n]|\([^()\n]*\))*\)` | `[<>]\(` NL* List =`\)`
Double <- =`"` DoublePart* =`"`
DoublePart <- =`(?:[^"\\$\x60]|\\[\s\S])+` | ExpansionQ | =`\x60(?:[^\x60\\]|\\[\s\S])*\x60`
Expansion <- =`\$\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)` | `\$\(` NL* List? =`\)` | =`\$\{` ParamPart* =`\}` | =`\$'(?:[^'\\]|\\[\s\S])*'` | =`\$(?:\w+|[@*\#?$!-]|(?![({]))`
ParamPart <- =`(?:[^"'\x60$\\}]|\\[\s\S])+` | =`'[^']*'` | Double | Expansion | =`\x60(?:[^\x60\\]|\\[\s\S])*\x60`
ExpansionQ <- =`\$\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)` | `\$\(` NL* List? =`\)` | =`\$\{` ParamPartQ* =`\}` | =`\$(?:\w+|[@*\#?$!-]|(?![({]))`
ParamPartQ <- =`(?:[^"\x60$\\}]|\\[\s\S])+` | Double | ExpansionQ | =`\x60(?:[^\x60\\]|\\[\s\S])*\x60`
Redirect <- `(?:\d+(?=[<>])|\{\w+\}(?=[<>]))?(?:<<<|<<-?|<>|<&|>&|>>|>\||&>>?|[<>](?!\())` Word
""",
    skip=r"(?:[ \t]+|\\\n|(?<![^\s;&|()])\#[^\n]*)*+",
    memo="Part Sep Word Command List Expansion ExpansionQ Double",
)
