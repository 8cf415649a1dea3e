"""Tokens of a formula."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Token kinds.
TEXT, NUMBER, LOGICAL, ERROR, FUNC, REF, OPEN, CLOSE, SEP, OP, POSTFIX, ARRAY, SPACE, OTHER = "text number logical error func ref open close sep op postfix array space other".split()

_ERRORS = "#NULL!|#DIV/0!|#VALUE!|#REF!|#NAME\\?|#NUM!|#N/A|#GETTING_DATA"
_SHEET = r"(?:'(?:[^']|'')+'|\[[^\]]+\][^\s!+\-*/^&=<>(),;:\"']*|[^\W\d][\w.]*(?::[^\W\d][\w.]*)?)!"
_CELL = r"\$?[A-Za-z]{1,3}\$?[1-9]\d*"
_PART = rf"(?:{_CELL}(?:\#)?|\$?[A-Za-z]{{1,3}}(?=:\$?[A-Za-z]{{1,3}}(?![\w(]))|\$?\d+(?=:\$?\d+))"
_RULES = [
    (SPACE, r"\s+"),
    (TEXT, r'"(?:[^"]|"")*"'),
    (ERROR, rf"(?:{_SHEET})?(?:{_ERRORS})"),
    (FUNC, r"[A-Za-z_][\w.]*\("),
    (REF, rf"(?:{_SHEET})?(?:{_CELL}(?::{_CELL})?\#?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?\d+:\$?\d+)(?![\w(\[])"),
    (NUMBER, r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"),
    (LOGICAL, r"(?i:TRUE|FALSE)(?![\w.(])"),
    (REF, rf"(?:{_SHEET})?[^\W\d][\w.\\?]*(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\])?"),
    (REF, r"\[(?:[^\[\]]|\[[^\[\]]*\])*\][^\s+\-*/^&=<>(),;:]*"),
    (ARRAY, r"\{[^}]*\}"),
    (OPEN, r"\("), (CLOSE, r"\)"), (SEP, "[,;]"),
    (OP, r"<=|>=|<>|[-+*/^&=<>:@]"), (POSTFIX, "%"), (OTHER, "."),
]
_LEX = re.compile("|".join(f"(?P<k{i}>{rule})" for i, (_, rule) in enumerate(_RULES)), re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokens(formula: str) -> list[Token]:
    """Tokens of a formula with or without its leading equals sign; their texts joined give the formula."""
    body = formula[1:] if formula.startswith("=") else formula
    return [Token(_RULES[int(m.lastgroup[1:])][0], m[0]) for m in _LEX.finditer(body)]


_ROW = re.compile(r"(\$?[A-Za-z]{1,3})(\$?)([1-9]\d*)")


def pattern(formula: str) -> str:
    """The formula with the row numbers of its cell references as #: formulas filled down a column share it."""
    out = []
    for token in tokens(formula):
        text = token.text
        if token.kind == REF and re.fullmatch(rf"(?:{_SHEET})?{_CELL}(?::{_CELL})?\#?", text):
            sheet, mark, cells = text.rpartition("!")
            text = sheet + mark + _ROW.sub(lambda m: m[1] + ("$" + m[3] if m[2] else "#"), cells)
        out.append(text)
    return "=" + "".join(out)
