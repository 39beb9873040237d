"""Tokens of a C# source text with their lines."""

from __future__ import annotations

import re
from typing import NamedTuple

_PLAIN_STRING = r"""@"(?:[^"]|"")*"|\"\"\"+.*?\"\"\"+|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
_PATTERN = re.compile(
    r"""(?P<doc>///[^\n]*|/\*\*(?!/).*?(?:\*/|\Z))|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*\#[^\n]*)"""
    r"""|(?P<holed>@?\$+@?(?="))"""
    rf"""|(?P<string>{_PLAIN_STRING})"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<name>@?[^\W\d]\w*)"""
    r"""|(?P<op>=>|\?\.|\?\?=?|::|->|&&|\|\||[=!<>+\-*/%&|^]=|[^\w\s])""",
    re.S | re.M,
)
_INNER_STRING = re.compile(_PLAIN_STRING, re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|elif|else|endif|define|undef)\b([^\n]*)", re.M)
_CONDITION = re.compile(r"\w+|&&|\|\||==|!=|[!()]")


class Token(NamedTuple):
    """kind is name, string, number, op or doc."""

    kind: str
    text: str
    line: int


class Tokens(list):
    """The tokens of a text; ``match`` has the index of each bracket's partner, -1 without one."""

    def pair(self) -> None:
        """Find the partners of all brackets in one pass; brackets that fit none are passed over."""
        self.match = [-1] * len(self)
        open_: list[int] = []
        for k, t in enumerate(self):
            if t.kind == "op":
                if t.text in _OPEN:
                    open_.append(k)
                elif t.text in _CLOSE and open_ and _OPEN[self[open_[-1]].text] == t.text:
                    at = open_.pop()
                    self.match[at], self.match[k] = k, at


_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())


def _holes(code: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the interpolated string at ``at`` and the ranges of its holes."""
    k = at
    while code[k] in "$@":
        k += 1
    dollars, verbatim = code.count("$", at, k), "@" in code[at:k]
    quotes = 0
    while k + quotes < len(code) and code[k + quotes] == '"':
        quotes += 1
    raw = quotes >= 3 and not verbatim
    stop = '"' * quotes if raw else '"'
    braces = dollars if raw else 1
    k += quotes if raw else 1
    holes: list[tuple[int, int]] = []
    while k < len(code):
        c = code[k]
        if c == '"' and code.startswith(stop, k) and not (verbatim and code.startswith('""', k)):
            return k + len(stop), holes
        if c == '"' and verbatim:
            k += 2
        elif c == "\\" and not raw and not verbatim:
            k += 2
        elif c == "\n" and not raw and not verbatim:
            break
        elif c == "{":
            n = 1
            while code.startswith("{", k + n):
                n += 1
            k += n
            if (n >= braces) if raw else n % 2:
                end = _hole_end(code, k)
                holes.append((k, end))
                k = end + braces
        else:
            k += 1
    return k, holes


def _hole_end(code: str, k: int) -> int:
    """Where the hole that begins at ``k`` ends: at the brace that closes it."""
    depth = 0
    while k < len(code):
        c = code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if c == "}" and depth <= 0:
                return k
            depth -= 1
        elif c in "$@" and (m := re.compile(r"@?\$+@?(?=\")").match(code, k)):
            k, _ = _holes(code, m.start())
            continue
        elif c in "\"'@" and (m := _INNER_STRING.match(code, k)):
            k = m.end()
            continue
        k += 1
    return k


def _holds(condition: str, symbols: set[str]) -> bool:
    """Value of a directive's condition; symbols that are not defined are false."""
    words = _CONDITION.findall(condition.split("//")[0])
    text = " ".join(
        {"&&": "and", "||": "or", "!": "not", "true": "True", "false": "False"}.get(w, w if w in ("(", ")", "==", "!=") else str(w in symbols))
        for w in words
    )
    try:
        return bool(eval(text, {"__builtins__": {}}))  # of True, False, and, or, not, == and brackets alone
    except SyntaxError:
        return False


def _branch(code: str, at: int) -> re.Match | None:
    """The next #elif, #else or #endif of the same level from ``at`` on."""
    depth = 0
    for m in _DIRECTIVE.finditer(code, at):
        if m.group(1) == "if":
            depth += 1
        elif m.group(1) == "endif" and depth:
            depth -= 1
        elif not depth and m.group(1) in ("elif", "else", "endif"):
            return m
    return None


def tokenize(code: str) -> Tokens:
    """All tokens but ordinary comments and directives; ``///`` lines and ``/** */`` are kept as doc.

    Branches of ``#if`` whose condition does not hold are skipped; only what the file defines
    holds. An interpolated string is followed by its holes in braces.
    """
    out = Tokens()
    code = code.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    _tokens(code, 0, len(code), 1, out)
    out.pair()
    return out


def _tokens(code: str, start: int, stop: int, line: int, out: Tokens) -> None:
    symbols: set[str] = set()
    taken: list[bool] = []  # of each open #if, whether a branch was taken
    at = k = start
    while (m := _PATTERN.search(code, k, stop)) is not None:
        begin, k = m.start(), m.end()
        line += code.count("\n", at, begin)
        at = begin
        kind, text = m.lastgroup, m.group()
        if kind == "comment":
            continue
        if kind == "directive":
            d = _DIRECTIVE.match(code, begin)
            while d is not None:
                word, rest = d.group(1), d.group(2)
                if word in ("define", "undef"):
                    (symbols.add if word == "define" else symbols.discard)(rest.strip())
                elif word == "endif":
                    if taken:
                        taken.pop()
                elif word == "if" or taken:
                    holds = word == "else" or _holds(rest, symbols)
                    if word == "if":
                        taken.append(False)
                    if taken[-1] or not holds:
                        d = _branch(code, d.end())
                        k = stop if d is None else d.end()
                        continue
                    taken[-1] = True
                break
        elif kind == "holed":
            end, holes = _holes(code, begin)
            k = min(end, stop)
            out.append(Token("string", code[begin:k], line))
            for a, b in holes:
                inner = line + code.count("\n", begin, a)
                out.append(Token("op", "{", inner))
                _tokens(code, a, min(b, stop), inner, out)
                out.append(Token("op", "}", inner))
        elif kind == "doc" and text.startswith("/*"):
            for n, row in enumerate(text[3:].removesuffix("*/").split("\n")):
                out.append(Token("doc", "///" + row.strip().removeprefix("*"), line + n))
        else:
            out.append(Token(kind, text[1:] if kind == "name" and text[0] == "@" else text, line))


def closing(tokens: Tokens, at: int, end: int) -> int:
    """Index of the bracket that closes the one at ``at``; ``end`` if none does."""
    found = tokens.match[at]
    return found if at < found < end else end


def closing_angle(tokens: Tokens, at: int, end: int) -> int | None:
    """Index of the ``>`` of a list of type arguments opened at ``at``; None if it is none."""
    depth = 0
    for k in range(at, end):
        t = tokens[k]
        if t.kind == "op":
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if depth == 0:
                    return k
            elif t.text not in (",", ".", "?", "[", "]", "::", "(", ")", "*"):
                return None
        elif t.kind not in ("name",):
            return None
    return None


def pieces(tokens: Tokens, start: int, end: int, separator: str = ",") -> list[tuple[int, int]]:
    """Ranges between separators outside of brackets and type arguments."""
    out, last, k = [], start, start
    while k < end:
        t = tokens[k]
        if t.kind == "op":
            if t.text in _OPEN:
                k = closing(tokens, k, end)
            elif t.text == "<" and (c := closing_angle(tokens, k, end)) is not None:
                k = c
            elif t.text == separator:
                out.append((last, k))
                last = k + 1
        k += 1
    if last < end:
        out.append((last, end))
    return out
