"""Read a TypeScript or Rust file for declarations: blank what is no code, cut it into pieces, follow
the bracket depth.

This is a scanner, not a parser. It knows strings, comments, regular expressions, nested templates and
the text of markup, so that their brackets and quotes do not count. A file whose brackets do not match
after that is reported as not balanced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_NOT_BREAK = re.compile(r"[^\n]")
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\[\s\S])*{q}") for q in "\"'"}
_REGEX = re.compile(r"/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
# Words after which an expression, and so a string or a regular expression, may start.
_BEFORE_EXPRESSION = frozenset(
    "return typeof case in of delete void throw new else do instanceof yield await import from export default as "
    "extends keyof".split()
)
_TS_STOP = re.compile(r"[/\"'`{}]")
_RUST_TOKEN = re.compile(
    r"//[^\n]*|(?P<comment>/\*)|b?r(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes)|b?\"(?:[^\"\\]|\\[\s\S])*\"?"
    r"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))'"
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")


def _blank(text: str) -> str:
    return _NOT_BREAK.sub(" ", text)


def _expression_may_start(text: str, at: int, stops: str) -> bool:
    """Whether what stands before ``at`` lets an expression start there."""
    end = at
    while end and text[end - 1] in " \t\r\n":
        end -= 1
    if not end or text[end - 1] in stops:
        return True
    word = _WORD_BEFORE.search(text, max(0, end - 12), end)
    return bool(word) and word[0] in _BEFORE_EXPRESSION


def blank_typescript(text: str) -> str:
    """Literals and comments as spaces; every other character keeps its place."""
    out: list[str] = []
    at, size = 0, len(text)
    nested: list[int] = []  # open braces inside each ${ } of a template

    def template(start: int) -> int:
        """Blank from inside a template to its end or next substitution."""
        end = _TEMPLATE.match(text, start).end()
        if text.startswith("${", end):
            nested.append(0)
            end += 2
        elif end < size:
            end += 1
        out.append(_blank(text[start:end]))
        return end

    while at < size:
        found = _TS_STOP.search(text, at)
        if not found:
            out.append(text[at:])
            break
        stop = found.start()
        out.append(text[at:stop])
        mark, end = text[stop], stop + 1
        literal = None
        if mark == "/":
            if text.startswith("//", stop):
                # After a colon it is the address in the text of some markup.
                if not (stop and text[stop - 1] == ":" and text[max(0, stop - 2)].isalpha()):
                    end = text.find("\n", stop)
                    literal = text[stop : end if end >= 0 else size]
            elif text.startswith("/*", stop):
                end = text.find("*/", stop + 2)
                literal = text[stop : end + 2 if end >= 0 else size]
            elif _expression_may_start(text, stop, "(,=:[!&|?{};+-*%~^>"):
                literal = m[0] if (m := _REGEX.match(text, stop)) else None
        elif mark in _STRING:
            if _expression_may_start(text, stop, "(,=:[!&|?{};+<>*/%-@"):
                literal = m[0] if (m := _STRING[mark].match(text, stop)) else None
        elif mark == "`":
            out.append(" ")
            at = template(stop + 1)
            continue
        elif mark == "{" and nested:
            nested[-1] += 1
        elif mark == "}" and nested:
            if nested[-1] == 0:
                nested.pop()
                out.append(" ")
                at = template(stop + 1)
                continue
            nested[-1] -= 1
        out.append(mark if literal is None else _blank(literal))
        at = stop + len(literal or mark)
    return "".join(out)


def blank_rust(text: str) -> str:
    """Literals and comments, nested ones included, as spaces."""
    out: list[str] = []
    at = 0
    while found := _RUST_TOKEN.search(text, at):
        start, end = found.span()
        if found["comment"]:
            depth, end = 1, found.end()
            while depth and (edge := _COMMENT_EDGE.search(text, end)):
                depth += 1 if edge[0] == "/*" else -1
                end = edge.end()
            end = len(text) if depth else end
        elif start and found[0][0] in "rb" and (text[start - 1].isalnum() or text[start - 1] == "_"):
            out.append(text[at : start + 1])  # the letter ends a name
            at = start + 1
            continue
        out += (text[at:start], _blank(text[start:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


@dataclass
class Piece:
    """Code of one line up to a bracket, semicolon, or comma of the first depth."""

    line: int
    code: str
    depth: int
    after: int
    first: bool


_MARK = re.compile(r"[{}()\[\];,]")


def pieces(blanked: str) -> tuple[list[Piece], bool]:
    """All pieces that hold code, an empty one for each empty line, and whether brackets balance."""
    found: list[Piece] = []
    depth, balanced = 0, True
    for number, line in enumerate(blanked.split("\n"), 1):
        at, before, first = 0, depth, True

        def cut(end: int) -> None:
            nonlocal at, before, first
            code = line[at:end].rstrip()
            if code.strip():
                found.append(Piece(number, code, before, depth, first))
                first = False
            at, before = end, depth

        for mark in _MARK.finditer(line):
            sign = mark[0]
            if sign == "}":
                cut(mark.start())
            if sign in "{([":
                depth += 1
            elif sign in "})]":
                depth -= 1
                balanced = balanced and depth >= 0
            if sign in "{};" or sign == "," and depth == 1:
                cut(mark.end())
        cut(len(line))
        if first:
            found.append(Piece(number, "", depth, depth, True))
    return found, balanced and depth == 0


def ends(found: list[Piece], goes_on: re.Pattern) -> tuple[list[int], list[int]]:
    """For each piece the line where a declaration that starts there ends, at the top and inside a block."""
    top, inside = [0] * len(found), [0] * len(found)
    last = found[-1].line if found else 0
    next_top = next_inside = last
    following, gap = "", True  # the next code, and whether an empty line or the end comes first
    for i in range(len(found) - 1, -1, -1):
        piece = found[i]
        code = piece.code.strip()
        closed = code.endswith((";", "}")) or following.startswith("}")
        loose = gap and bool(code) and not code.endswith(("=", "|", "&", ","))
        done = bool(code) and (closed or loose) and (code.endswith(";") or not goes_on.match(following))
        if piece.after <= 0 and done:
            next_top = piece.line
        if piece.after <= 1 and bool(code) and (done or code.endswith(",")):
            next_inside = piece.line
        top[i], inside[i] = next_top, next_inside
        if code:
            following, gap = code, False
        else:
            gap = True
    return top, inside
