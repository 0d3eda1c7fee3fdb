"""Brackets of C text: what regular expressions cannot match, on one text at a time.

Comments, literals and directives are blanked at equal length first, so positions and lines stay. The depth of every
position is a running sum over the brackets; blocks, statements and arguments are cut where the depth returns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from codefacts.functions import fixed

NAME = r"[A-Za-z_]\w*"
_QUIET = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|^[ \t]*\#(?:\\\r?\n|[^\n])*|(?<!\w)\.?\d[\w.]*""", re.S | re.M)
_HEAD = re.compile(rf"\b(struct|union)\b\s*({NAME})?\s*\{{")
_ALIAS = re.compile(rf"[\s*]*({NAME})\s*(?:\[[^\]]*\]\s*)*[,;]")
_SIGNATURE = re.compile(rf"(.*[\s*])({NAME})\s*\Z", re.S)
_POINTER = re.compile(rf"\(\s*\*\s*({NAME})")
_MEMBER = re.compile(rf"({NAME})\s*((?:\[[^\]]*\]\s*)*)(?::.*)?\Z", re.S)
_FIELD = re.compile(rf"([\w\])])\s*(?:->|\.)\s*({NAME})(\s*(?:<<|>>|[-+*/%&|^])?=(?!=))?")
_ASSIGN = re.compile(rf"(?<![=!<>+\-*/%&|^])=(?!=)\s*&?\s*({NAME})\s*(?=[;,)}}])")
_CALL = re.compile(rf"({NAME})\s*\(")
_PLAIN = re.compile(rf"\s*&?\s*({NAME})\s*\Z")
_REGISTER = re.compile(fixed.REGISTER_CALL)
_NOT_NAMES = {"if", "while", "for", "switch", "return", "sizeof", "else", "do", "case", "goto", "typedef", "defined", "__attribute__"}


def _comment(m: re.Match) -> str:
    found = m.group()
    return re.sub(r"[^\n]", " ", found) if found[0] == "/" or found.lstrip()[:1] == "#" else found


def _blank(m: re.Match) -> str:
    found = m.group()
    if found[0].isdigit() or (found[0] == "." and len(found) > 1):
        return "0" * len(found)  # a number stays a value without a point
    return _comment(m) if found[0] == "/" or found.lstrip()[:1] == "#" else '"' + " " * (len(found) - 2) + '"'


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Source:
    """One text with its brackets."""

    def __init__(self, text: str):
        self.text = text
        self.code = _QUIET.sub(_blank, text)
        self.bytes = np.frombuffer(self.code.encode("utf-32-le"), np.uint32)

    @cached_property
    def plain(self) -> str:
        """The text without comments and directives; literals stay readable."""
        return _QUIET.sub(_comment, self.text)

    @cached_property
    def newlines(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    @cached_property
    def braces(self) -> np.ndarray:
        return self._depth("{}")

    @cached_property
    def round(self) -> np.ndarray:
        return self._depth("()")

    @cached_property
    def square(self) -> np.ndarray:
        return self._depth("[]")

    def _depth(self, pair: str) -> np.ndarray:
        """Depth before every position; the opening and the closing bracket of a pair have the same outside depth."""
        step = np.zeros(len(self.bytes) + 2, np.int32)
        step[1:-1] += self.bytes == ord(pair[0])
        step[:-2] -= self.bytes == ord(pair[1])
        return np.cumsum(step)

    def line(self, position: int) -> int:
        return bisect_right(self.newlines, position - 1) + 1

    def close(self, opened: int, closing: str, depth: np.ndarray) -> int:
        """Position of the bracket that closes the one at ``opened``; the end of the text where none does."""
        outside = depth[opened]
        at = opened
        while (at := self.code.find(closing, at + 1)) >= 0:
            if depth[at] == outside:
                return at
        return len(self.code)

    def before(self, position: int) -> str:
        """The character before a position, white space left out; empty at the start."""
        while position > 0 and self.code[position - 1].isspace():
            position -= 1
        return self.code[position - 1 : position]

    def statement(self, position: int) -> int:
        """Where the statement that holds a position starts."""
        return max(self.code.rfind(c, 0, position) for c in ";{}") + 1

    def open(self, closed: int, opening: str, depth: np.ndarray, least: int) -> int:
        at = closed
        while (at := self.code.rfind(opening, least, at)) >= 0:
            if depth[at] == depth[closed]:
                return at
        return -1

    def parts(self, start: int, end: int, mark: str) -> Iterator[tuple[int, int]]:
        """Pieces of a range between marks that no bracket inside it holds."""
        level = (self.braces[start], self.round[start], self.square[start])
        begin = at = start
        while (at := self.code.find(mark, at, end)) >= 0:
            if (self.braces[at], self.round[at], self.square[at]) == level:
                yield begin, at
                begin = at + 1
            at += 1
        yield begin, end

    @cached_property
    def functions(self) -> list[dict]:
        """Definitions and prototypes at file level, also in an ``extern "C"`` block, over as many lines as they take."""
        found, start, at = [], 0, 0
        outer = 0
        for m in re.finditer(r"[{};]", self.code):
            p = m.start()
            if p < at:
                continue
            if m.group() == "{":
                if re.search(r'\bextern\s*"\s*"\s*\Z', self.code[start:p]):
                    outer, start, at = outer + 1, p + 1, p + 1
                    continue
                end = self.close(p, "}", self.braces)
                if (head := self._signature(start, p)) is not None:
                    found.append(head | {"end_line": self.line(min(end, max(len(self.code) - 1, 0))), "definition": True, "from": p, "to": end})
                    start = end + 1
                at = end + 1
                if head is None and self.code[start:p].strip() == "":
                    start = end + 1
            elif m.group() == ";":
                if (head := self._signature(start, p)) is not None:
                    found.append(head | {"end_line": self.line(p), "definition": False, "from": p, "to": p})
                start = at = p + 1
            else:
                start = at = p + 1
        return found

    def _signature(self, start: int, end: int) -> dict | None:
        """Return type, name and named parameters of the declaration in a range, if it is one of a function."""
        last = len(self.code[start:end].rstrip()) + start
        if last == start or self.code[last - 1] != ")" or "=" in self.code[start:last]:
            return None
        opened = self.open(last - 1, "(", self.round, start)
        begin = opened
        while begin > start and (self.code[begin - 1].isalnum() or self.code[begin - 1] in "_*" or self.code[begin - 1].isspace()):
            begin -= 1
        m = _SIGNATURE.match(self.code[begin:opened]) if opened > 0 else None
        if m is None or not m.group(1).strip() or m.group(2) in _NOT_NAMES or _NOT_NAMES & set(m.group(1).split()):
            return None
        names = []
        for a, b in self.parts(opened + 1, last - 1, ","):
            one = self.code[a:b]
            pointer = _POINTER.search(one)
            plain = re.search(rf"[\s*]({NAME})\s*(?:\[[^\]]*\]\s*)*\Z", one)
            name = pointer or (plain if plain and one[: plain.start(1)].strip() not in ("", "struct", "enum", "union", "const", "unsigned") else None)
            if name:
                names.append(name.group(1))
        begin += len(m.group(1)) - len(m.group(1).lstrip())
        return {"name": m.group(2), "start_line": self.line(begin), "return_type": squeezed(m.group(1)), "parameters": names}

    def enclosing(self, position: int) -> str | None:
        """Name of the definition whose body holds a position."""
        bodies = self._bodies
        i = bisect_right(bodies[0], position) - 1
        return bodies[2][i] if i >= 0 and position <= bodies[1][i] else None

    @cached_property
    def _bodies(self) -> tuple[list[int], list[int], list[str]]:
        own = [f for f in self.functions if f["definition"]]
        return [f["from"] for f in own], [f["to"] for f in own], [f["name"] for f in own]

    def fields(self) -> Iterator[dict]:
        """Members of named structs and unions that no other block holds: the first declarator of each."""
        done = 0
        for m in _HEAD.finditer(self.code):
            if m.start() < done:
                continue
            p = m.end() - 1
            end = done = self.close(p, "}", self.braces)
            typedef = re.search(r"\btypedef\b", self.code[self.statement(m.start()) : m.start()])
            alias = _ALIAS.match(self.code, end + 1) if typedef else None
            name = alias.group(1) if alias else m.group(2)
            if name is None:
                continue
            members = [(a, b) for a, b in self.parts(p + 1, end, ";") if self.code[a:b].strip()]
            for pos, (a, b) in enumerate(members):
                yield from self._member(name, pos, a, b)

    def _member(self, struct: str, pos: int, start: int, end: int) -> Iterator[dict]:
        pieces = list(self.parts(start, end, ","))
        head = self.code[start : pieces[0][1]]
        outside = head[: head.find("{")] + head[head.rfind("}") :] if "{" in head else head
        pointer = _POINTER.search(outside)
        row = {"struct": struct, "pos": pos, "line": self.line(start + len(head) - len(head.lstrip()))}
        if pointer:
            whole = squeezed(self.plain[start:end])
            yield row | {"name": pointer.group(1), "type": re.sub(rf"(\(\s*\*\s*){NAME}", r"\1", whole, count=1), "is_function_pointer": True}
        elif m := _MEMBER.search(head.rstrip()):
            kind, array = self.plain[start : start + m.start(1)], self.plain[start + m.start(2) : start + m.end(2)]
            yield row | {"name": m.group(1), "type": squeezed(kind) + squeezed(array), "is_function_pointer": False}

    def usage(self) -> Iterator[dict]:
        """Fields read and written: the whole left side of an assignment is written, any other access reads."""
        at = 0
        while m := _FIELD.search(self.code, at):
            yield {"line": self.line(m.start(2)), "field": m.group(2), "access": "write" if m.group(3) else "read", "function": self.enclosing(m.start(2))}
            at = m.end(2) - 1

    def bindings(self) -> Iterator[dict]:
        """Places where a name is bound that may be a function: fields, tables, variables, initialisers, registering calls."""
        row = lambda p, name, via, field="": {"line": self.line(p), "name": name, "via": via, "field": field, "caller_hint": self.enclosing(p)}
        for m in _ASSIGN.finditer(self.code):
            left = self._left(m.start())
            if left is not None:
                yield row(m.start() if left[2] is None else left[2], m.group(1), left[0], left[1])
        inside = 0
        for m in re.finditer(r"\{", self.code):
            p, mark = m.start(), self.before(m.start())
            if mark == "=" or (p < inside and mark in ("{", ",")):  # a list, or a list in a list
                end = self.close(p, "}", self.braces)
                inside = max(inside, end)
                for a, b in self.parts(p + 1, end, ","):
                    if one := _PLAIN.match(self.code[a:b]):
                        yield row(p, one.group(1), "table_assign")
        for m in _CALL.finditer(self.code):
            if _REGISTER.match(m.group(1)) and (self.enclosing(m.start()) is not None or self.before(m.start()) in ("", ";", "{", "}")):
                for a, b in self.parts(m.end(), self.close(m.end() - 1, ")", self.round), ","):
                    if one := _PLAIN.match(self.code[a:b]):
                        yield row(m.start(), one.group(1), "register_call")

    def _left(self, equals: int) -> tuple[str, str, int | None] | None:
        """How the left side of an assignment binds: via, field, and where the assignment starts."""
        begin = self.statement(equals)
        left = self.code[begin:equals].rstrip()
        if m := re.search(rf"(?:\A|[{{,])\s*\.\s*{NAME}\Z", left):
            return "field_assign", "", begin + m.start() + left[m.start() :].find(".")
        if m := re.search(rf"(?:->|\.)\s*({NAME})\Z", left):
            return "field_assign", m.group(1), self._first(begin, left)
        if left.endswith("]"):
            opened = self.open(begin + len(left) - 1, "[", self.square, begin)
            head = self.code[begin:opened].rstrip() if opened >= 0 else ""
            if opened >= 0 and (not head or head.endswith((",", "{"))):
                return "field_assign", "", opened
            declared = re.match(rf"\s*(?:{NAME}[\s*]+)+{NAME}\s*\Z", head)
            return None if declared and not re.match(r"\s*(?:else|do)\b", head) else ("table_assign", "", self._first(begin, left))
        m = re.search(rf"({NAME})\Z", left)
        before = re.sub(r"^\s*(?:else|do)\b", "", left[: m.start()]).rstrip() if m else "x"
        if m and (not before or before[-1] in "(),:=?"):
            return "var_assign", "", begin + m.start()
        return None

    def _first(self, begin: int, left: str) -> int:
        """Where the expression starts that ends a left side: after the last bracket, comma or blank that is no part of it."""
        depth, at = 0, len(left)
        while at > 0:
            c = left[at - 1]
            if c in ")]":
                depth += 1
            elif c in "([":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and not (c.isalnum() or c in "_.->" or c.isspace()):
                break
            at -= 1
        return begin + at + len(left[at:]) - len(left[at:].lstrip())
