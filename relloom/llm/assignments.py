"""Tokens and assignments of source and configuration texts: which literals reach which names.

A text is read token by token: strings (prefixed, triple-quoted, in backticks), names with subscripts, signs
of assignment, braces, ends of lines with their indentation, and XML tags. Between them, anything may stand:
texts are mostly prose, so a token that makes no sense starts nothing. From the tokens come assignments:

* a target is a name, a quoted key, or a name with subscripts (``os.environ["DB_PWD"]``, ``char pwd[]``);
* a type between ``:`` and ``=`` is passed over (``pwd: str = ...``);
* a value is a run of strings, joined by ``+``, ``.`` or nothing, in parentheses also over several lines with
  comments between them, or a bare word; a bare word, ``$NAME``, ``${NAME}`` and ``f"{NAME}"`` refer to names;
* keys nested by indentation, braces or under a section belong to the keys around them;
* an XML element's text and an attribute ``value`` belong to the tag and to the attributes ``name``, ``key``, ``id``.

Strings are read again inside, so assignments in them are found too. A reference stands for the latest
definition of its name before it, or the first one behind it. All steps take time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])[rRbBuUfF]{0,2}(?P<quote>\"\"\"|'''|[\"'`])"
    r"|(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?=[ \t]*+[:=+\[])"
    r"|(?P<sign>:=|=>|==+|::+|\+=|[!<>]=|[:=])"
    r"|(?P<brace>[{}])"
    r"|\n(?P<line>[ \t]*+(?:-[ \t]++)?)"
    r"|<(?P<tag>[A-Za-z_][\w.:\-]*+)",
    re.ASCII,
)
QUOTE = re.compile(r"(?<![A-Za-z0-9_])(?P<prefix>[rRbBuUfF]{0,2})(?P<quote>\"\"\"|'''|[\"'`])")
BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
SUBSCRIPT = re.compile(
    r"\[[ \t]*+(?:\"([^\"\n\]]*+)\"|'([^'\n\]]*+)'|([A-Za-z0-9_.]*+))[ \t]*+\](?:\.([A-Za-z_][A-Za-z0-9_.]*+))?", re.ASCII
)
_PLAIN = r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[(?:[^\]\[\n:=]|\[[^\]\[\n:=]*+\])*+\])?"
ANNOTATION = re.compile(rf"[ \t]*+([A-Za-z_][A-Za-z0-9_.]*+)(?:\[(?:[^\]\[\n:=]|\[[^\]\[\n:=]*+\])*+\])?"
                        rf"(?:[ \t]*+\|[ \t]*+{_PLAIN})*+[ \t]*+=(?![=>])", re.ASCII)
ASSIGNS = {":", "=", ":=", "=>", "+="}
#: A bare value; a name with a sign and more behind it is the next assignment's target.
BARE = re.compile(
    r"(?![A-Za-z_][A-Za-z0-9_.\-]*+=[A-Za-z0-9+/_.\-\"'])[A-Za-z0-9+/_.=\-]+|[A-Za-z_][A-Za-z0-9_.\-]*+", re.ASCII
)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*", re.ASCII)
REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.]*+)\}?|\{([A-Za-z_][A-Za-z0-9_.]*+)\}", re.ASCII)
FIELD = re.compile(r"\{[^{}]*+\}")
JOINER = re.compile(r"[ \t]*+(?:[+.&][ \t]*+)?(?:\\\n[ \t]*+)?")
BLANK = re.compile(r"[ \t]*+")
NEXT_LINE = re.compile(r"[ \t\r]*+(?:(?:#|//)[^\n]*+)?\n")
LINES = re.compile(r"(?:[ \t\r\n]++|(?:#|//)[^\n]*+\n)*+")
LINE_END = re.compile(r"[ \t\r]*+(?:#[^\n]*+|[|>][+\-]?[ \t\r]*+)?(?=\n)")
SECTION = re.compile(r"\[{1,2}([A-Za-z0-9_. \-]++)\]{1,2}[ \t\r]*+(?=\n|$)", re.ASCII)
ATTRIBUTES = re.compile(r"([^<>]*+)>")
NAMING = re.compile(r"(?<![\w\-])(?:name|key|id)[ \t]*+=[ \t]*+(?:\"([^\"]*+)\"|'([^']*+)')", re.ASCII)
VALUE = re.compile(r"(?<![\w\-])value[ \t]*+=[ \t]*+(?:\"([^\"\s]*+)\"|'([^'\s]*+)')", re.ASCII)
ELEMENT = re.compile(r"\s*+([^<>\s]++)\s*+</")


class Pair(NamedTuple):
    """A literal's parts, and what it is assigned to: names, the name around them, or a name it refers to."""

    names: list[str]
    spans: list[tuple[int, int]]
    literal: str
    refers: str | None
    around: str | None
    at: int


class _Region:
    """One pass over a stretch of a text; strings in it are left in ``inner`` for passes of their own."""

    def __init__(self, text: str, at: int, end: int, sensitive: Callable[[str], float]):
        self.text, self.end, self.sensitive = text, end, sensitive
        self.pairs: list[Pair] = []
        self.inner: list[tuple[int, int]] = []
        self.open: dict[str, int] = {}  # up to where a quote is known not to be closed
        self.lines = (0, -1)  # the last run of blank and comment lines
        self._read(at)

    def _string(self, m: re.Match) -> tuple[int, int, int] | None:
        """(start, end of the content, end of the string), or None if nothing closes it."""
        q, lo = m["quote"], m.end()
        if len(q) == 3:
            hi = self.text.find(q, lo, self.end)
            return (lo, hi, hi + 3) if hi >= 0 else None
        if lo <= self.open.get(q, -1):
            return None
        hi = BODY[q].match(self.text, lo, self.end).end()
        if hi < self.end and self.text[hi] == q:
            return lo, hi, hi + 1
        self.open[q] = hi
        return None

    def _inside(self, lo: int, hi: int) -> str:
        content = self.text[lo:hi]
        if ":" in content or "=" in content or "</" in content:
            self.inner.append((lo, hi))
        return content

    def _skip(self, at: int, nested: bool) -> int:
        """Past blanks; inside parentheses past line ends and comments too."""
        m = NEXT_LINE.match(self.text, at, self.end) if nested else None
        if not m:
            return BLANK.match(self.text, at, self.end).end()
        if not self.lines[0] <= m.end() <= self.lines[1]:
            self.lines = (m.end(), LINES.match(self.text, m.end(), self.end).end())
        return self.lines[1]

    def _name(self, m: re.Match) -> tuple[str, int]:
        """A name with its subscripts, and its end."""
        parts, end = [m["name"]], m.end("name")
        while s := SUBSCRIPT.match(self.text, end, self.end):
            parts += [g for g in s.groups() if g]
            end = s.end()
        return ".".join(parts), end

    def _value(self, at: int) -> tuple[list[tuple[int, int]], str, str | None, int] | None:
        """(spans, literal, name referred to, end of what is read) of the value that starts here."""
        text, depth = self.text, 0
        at = self._skip(at, False)
        while text.startswith("(", at, self.end):
            depth += 1
            at = self._skip(at + 1, True)
        spans, parts, refers = [], [], None
        m = QUOTE.match(text, at, self.end)
        while m and (string := self._string(m)):
            lo, hi, at = string
            content = self._inside(lo, hi)
            refers = REFERENCE.fullmatch(content) if content[:1] == "$" or "f" in m["prefix"].lower() else None
            if not refers:
                spans.append((lo, hi))
                parts.append(FIELD.sub("", content) if "f" in m["prefix"].lower() else content)
            behind = self._skip(at, depth > 0)
            while depth and text.startswith(")", behind, self.end):
                depth -= 1
                at = behind + 1
                behind = self._skip(at, depth > 0)
            behind = self._skip(JOINER.match(text, behind, self.end).end(), depth > 0)
            m = QUOTE.match(text, behind, self.end)
        if spans:
            return spans, "".join(parts), None, at
        if refers:
            return [], "", refers[1] or refers[2], at
        if m:
            return None
        if found := REFERENCE.match(text, at, self.end):
            return ([], "", found[1], found.end()) if found[1] else None
        bare = BARE.match(text, at, self.end)
        if not bare:
            return None
        name = NAME.fullmatch(bare[0])
        # A bare name may itself be the target of the next assignment.
        return [bare.span()], bare[0], name and name[0], at if name else bare.end()

    def _tag(self, m: re.Match) -> None:
        attributes = ATTRIBUTES.match(self.text, m.end(), self.end)
        if not attributes:
            return
        names = [m["tag"], *(a or b for a, b in NAMING.findall(attributes[1]))]
        found = [v.span(1 if v[1] is not None else 2) for v in VALUE.finditer(self.text, *attributes.span(1))]
        element = ELEMENT.match(self.text, attributes.end(), self.end)
        if element and self.text.startswith(m["tag"], element.end()):
            found.append(element.span(1))
        for lo, hi in found:
            self.pairs.append(Pair(names, [(lo, hi)], self.text[lo:hi], None, None, lo))

    def _read(self, at: int) -> None:
        text, end = self.text, self.end
        target, target_at, target_end = None, at, at
        path: list[tuple[int, str | None]] = []  # keys around a line: indentation, most sensitive name
        braces: list[str | None] = []
        head = BLANK.match(text, at, end).end()
        indent, held, holder = head - at, None, (None, -1)
        if section := SECTION.match(text, head, end):
            path, at = [(-1, section[1])], section.end()

        def around() -> str | None:
            return braces[-1] if braces else path[-1][1] if path else None

        def most(name: str) -> str:
            outer = around()
            return name if outer is None or self.sensitive(name) >= self.sensitive(outer) else outer

        while m := TOKEN.search(text, at, end):
            at = m.end()
            if m["name"]:
                target, at = self._name(m)
                target_at, target_end = m.start("name"), at
            elif m["quote"]:
                string = self._string(m)
                target = None
                if string:
                    lo, hi, at = string
                    target, target_at, target_end = self._inside(lo, hi), m.start(), at
            elif m["sign"]:
                name, target = target, None
                if name is None or m["sign"] not in ASSIGNS or text[target_end : m.start()].strip(" \t") or text.startswith("/", at, end):
                    continue
                holder = (name, at)
                names = [name]
                typed = ANNOTATION.match(text, at, end) if m["sign"] == ":" else None
                if typed:
                    names.append(typed[1])
                    at = typed.end()
                value = self._value(at)
                if value:
                    spans, literal, refers, at = value
                    self.pairs.append(Pair(names, spans, literal, refers, around(), m.end()))
                elif m["sign"] == ":" and target_at == head and LINE_END.match(text, at, end):
                    held = (indent, most(name))
            elif m["brace"] == "{":
                name, behind = holder
                opens = name is not None and not text[behind : m.start()].strip(" \t")
                braces.append(most(name) if opens else around())
                holder = (None, -1)
            elif m["brace"]:
                if braces:
                    braces.pop()
            elif m["tag"]:
                self._tag(m)
            else:
                target = None
                if text.startswith(("\n", "\r", "#"), at, end):
                    continue
                indent, head = len(m["line"]), at
                if held:
                    path.append(held)
                    held = None
                while path and path[-1][0] >= indent:
                    path.pop()
                if section := SECTION.match(text, at, end):
                    path, at = [(-1, section[1])], section.end()


def pairs(text: str, sensitive: Callable[[str], float]) -> list[Pair]:
    """All assignments, in the order of their places; ``sensitive`` weighs the names around nested ones."""
    found, todo = [], [(0, len(text))]
    while todo:
        region = _Region(text, *todo.pop(), sensitive)
        found += region.pairs
        todo += region.inner
    return sorted(found, key=lambda p: p.at)


def definitions(found: list[Pair]) -> list[int | None]:
    """For each assignment, the one whose literal it stands for in the end; None if it has one of its own."""
    places: dict[str, list[int]] = defaultdict(list)
    for k, pair in enumerate(found):
        for name in pair.names:
            places[name].append(k)
    to: list[int | None] = []
    for k, pair in enumerate(found):
        at = places.get(pair.refers, []) if pair.refers else []
        before = bisect_left(at, k)
        others = at[before - 1 : before] or [x for x in at[before : before + 2] if x != k]
        to.append(others[0] if others else None)
    ends: dict[int, int] = {}
    for k in range(len(found)):
        chain, x = {}, k
        while x not in ends and x not in chain and to[x] is not None:
            chain[x] = True
            x = to[x]
        end = ends.get(x, x)
        ends.update(dict.fromkeys(chain, end))
    return [None if ends.get(k, k) == k else ends[k] for k in range(len(found))]
