"""Entries of one BibTeX document; a helper that runs inside Arrow batches.

Knows nested braces, quoted values, ``#`` concatenation, ``@string`` macros,
``@comment`` and ``@preamble``. What it cannot read becomes a problem text and
the scan goes on with the next line that starts with ``@``.

A value is kept as its parts and its length, and a macro's parts are shared by all
that name it. Only fields that are asked for are joined, and only if their length,
known before, is within bounds: macros that double each other cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

#: Characters of a joined value, if the document is not longer itself, and of all of a
#: document's that name macros, in multiples of that.
VALUE_CHARS, DOCUMENT_VALUES = 1 << 20, 16
_ENDLESS = 1 << 62

_NAME = re.compile(r"[^\s{}()\"#%',=@]+")
_KEY = re.compile(r"[^\s,{}]+")
_SPACE = re.compile(r"\s*")
_BRACE = re.compile(r"[{}]")
_QUOTED_STOP = re.compile(r'[{}"]')
_BLANKS = re.compile(r"\s+")
_ENTRY_LINE = re.compile(r"^[ \t]*@", re.MULTILINE)

# --- fixed values: month macros every BibTeX style defines
MONTHS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April",
    "may": "May", "jun": "June", "jul": "July", "aug": "August",
    "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}


class BadBibtex(ValueError):
    pass


class _Value:
    """Text in parts, none of them empty; a part is a text or a value of several parts."""

    __slots__ = ("parts", "length", "named")

    def __init__(self, parts: list[str | _Value], named: bool = False):
        self.parts = [part for part in parts if _length(part)]
        self.length = min(_ENDLESS, sum(map(_length, self.parts)))
        self.named = named

    def shared(self) -> str | _Value:
        """The value as a part of others; one of a single part is that part."""
        return self.parts[0] if len(self.parts) == 1 else self

    def joined(self) -> str:
        done, waiting = [], [self]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                done.append(part)
            else:
                waiting.extend(reversed(part.parts))
        return "".join(done)


def _length(part: str | _Value) -> int:
    return len(part) if isinstance(part, str) else part.length


class _Scanner:
    def __init__(self, text: str):
        self.text = text
        self.longest = max(len(text), VALUE_CHARS)
        self.left = DOCUMENT_VALUES * self.longest
        self.at = 0
        self._partners: dict[int, int] | None = None
        self.macros: dict[str, str | _Value] = dict(MONTHS)

    def blanks(self):
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        self.blanks()
        return self.text[self.at : self.at + 1]

    def take(self, pattern: re.Pattern, what: str) -> str:
        self.blanks()
        match = pattern.match(self.text, self.at)
        if not match:
            raise BadBibtex(f"{what} expected at character {self.at}")
        self.at = match.end()
        return match.group()

    def expect(self, char: str):
        if self.peek() != char:
            raise BadBibtex(f"'{char}' expected at character {self.at}")
        self.at += 1

    def braced(self) -> str:
        """Text up to the brace that closes the one at the current place."""
        end = self.partners().get(self.at)
        if end is None:
            raise BadBibtex(f"brace opened at character {self.at} is never closed")
        start, self.at = self.at + 1, end + 1
        return self.text[start:end]

    def partners(self) -> dict[int, int]:
        """Where each brace that is closed is closed; all braces are matched once."""
        if self._partners is None:
            self._partners, waiting = {}, []
            for match in _BRACE.finditer(self.text):
                if match.group() == "{":
                    waiting.append(match.start())
                elif waiting:
                    self._partners[waiting.pop()] = match.start()
        return self._partners

    def quoted(self) -> str:
        """Text up to the next quote outside braces; braces are stepped over as a whole."""
        start = at = self.at + 1
        while stop := _QUOTED_STOP.search(self.text, at):
            if stop.group() == '"':
                self.at = stop.end()
                return self.text[start : stop.start()]
            end = self.partners().get(stop.start()) if stop.group() == "{" else None
            if end is None:
                break
            at = end + 1
        raise BadBibtex(f"quote opened at character {self.at} is never closed")

    def value(self) -> _Value:
        parts: list[str | _Value] = []
        named = False
        while True:
            char = self.peek()
            if char == "{":
                parts.append(self.braced())
            elif char == '"':
                parts.append(self.quoted())
            else:
                name = self.take(_NAME, "value")
                if not name.isdigit() and name.lower() not in self.macros:
                    raise BadBibtex(f"undefined macro '{name}'")
                parts.append(name if name.isdigit() else self.macros[name.lower()])
                named = True
            if self.peek() != "#":
                return _Value(parts, named)
            self.at += 1

    def text_of(self, value: _Value) -> str:
        """The joined value; what macros make longer is counted before it is made."""
        if value.length > self.longest:
            raise BadBibtex(f"value of more than {self.longest} characters")
        if value.named:
            if value.length > self.left:
                raise BadBibtex("macros make the values of this document too long")
            self.left -= value.length
        return value.joined()

    def fields(self, closing: str) -> dict[str, _Value]:
        found: dict[str, _Value] = {}
        while self.peek() == ",":
            self.at += 1
            if self.peek() in (closing, ","):
                continue
            name = self.take(_NAME, "field name").lower()
            self.expect("=")
            found.setdefault(name, self.value())
        self.expect(closing)
        return found

    def command(self) -> tuple[str, dict[str, _Value]] | None:
        kind = self.take(_NAME, "entry type").lower()
        if kind == "comment":
            return None
        opening = self.peek()
        if opening not in ("{", "("):
            raise BadBibtex(f"'{{' expected at character {self.at}")
        closing = "}" if opening == "{" else ")"
        self.at += 1
        if kind == "preamble":
            self.value()
            self.expect(closing)
            return None
        if kind == "string":
            name = self.take(_NAME, "macro name").lower()
            self.expect("=")
            self.macros[name] = self.value().shared()
            self.expect(closing)
            return None
        key = self.take(_KEY, "entry key")
        return key, self.fields(closing)


def one_line(value: str) -> str:
    """A field value with every run of blanks made one space."""
    return _BLANKS.sub(" ", value)


def bibtex_entries(text: str, wanted: Collection[str] | None = None) -> Iterator[tuple[str | None, dict[str, str] | str]]:
    """(key, fields) per entry, or (None, problem) for a stretch that cannot be read.

    Of the fields all are told, or those that are ``wanted``; one that macros make too long
    is a problem of its own, before its entry.
    """
    scanner = _Scanner(text)
    while (at := text.find("@", scanner.at)) >= 0:
        scanner.at = at + 1
        try:
            entry = scanner.command()
        except BadBibtex as problem:
            yield None, str(problem)
            resume = _ENTRY_LINE.search(text, at + 1)
            if not resume:
                return
            scanner.at = resume.end() - 1
            continue
        if entry:
            key, values = entry
            fields = {}
            for name, value in values.items():
                if wanted is None or name in wanted:
                    try:
                        fields[name] = scanner.text_of(value)
                    except BadBibtex as problem:
                        yield None, f"{problem}, field '{name}' of '{key}'"
            yield key, fields
