"""Large texts in parts, cut where no link is open; a helper that runs inside tasks.

A file may be larger than a text can be. It is read as a stream and given out in parts
that are read on their own: nothing that makes a link reaches over a cut, and what a part
has to know of those before it, open elements and macros, is written in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from hrefwarden.functions import fixed
from hrefwarden.functions.anchors import AnchorCollector
from hrefwarden.functions.bibtex import BadBibtex, _Scanner

#: Characters of a part, about, and of a stretch without a place to cut from which a file is given up.
PART_CHARS, UNCUT_PARTS = 64 << 20, 8


_MACRO = re.compile(r"@\s*string\s*[{(]", re.IGNORECASE)


class Uncut(ValueError):
    pass


class _Cutter:
    """Takes a text piece by piece and keeps what is behind the last place to cut."""

    def __init__(self):
        self.held = ""

    def take(self, piece: str) -> None:
        self.held += piece

    def place(self) -> int:
        """The last place of the held text before which everything is complete; 0 if there is none."""
        raise NotImplementedError

    def context(self) -> str:
        """What is to stand in front of the text behind the place found last."""
        return ""


class _Markdown(_Cutter):
    """Before a '[' behind a blank or ')': there neither a text nor a URL goes on. And not within '<' and '>'.

    A text in which no '[' has stood yet may be cut at any line.
    """

    _TOKEN = re.compile(r"[<>\n]|\[")
    _END = re.compile(r"[\s\x1c-\x1f)]")

    def place(self) -> int:
        found, pointed, bracket = 0, False, False
        for match in self._TOKEN.finditer(self.held):
            token, at = match.group(), match.start()
            if token in "<>":
                pointed = token == "<"
            elif token == "[":
                bracket = True
                if at and not pointed and self._END.match(self.held, at - 1):
                    found = at
            elif not pointed and not bracket:
                found = at + 1
        return found


class _Tex(_Cutter):
    """Behind a line end with no '{' since the last '}'."""

    _TOKEN = re.compile(r"[{}\n]")

    def place(self) -> int:
        found, braced = 0, False
        for match in self._TOKEN.finditer(self.held):
            token = match.group()
            if token != "\n":
                braced = token == "{"
            elif not braced:
                found = match.end()
        return found


class _Html(_Cutter):
    """Where the parser has come to, outside anchors and elements with rules of their own; open elements go in front."""

    def __init__(self):
        super().__init__()
        self.parser = AnchorCollector()
        self.fed = 0

    def place(self) -> int:
        self.parser.feed(self.held[self.fed :])
        self.fed = len(self.held)
        if self.parser.is_open("a") or self.parser.cdata_elem is not None:
            return 0
        found = self.fed - len(self.parser.rawdata)
        self.fed -= found
        self.parser.found.clear()
        return found

    def context(self) -> str:
        return "".join(f"<{name}>" for name, _ in self.parser._stack)


class _Bibtex(_Cutter):
    """Behind a command that is complete; the commands that define macros go in front."""

    def __init__(self):
        super().__init__()
        self.macros: list[str] = []

    def place(self) -> int:
        known = self.context()
        text = known + self.held
        scanner, found, made = _Scanner(text), len(known), []
        while (at := text.find("@", scanner.at)) >= 0:
            scanner.at = at + 1
            is_macro = _MACRO.match(text, at) is not None
            try:
                scanner.command()
            except BadBibtex:  # it may be complete with what follows
                break
            if scanner.at >= len(text):
                break
            if at >= len(known):
                found = scanner.at
                if is_macro:
                    made.append(text[at : scanner.at] + "\n")
        self.macros += made
        return found - len(known)

    def context(self) -> str:
        return "".join(self.macros)


_CUTTERS = (
    (fixed.HTML_SUFFIXES, _Html),
    (fixed.MARKDOWN_SUFFIXES, _Markdown),
    (fixed.TEX_SUFFIXES, _Tex),
    (fixed.BIBTEX_SUFFIXES, _Bibtex),
)


def parts_of(pieces: Iterator[str], path: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """The text of ``pieces`` in parts of about so many characters; ``Uncut`` where there is no place to cut.

    A format without a cutter is not read by any extractor and is cut anywhere.
    """
    made = next((cutter for suffixes, cutter in _CUTTERS if path.endswith(suffixes)), None)
    cutter = made() if made else None
    context, due = "", part_chars
    for piece in pieces:
        if cutter is None:
            yield piece
            continue
        cutter.take(piece)
        if len(cutter.held) < due:
            continue
        at = cutter.place()
        if at:
            yield context + cutter.held[:at]
            cutter.held, context, due = cutter.held[at:], cutter.context(), part_chars
        elif len(cutter.held) >= UNCUT_PARTS * part_chars:
            raise Uncut(f"{len(cutter.held)} characters without a place to cut")
        else:  # twice as much before the next try, so that tries add up to the length
            due = 2 * len(cutter.held)
    if cutter is not None and cutter.held:
        yield context + cutter.held
