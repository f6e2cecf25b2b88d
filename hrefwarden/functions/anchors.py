"""Anchors of one HTML document; a helper that runs inside Arrow batches.

The text of an anchor is the text of everything inside the element. An element
ends with its own end tag or with that of an element around it, an anchor also
where the next one begins, and one left open runs to the end of the document. A
piece of text thus belongs to one anchor at most. Markup that the document ends
within is dropped, as browsers do; the time is linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

# --- fixed values: HTML elements without content, and elements whose text
# --- does not count as text of the elements around them
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
TEXTLESS = frozenset("rp rt script style template".split())
VERBATIM = frozenset("pre textarea".split())


# --- fixed values: what may stand in '<![', and how it ends
_SECTION = re.compile(r"<!\[\s*(temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.IGNORECASE)
_CONDITIONS = frozenset(("if", "else", "endif"))
_SECTION_ENDS = (re.compile(r"]\s*]\s*>"), re.compile(r"]\s*>"))
_TAG_END = re.compile(">")


class AnchorCollector(HTMLParser):
    """Collects [href, first text piece, end of text pieces] in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self._pieces: list[str] = []
        self._pending: list[str] = []
        self._stack: list[tuple[str, int]] = []
        self._open: Counter = Counter()
        self._ending = False

    def anchors(self) -> list[tuple[str | None, str]]:
        self.close()
        self._flush()
        total = len(self._pieces)
        return [
            (href, "".join(self._pieces[first : total if end is None else end]))
            for href, first, end in self.found
        ]

    def is_open(self, tag: str) -> bool:
        return self._open[tag] > 0

    def _flush(self):
        if not self._pending:
            return
        text = "".join(self._pending)
        self._pending.clear()
        if not self._open["a"] or any(self._open[name] for name in TEXTLESS):
            return
        if not text.strip(" \t\n\r\f\v") and not any(self._open[name] for name in VERBATIM):
            text = "\n" if "\n" in text else " "
        self._pieces.append(text)

    def _start(self, tag, attrs):
        self._flush()
        if tag == "a" and self._open["a"]:
            self.handle_endtag("a")
        anchor = -1
        if tag == "a":
            anchor = len(self.found)
            href = None
            for name, value in attrs:
                if name == "href":
                    href = value or ""
            self.found.append([href, len(self._pieces), None])
        return anchor

    def handle_starttag(self, tag, attrs):
        anchor = self._start(tag, attrs)
        if tag not in VOID:
            self._stack.append((tag, anchor))
            self._open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        anchor = self._start(tag, attrs)
        if anchor >= 0:
            self.found[anchor][2] = len(self._pieces)

    def handle_endtag(self, tag):
        self._flush()
        while self._open[tag]:
            name, anchor = self._stack.pop()
            self._open[name] -= 1
            if anchor >= 0:
                self.found[anchor][2] = len(self._pieces)
            if name == tag:
                return

    def close(self):
        self._ending = True
        super().close()

    def _dropped(self, end):
        """At the end of the document, nothing that is incomplete is tried again from its next '<'."""
        return len(self.rawdata) if end is not None and end < 0 and self._ending else end

    def parse_starttag(self, i):
        return self._dropped(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._dropped(super().parse_endtag(i))

    def parse_comment(self, i, report=1):
        return self._dropped(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self._dropped(super().parse_pi(i))

    def parse_html_declaration(self, i):
        return self._dropped(super().parse_html_declaration(i))

    def parse_marked_section(self, i, report=1):
        """CDATA and the like to their own ends, anything else in '<![' to the next '>'."""
        known = _SECTION.match(self.rawdata, i)
        close = _SECTION_ENDS[known.group(1).lower() in _CONDITIONS] if known else _TAG_END
        end = close.search(self.rawdata, i + 3)
        if not end:
            return self._dropped(-1)
        self.unknown_decl(self.rawdata[i + 3 : end.start()])
        return end.end()

    def updatepos(self, i, j):
        """Line numbers are not needed; counting them takes a tenth of the time."""
        return j

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[6:])
            self._flush()


# Regular markup: quoted attributes, closed comments, no '<' or '>' out of place.
_BLANK = r"[ \t\n\r\f]"
_TOKEN = re.compile(
    rf"""([^<]*+)(?:<([a-z][a-z0-9]*+)((?:{_BLANK}++[a-z_][-a-z0-9_:.]*+(?:="[^"<>]*+"|='[^'<>]*+')?+)*+){_BLANK}*+(/?)>"""
    rf"""|</([a-z][a-z0-9]*+){_BLANK}*+>|<!--(?!-?>)[^-]*+(?:-(?!-)[^-]*+)*+-->|<!doctype[^<>\[]*+>|\Z)""",
    re.IGNORECASE,
)
_HREF_ONLY = re.compile(r' href="([^"&]*)"')
# Elements whose content parsers read by rules of their own, and its regular form.
_RAW = {
    name: re.compile(rf"[^<]*+(?:<(?!/{name}|!--)[^<]*+)*+</{name}>", re.IGNORECASE) for name in ("script", "style")
} | {
    name: re.compile(rf"[^<]*+</{name}>", re.IGNORECASE)
    for name in ("iframe", "noembed", "noframes", "noscript", "textarea", "title", "xmp")
}


def _regular_anchors(text: str) -> list[tuple[str | None, str]] | None:
    """As the parser finds them, several times faster; None unless all markup is regular."""
    if "\0" in text:
        return None
    collector = AnchorCollector()
    at, size = 0, len(text)
    while at < size:
        token = _TOKEN.match(text, at)
        if not token:
            return None
        data, name, attributes, slash, end = token.groups()
        at = token.end()
        if data and collector.is_open("a"):
            collector.handle_data(unescape(data))
        if end:
            collector.handle_endtag(end.lower())
        elif not name:
            collector.handle_comment("")
        else:
            name = name.lower()
            attrs = ()
            if name == "a":
                href = _HREF_ONLY.fullmatch(attributes)
                attrs = (("href", href.group(1)),) if href else _attributes(token.group()[len(data) :])
            if name == "plaintext" or (slash and name in _RAW):
                return None
            if slash:
                collector.handle_startendtag(name, attrs)
                continue
            collector.handle_starttag(name, attrs)
            if name in _RAW:
                content = _RAW[name].match(text, at)
                if not content or (collector.is_open("a") and "&" in content.group()):
                    return None
                if len(content.group()) > len(f"</{name}>"):
                    collector.handle_data(content.group()[: -len(f"</{name}>")])
                collector.handle_endtag(name)
                at = content.end()
    return collector.anchors()


class _FirstTag(HTMLParser):
    attrs: list = []

    def handle_starttag(self, tag, attrs):
        self.attrs = attrs


def _attributes(tag: str) -> list[tuple[str, str | None]]:
    parser = _FirstTag()
    parser.feed(tag)
    return parser.attrs


def parsed_anchors(text: str) -> list[tuple[str | None, str]]:
    collector = AnchorCollector()
    collector.feed(text)
    return collector.anchors()


def html_anchors(text: str) -> list[tuple[str | None, str]]:
    """(href, text) of every anchor; href is None where the attribute is absent."""
    found = _regular_anchors(text)
    return parsed_anchors(text) if found is None else found
