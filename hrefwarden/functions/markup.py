"""Links of Markdown, TeX and simple HTML as array columns, in the JVM.

Every function maps a text column to ``array<struct<url, linktext>>`` in the
order in which the links are reported. A byte search guards each regular
expression, so documents without link syntax cost one pass over their bytes.

A backtracking engine searches on to the end of the text, or of the line, from
every opening that is never completed. So what could only fail is found first, by
splitting the text once at the delimiter that would complete it, and is cut off
or marked. Behind that, every opening that is tried is a link, and the time is
linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hrefwarden.functions import fixed

LINK_ARRAY = "array<struct<url:string,linktext:string>>"


def unix_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _no_links() -> Column:
    return F.array().cast(LINK_ARRAY)


def _pairs(text: Column, pattern: str, url_group: int, text_group: int) -> Column:
    """One scan of the text for whole matches; the groups are cut out of the short matches."""
    return _groups(F.regexp_extract_all(text, F.lit(pattern), 0), pattern, url_group, text_group)


def _groups(matches: Column, pattern: str, url_group: int, text_group: int) -> Column:
    return F.transform(
        matches,
        lambda match: F.struct(
            F.regexp_extract(match, pattern, url_group).alias("url"),
            F.regexp_extract(match, pattern, text_group).alias("linktext"),
        ),
    )


def _singles(text: Column, pattern: str) -> Column:
    """Links whose URL is their text."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 1), lambda url: F.struct(url.alias("url"), url.alias("linktext"))
    )


def _without_tail(text: Column, tail: Column) -> Column:
    return F.left(text, F.length(text) - F.length(tail))


def md_inline(text: Column) -> Column:
    # Behind the last blank or ')' a link may open but never ends; before it each that opens does.
    tail = F.regexp_extract(F.reverse(text), fixed.MD_NO_END, 0)
    return F.when(F.contains(text, F.lit("](")), _pairs(_without_tail(text, tail), fixed.MD_INLINE, 2, 1)).otherwise(_no_links())


def md_pointy(text: Column) -> Column:
    # A match ends in '>'. Behind the last one there is none, and the engine
    # would search to the end of the text again for every '<' it meets there.
    searched = _without_tail(text, F.substring_index(text, ">", -1))
    return F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), _singles(searched, fixed.MD_POINTY)).otherwise(
        _no_links()
    )


# A mark is put into openings that lead nowhere; one that is in the text is told apart by what follows it.
_MARK, _OWN = "\x011", "\x010"


def _marked(text: Column) -> Column:
    r"""A TeX text that ends in ``}``, with a mark in all that opens no complete ``\href``.

    A URL ends at the next ``}``, and only a ``}`` that ``{`` follows may end one. So each
    stretch between two ``}`` opens links everywhere or nowhere. An optional argument
    reaches to the last ``]{`` of its line that opens one; behind that there is none.
    """
    own = F.replace(text, F.lit("\x01"), F.lit(_OWN))
    stretches = F.split(own, "\\}", -1)
    both = F.arrays_zip(stretches.alias("this"), F.slice(stretches, F.lit(2), F.size(stretches)).alias("next"))
    opens = F.transform(
        both,
        lambda s: F.when(s["next"].startswith("{") | ~F.contains(s["this"], F.lit("{")), s["this"]).otherwise(
            F.regexp_replace(s["this"], r"(?i)(\]|\\href)\{", f"$1{_MARK}{{")
        ),
    )

    def arguments(line: Column) -> Column:
        tail = F.substring_index(line, "]{", -1)
        marked = F.regexp_replace(tail, r"(?i)(\\href)\[", f"$1{_MARK}[")
        return F.when(F.contains(line, F.lit("[")), F.concat(_without_tail(line, tail), marked)).otherwise(line)

    return F.array_join(F.transform(F.split(F.array_join(opens, "}"), "\n", -1), arguments), "\n")


def _unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK), F.lit("")), F.lit(_OWN), F.lit("\x01"))


def tex_href(text: Column) -> Column:
    searched = _marked(_without_tail(text, F.substring_index(text, "}", -1)))
    links = F.transform(
        _pairs(searched, fixed.TEX_HREF, 1, 2),
        lambda link: F.struct(_unmarked(link["url"]).alias("url"), _unmarked(link["linktext"]).alias("linktext")),
    )
    return F.when(F.contains(text, F.lit("}{")), links).otherwise(_no_links())


def tex_url(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), _singles(text, fixed.TEX_URL)).otherwise(_no_links())


def html_simple(text: Column) -> Column:
    """Quoted ``href`` anchors by pattern: no comments, scripts or entities.

    An explicit choice for machine-written HTML; the exact way is the parser.
    """
    # The last tag that can open an anchor ends before the last </a>; what lies between is text.
    closing = F.when(F.contains(text, F.lit("</A>")), F.translate(text, "A", "a")).otherwise(text)
    behind = F.substring_index(closing, "</a>", -1)
    before = F.left(text, F.length(text) - F.length(behind) - 4)
    between = F.substring_index(before, ">", -1)
    # A tag without a quoted href is passed over whole, and no <a within it is tried.
    found = F.regexp_extract_all(_without_tail(before, between), F.lit(fixed.HTML_SIMPLE_TAGS), 0)
    anchors = F.filter(found, lambda tag: tag.rlike(fixed.HTML_SIMPLE_HREF))
    whole = F.transform(
        anchors, lambda tag: F.when(tag.rlike(fixed.HTML_SIMPLE_ENDED), tag).otherwise(F.concat(tag, between, F.lit("</a>")))
    )
    links = _groups(whole, fixed.HTML_SIMPLE_A, 1, 2)
    return F.when(F.contains(text, F.lit("</a>")) | F.contains(text, F.lit("</A>")), links).otherwise(_no_links())


def markdown_links(text: Column) -> Column:
    """Inline links first, then the ``<url>`` form."""
    return F.concat(md_inline(text), md_pointy(text))


def tex_links(text: Column) -> Column:
    r"""``\href`` first, then ``\url``."""
    return F.concat(tex_href(text), tex_url(text))
