"""Large files in parts: the same links wherever the file is cut."""

import random
import re

import pytest

from hrefwarden.functions import fixed
from hrefwarden.functions.anchors import html_anchors
from hrefwarden.functions.bibtex import bibtex_entries
from hrefwarden.operators import extract
from hrefwarden.sources import files, parts

INLINE, POINTY = re.compile(r"\[([^\[]*)\]\(([^\)]*?)[\s\x1c-\x1f\)]+"), re.compile(r"<([^>]*?)>")
HREF, URL = re.compile(r"\\href(?:\[.*\])?\{([^}]*)\}\{([^}]*?)\}", re.I), re.compile(r"\\url\{([^{]*?)\}", re.I)


def bib(text):
    # places in problems count from the beginning of a part
    return [(key, fields.get("url") if key else re.sub(r"\d+", "", fields)) for key, fields in bibtex_entries(text)]


#: Suffix, what finds links of each kind, pieces of texts.
FORMATS = {
    ".md": ((INLINE.findall, POINTY.findall), ["[a](http://1)", "[b\nc](http://2 't')", "<http://3>", "[", "]", "](", "(", ")", "<", ">", " ", "\n", "text é", "[![i](http://4)](http://5)"]),
    ".tex": ((HREF.findall, URL.findall), ["\\href{http://1}{a}", "\\href[o]{http://2}{b\nc}", "\\url{http://3}", "{", "}", "]{", "\\href[", "\n", "\n", "text é", "{\\it x}"]),
    ".html": ((html_anchors,), ["<a href='1'>x</a>", "<p><a href=\"2\">y <b>z</b></a></p>", "<p>", "</p>", "<div>", "</div>", "<!-- <a href='3'> -->", "<script>'<a href=4>'</script>", "text &amp; é", "<a href=5>", "</a>", "<title>t</title>", "\n", "<br>", "<pre>", "</pre>", "<ul><li>", "<", ">"]),
    ".bib": ((bib,), ["@misc{k1, url = {http://1}}\n", "@string{m = {http://2}}\n", "@string(n = m # \"/n\")\n", "@misc{k2, url = m # {/x}}\n", "@misc{k3, url = n, note = {a {b} @c}}\n", "@comment{c}\n", "text @ é\n", "@misc{k4, url = }\n", "@misc{k5, url = {http://5\n", "@preamble{\"p\"}\n"]),
}


@pytest.mark.parametrize("suffix", list(FORMATS))
def test_same_links_wherever_it_is_cut(suffix, monkeypatch):
    monkeypatch.setattr(parts, "UNCUT_PARTS", 10**9)
    finders, pieces = FORMATS[suffix]
    rng = random.Random(suffix)
    cut = 0
    for _ in range(150):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 25)))
        for size in {1, 2, 3, rng.randint(1, len(text)), len(text) // 2 + 1}:
            # one character at a time, so that every offset is the end of a piece once
            made = list(parts.parts_of(iter(text), "x" + suffix, size))
            cut += len(made) > 1
            for found in finders:
                assert [link for part in made for link in found(part)] == found(text), (text, made)
    assert cut > 100


def test_every_offset_of_a_file(spark, tmp_path):
    texts = {suffix: "".join(pieces) for suffix, (_, pieces) in FORMATS.items()}
    texts[".bib"] = texts[".bib"].replace("@misc{k5, url = {http://5\n", "")
    for suffix, text in texts.items():
        (tmp_path / f"x{suffix}").write_text(text.replace("\n", "\r\n"), newline="")
    listing = files.list_files(spark, str(tmp_path))

    def found(**sizes):
        rows = extract.findings(files.read_files(listing, **sizes)).cache()
        order = sorted(extract.numbered(rows).collect(), key=lambda r: (r.path, r.pos))
        links = sorted((r.path, r.kind, r.value or "", r.text if r.value else re.sub(r"\d+", "", r.text)) for r in order)
        assert [(r.path, r.pos) for r in order] == [(p, k) for p in sorted({r.path for r in order}) for k in range(sum(r.path == p for r in order))]
        return links, rows.filter("part > 0").count()

    whole, none = found()
    assert len(whole) > 15 and none == 0
    longest = max(map(len, texts.values()))
    for size in (16, 17, 18, 19, 40, 90, longest):
        links, several = found(part_bytes=1, part_chars=size)
        assert links == whole and (several > 5 or size >= 90)


def test_what_cannot_be_cut_or_decoded_is_a_problem(tmp_path):
    (tmp_path / "a.md").write_text("[a](http://1)\n[b](http://2)\n<" + "x" * 1000)
    read = list(files.read_parts(str(tmp_path / "a.md"), 20))
    assert "without a place to cut" in read[-1][1] and "".join(content for content, _ in read[:-1]).startswith("[a](http://1)")
    (tmp_path / "b.md").write_bytes(b"[a](http://1)\n" * 9 + b"\xff")
    ((content, problem),) = files.read_parts(str(tmp_path / "b.md"), 20)
    assert content is None and "utf-8" in problem
    assert list(files.read_parts(str(tmp_path / "none.md"), 20)) == [(None, fixed.NOT_FOUND)]
