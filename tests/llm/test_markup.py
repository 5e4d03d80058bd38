"""Scanning of markup: the same elements as by one expression that tries every place anew, and time in proportion to the page."""

import random
import re
import time

import pytest

from auditlake.llm import html_text

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)


def by_expression(page):
    out, at = [], 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = m[2] or m[5] or ""
        section = m[0][9:].removesuffix("]]>") if m[0].startswith("<![CDATA[") else ""
        out.append((m.start(), at, name.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "") if name else "", section))
    return out


def test_the_same_elements():
    rng = random.Random(1)
    pieces = ["<", ">", "<a", "</p", "<p ", '"', "'", "=", "x", " ", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "/", "-", "é", "<b>", "href"]
    for _ in range(20_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        markup, got, at = html_text._Markup(page), [], 0
        while m := markup.find(at):
            got.append(m)
            at = m[1]
        assert got == by_expression(page), page
        assert len(markup.failed) <= 3


@pytest.mark.parametrize("piece", ['<a href="x', "<p title='", "<a href=\"x' ", "<a", "<!x ", "</script", "<!-- ", "<![CDATA[", "<a x='\">", '<a b=">\' ', "<", "&#", "<script>", "<div>"])
def test_a_megabyte_of_it_takes_seconds(piece):
    for page in (piece * (1_000_000 // len(piece)), piece * (1_000_000 // len(piece)) + ">", "<script>" + piece * (1_000_000 // len(piece))):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 5
