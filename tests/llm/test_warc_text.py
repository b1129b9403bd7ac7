"""Text, titles and links of derived records against a walk over the tags by the standard library's parser."""

import json
import random
from html.parser import HTMLParser

import pytest

from cladeflow.llm import warc
from cladeflow.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
BLOCKS = set("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table nav article section header footer title blockquote pre hr body head".split())
HIDDEN = {"script", "style", "noscript", "template"}


class Walk(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.hidden, self.in_title = [], [], None, 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
            self.parts.append(" ")
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "a" and not self.hidden:
            self.links += [v for k, v in attrs if k == "href"][:1]
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden -= 1
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_comment(self, data):
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.in_title:
                self.title += data

    @property
    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def expected(page):
    walk = Walk(page)
    return walk.text, walk.links, None if walk.title is None else " ".join(walk.title.split())


def got(rows):
    block = {r["record_type"]: r["block"] for r in rows}
    about = json.loads(block["metadata"])
    return block["conversion"], about["links"], about["title"]


def test_pages_of_the_table(spark):
    """Every page of the table."""
    responses = warc.responses_of(table(spark, SF_DIR, "pages"))
    pages = {r.record_id: r.payload for r in responses.collect()}
    records = {}
    for r in warc.derivatives(responses).collect():
        records.setdefault(r.refers_to, []).append(r.asDict())
    assert records.keys() == pages.keys() and len(pages) > 10
    for key, rows in records.items():
        assert got(rows) == expected(pages[key]), pages[key]


@pytest.mark.parametrize("seed", range(4))
def test_random_pages(seed):
    """Nested blocks and inline tags, attributes in any order and quoting, entities, comments, scripts and styles."""
    pick = random.Random(seed)
    words = ["one", "two &amp; three", "caf&eacute;", "&lt;b&gt;", "a&#8212;b", "日本", "x > y", "  spaced   out ", "line\nbreak"]

    def link():
        quote, target = pick.choice(["'", '"', ""]), f"/p{pick.randrange(99)}/x"
        return f"<a class='c' {pick.choice(['href', 'HREF'])}={quote}{target}{quote}>{pick.choice(words)}</a>"

    def part(depth):
        kind = pick.randrange(8)
        if kind < 3 or not depth:
            return pick.choice(words)
        if kind == 3:
            return link()
        if kind == 4:
            return pick.choice(["<!-- no <p> here -->", "<script type='t'>if (1) { no() }</script>", "<style>p { no: yes }</style>", "<br>", "<hr class=x>"])
        tag = pick.choice(["p", "div", "b", "span", "li", "H2", "em", "section"])
        inner = "".join(part(depth - 1) for _ in range(pick.randrange(1, 5)))
        return f"<{tag} id='i{kind}'>{inner}</{tag}>"

    for _ in range(200):
        page = f"<!DOCTYPE html><html lang='en'><head><title>T {pick.choice(words)}</title></head><body>{''.join(part(4) for _ in range(6))}</body></html>"
        assert got(warc.derive("<id>", "http://h/", warc.DATE, page)) == expected(page), page
