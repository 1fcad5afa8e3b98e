"""HTML to text: the tag stage runs in Arrow batches, the clean-up in the JVM."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions.text import normalize_text

# Tags by their effect on the text.
PARAGRAPHS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote article section header footer main nav aside form figure table".split())
LINES = frozenset("br li tr dt dd hr caption option".split())
SILENT = frozenset("head style script template noscript".split())


class _TextOnly(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []
        self.silent = 0
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if self.silent:
            if tag == "body":
                self.silent = 0
            return
        if tag in PARAGRAPHS:
            self.out.append("\n\n")
        elif tag in LINES:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        if tag == "li":
            self.out.append("* ")
        elif tag == "hr":
            self.out.append("* * *\n")
        elif tag == "pre":
            self.raw += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("#" * int(tag[1]) + " ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag in PARAGRAPHS:
            self.out.append("\n\n")
            if tag == "pre":
                self.raw = max(0, self.raw - 1)

    def handle_data(self, data):
        if self.silent:
            return
        if self.raw:
            self.out.append(data)
            return
        text = " ".join(data.split())
        if not text:
            self.out.append(" ")
            return
        lead = " " if data[0].isspace() else ""
        tail = " " if data[-1].isspace() else ""
        self.out.append(lead + text + tail)


def strip_tags(html: str) -> str:
    """The readable text of one page, before the clean-up steps."""
    parser = _TextOnly()
    parser.feed(html)
    parser.close()
    lines = "".join(parser.out).split("\n")
    return "\n".join(line.strip(" ") for line in lines)


@F.pandas_udf(T.StringType())
def _strip_tags(pages: pd.Series) -> pd.Series:
    def one(page):
        try:
            return None if page is None else strip_tags(page)
        except Exception:
            return None

    return pages.map(one)


def html_to_text(html: Column) -> Column:
    """Readable text, NULL when the page cannot be read."""
    return normalize_text(_strip_tags(html))
