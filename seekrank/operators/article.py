"""I8 article mode: pick the main content block of each page.

Runs per Arrow batch through ``mapInPandas`` with the standard library's
``html.parser`` (no DOM library). The main block is the first ``<article>``,
else the first ``<main>``, else the ``<div>``/``<section>`` holding the most
paragraph text. Text inside script, style, nav, aside, footer, form, noscript
and comments is dropped.

Result per page (as in the original worker): with a main block, title = its
first ``<h1>`` (else ``<title>``, else the url), text = the block's text (else
its html, else ''), html = the block's inner html; without one, title =
``<title>`` or url, text = body text, html = body inner html. Nothing is cut
here; cutting is I9's.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SKIP = {"script", "style", "nav", "aside", "footer", "form", "noscript", "template"}
BLOCKS = {"article", "main", "div", "section", "body"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_WS = re.compile(r"\s+")


class _Blocks(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0]
        for m in re.finditer("\n", html):
            self.line_starts.append(m.end())
        self.stack: list[tuple[str, int | None]] = []
        self.blocks: list[dict] = []
        self.skip = 0
        self.in_title = False
        self.in_p = 0
        self.title = []
        self.h1: dict[int, str] = {}
        self._h1_open: list[tuple[int, list]] = []

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        block = None
        if tag in BLOCKS:
            start = self._offset() + len(self.get_starttag_text() or "")
            block = len(self.blocks)
            self.blocks.append({"tag": tag, "start": start, "end": None, "text": [], "ptext": 0})
        self.stack.append((tag, block))
        if tag in SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "p":
            self.in_p += 1
        elif tag == "h1":
            self._h1_open.append((len(self.stack), []))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        # close up to the matching open tag (tolerates unclosed children)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                break
        else:
            return
        end = self._offset()
        while len(self.stack) > i:
            t, b = self.stack.pop()
            if b is not None and self.blocks[b]["end"] is None:
                self.blocks[b]["end"] = end
            if t in SKIP:
                self.skip -= 1
            elif t == "title":
                self.in_title = False
            elif t == "p":
                self.in_p -= 1
            elif t == "h1" and self._h1_open:
                depth, parts = self._h1_open.pop()
                text = _WS.sub(" ", "".join(parts)).strip()
                for _, blk in self.stack:
                    if blk is not None and blk not in self.h1 and text:
                        self.h1[blk] = text

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
            return
        if self.skip:
            return
        for _, parts in self._h1_open:
            parts.append(data)
        for _, b in self.stack:
            if b is not None:
                self.blocks[b]["text"].append(data)
                if self.in_p:
                    self.blocks[b]["ptext"] += len(data.strip())


def _clean(parts) -> str:
    return _WS.sub(" ", "".join(parts)).strip()


def extract_article(html: str | None, url: str) -> tuple[str, str, str]:
    if html is None:
        return None, None, None
    p = _Blocks(html)
    try:
        p.feed(html)
        p.close()
    except Exception:  # malformed markup: fall back to what was parsed
        pass
    for b in p.blocks:
        if b["end"] is None:
            b["end"] = len(html)
    page_title = _clean(p.title)
    chosen = next((i for i, b in enumerate(p.blocks) if b["tag"] == "article"), None)
    if chosen is None:
        chosen = next((i for i, b in enumerate(p.blocks) if b["tag"] == "main"), None)
    if chosen is None:
        dense = [(b["ptext"], -i) for i, b in enumerate(p.blocks) if b["tag"] in ("div", "section") and b["ptext"] > 0]
        chosen = -max(dense)[1] if dense else None
    if chosen is not None:
        b = p.blocks[chosen]
        inner = html[b["start"]:b["end"]]
        text = _clean(b["text"])
        title = p.h1.get(chosen) or page_title or url
        return title, text or inner or "", inner or ""
    body = next((b for b in p.blocks if b["tag"] == "body"), None)
    text = _clean(body["text"]) if body else ""
    inner = html[body["start"]:body["end"]] if body else ""
    return page_title or url, text, inner


SCHEMA_EXTRA = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]


def extract_articles(df: DataFrame) -> DataFrame:
    """``df`` with ``url, html`` → adds/replaces ``title``, ``text``, ``html``."""
    keep = [f for f in df.schema.fields if f.name not in ("title", "text", "html")]
    schema = T.StructType(keep + [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
                                  T.StructField("html", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            out = [extract_article(h, u) for h, u in zip(pdf["html"], pdf["url"])]
            pdf = pdf.assign(title=[o[0] for o in out], text=[o[1] for o in out], html=[o[2] for o in out])
            yield pd.DataFrame(pdf, columns=names)

    return df.mapInPandas(run, schema)
