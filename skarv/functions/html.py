"""What captured HTML tells, read by the standard library in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = frozenset("script style noscript template".split())
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.footer, self.text = [], [], [], []
        self.links: list[tuple[str, list[str]]] = []
        self.metas: dict[str, str] = {}
        self.times: list[str] = []
        self.data: list[str] = []
        self.open: dict[str, int] = {}
        self.script = False

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and given.get("href"):
            self.links.append((given["href"], []))
        elif tag == "meta" and (given.get("name") or given.get("property")):
            self.metas.setdefault((given.get("name") or given["property"]).lower(), given.get("content", ""))
        elif tag == "time" and given.get("datetime"):
            self.times.append(given["datetime"])
        if tag == "script" and given.get("type", "").lower() == "application/ld+json":
            self.script = True
            self.data.append("")
        if tag in _BLOCK:
            self.text.append("\n")
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self.open[tag] -= 1
        if tag == "script":
            self.script = False
        if tag in _BLOCK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.script:
            self.data[-1] += data
        elif not any(self.open.get(t) for t in _HIDDEN):
            if self.open.get("title"):
                self.title.append(data)
                return
            self.text.append(data)
            if self.open.get("h1"):
                self.heading.append(data)
            if self.open.get("footer"):
                self.footer.append(data)
            if self.open.get("a") and self.links:
                self.links[-1][1].append(data)


def _clean(parts: list[str]) -> str | None:
    return " ".join("".join(parts).split()) or None


def _parse(html: str | None) -> _Page:
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    return page


_SIGNALS = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("footer", T.StringType()),
        T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("hidden_emails", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
    ]
)


@F.pandas_udf(_SIGNALS)
def page_signals(html: pd.Series) -> pd.DataFrame:
    """Title, description, first heading, footer, addresses of mailto links, hidden addresses, times and text."""
    rows = []
    for source in html:
        page = _parse(source)
        mails = sorted({h[7:].split("?")[0].strip().lower() for h, _ in page.links if h.lower().startswith("mailto:") and "@" in h})
        hidden = sorted(set(re.findall(r'data-cfemail="([0-9a-fA-F]+)"', source or "")))
        lines = (" ".join(line.split()) for line in "".join(page.text).split("\n"))
        rows.append((_clean(page.title), page.metas.get("description") or page.metas.get("og:description"), _clean(page.heading), _clean(page.footer), mails, hidden, page.times, "\n".join(x for x in lines if x) or None))
    return pd.DataFrame(rows, columns=[f.name for f in _SIGNALS.fields])


_LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())]))


@F.pandas_udf(_LINKS)
def page_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """The ``http(s)`` links of a page, absolute, without fragment, in the order of the page, each once."""
    out = []
    for source, where in zip(html, base):
        seen: dict[str, str | None] = {}
        for href, label in _parse(source).links:
            try:
                url = urljoin(where or "", href.strip()).split("#")[0]
                good = urlsplit(url).scheme in ("http", "https")
            except ValueError:
                continue
            if good:
                seen.setdefault(url, _clean(label))
        out.append(list(seen.items()))
    return pd.Series(out)


def linked_data_nodes(text: str) -> list[dict]:
    """All objects of a JSON-LD document, those inside others and in ``@graph`` too; none if it isn't JSON."""
    try:
        todo, out = [json.loads(text)], []
    except (ValueError, RecursionError):
        return []
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            out.append(node)
            todo = [v for v in node.values() if isinstance(v, (dict, list))] + todo
    return out


_NODES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("url", T.StringType()), T.StructField("same_as", T.ArrayType(T.StringType())), T.StructField("published", T.StringType())]))


def _strings(value) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]


@F.pandas_udf(_NODES)
def linked_data(html: pd.Series) -> pd.Series:
    """The typed nodes of a page's JSON-LD: type, name, url, profiles and date."""
    out = []
    for source in html:
        rows = []
        for block in _parse(source).data:
            for node in linked_data_nodes(block):
                for kind in _strings(node.get("@type")):
                    rows.append((kind, *(next(iter(_strings(node.get(k))), None) for k in ("name", "url")), _strings(node.get("sameAs")), next(iter(_strings(node.get("datePublished"))), None)))
        out.append(rows)
    return pd.Series(out)


_ITEMS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("published", T.StringType())]))


def _feed(xml: str | None) -> list[tuple]:
    from xml.etree import ElementTree

    if not xml or re.search("<!(?:DOCTYPE|ENTITY)", xml, re.IGNORECASE):
        return []
    try:
        root = ElementTree.fromstring(xml.encode() if xml.lstrip().startswith("<?xml") else xml)
    except (ElementTree.ParseError, ValueError):
        return []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    rows = []
    for item in (e for e in root.iter() if local(e) in ("item", "entry")):
        got: dict[str, str] = {}
        for child in item:
            name = {"pubDate": "published", "updated": "published", "date": "published"}.get(local(child), local(child))
            text = child.get("href") if name == "link" and child.get("href") else (child.text or "").strip()
            if text:
                got.setdefault(name, text)
        rows.append((got.get("title"), got.get("link"), got.get("published")))
    return rows


@F.pandas_udf(_ITEMS)
def feed_items(xml: pd.Series) -> pd.Series:
    """The items of an RSS or Atom feed in its order; none where it isn't a feed."""
    return pd.Series([_feed(x) for x in xml])


# What is exploded or filtered behind them is computed once.
page_signals, page_links, linked_data, feed_items = (f.asNondeterministic() for f in (page_signals, page_links, linked_data, feed_items))
