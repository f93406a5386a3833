"""The main body of web pages, without the boilerplate around it.

A site style tree merges the DOMs of one host, element by element at every
depth: each node of the tree stands for the elements of all pages that are
reached by the same presentations from ``body`` down, and keeps the
presentations (sequences of children) that these elements have. Entropy tells
how important the presentation and the content of a node are (a line that
every page repeats tells nothing, a line of one page all), bottom-up a
composite of both tells it of whole branches, and branches of low importance
are removed from each page, at whatever depth they stand. The trees of all
hosts, merged once more, tell the same of lines that recur from host to host,
which is all there is for sites of a page or two.

Teasers and advertisements differ from page to page as bodies do. Between the
branches that importance leaves, the page's own name decides (a heading that
is its title, or its address): the node that holds it is the body node of the
host, and how often a line stands in bodies or beside them, over all pages,
tells headings of bodies from headings of boxes. Where no page of a host is
named so, its body node is the one of most important content.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.llm.addresses import fold
from skarv.session import cut

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b big button cite code em font i img input label mark q s small span strong sub sup time tt u wbr".split())
UNSEEN = frozenset("head noscript script style template title".split())
#: Elements whose content is characters up to their own end tag.
RAW = frozenset("script style title textarea".split())
#: What text flows in; other elements with elements inside hold parts of a page.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address caption hr br".split())
#: What lays out a branch that is a table; in other branches it is content.
LAYOUT = frozenset("table tbody td tr".split())
#: A new element of these ends an open one of its kind, unless a holder lies between.
ENDED = {"p": ("div", "td", "section", "article"), "li": ("ul", "ol"), "td": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
PRESENTATION = ("class", "id", "role", "align", "border", "valign", "width")

#: Branches whose composite importance is less than this are removed.
REMOVED = 0.3
#: A part of less importance within a branch parts the branch into its parts.
NESTED = 0.15
#: Lines of less importance that at least so many pages or hosts repeat part from
#: the ends of the flow they stand in.
REPEATED, REPEATS = 0.02, 5
#: A branch that holds this much of a page's text is a wrapper, as ``body`` is.
WRAPPER = 0.7
#: The weight of a branch's content beside its presentation.
CONTENT = 0.9
_TEASER = re.compile(r"(?:…|\.\.\.)\s+\S+(?:\s\S+){0,3}$")
#: Attributes end at ``>`` outside quotes; where quotes don't close before the next tag, at the first ``>``.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)(?:((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|([^>]*)>)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SHOWN = re.compile(rf"(?i)\b(?:{'|'.join(PRESENTATION)})\s*=")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63


class Tree:
    """The block elements of a page below ``body`` (element 0), and its visible lines with the element each stands in."""

    def __init__(self, html: str):
        self.parents, self.tags, self.shapes, self.nodes = [-1], ["body"], ["body"], [0]
        self.inside: list[list[int]] = [[]]
        self.lines: list[tuple[str, int]] = []
        self.title = ""
        self._text: list[str] = []
        self._stack: list[tuple[str, int]] = []
        self._open: Counter = Counter()
        self._hidden = 0
        self._feed(html)
        self._flush()

    def _feed(self, html: str):
        at, tags_end, size = 0, html.rfind(">") + 1, len(html)
        while at < size:
            tag = html.find("<", at)
            if tag < 0 or tag >= tags_end:
                self._data(html[at:])
                return
            if tag > at:
                self._data(html[at:tag])
            if html.startswith(("<!", "<?"), tag):
                end = html.find("-->", tag + 4) + 3 if html.startswith("<!--", tag) else 0
                at = end if end > 2 else html.find(">", tag) + 1
                continue
            found = _TAG.match(html, tag)
            if not found:
                self._data("<")
                at = tag + 1
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3] or found[4] or "")
            if name in RAW:
                close = re.compile(rf"(?i)</{name}\b").search(html, at)
                end = close.start() if close else size
                if name == "title" and not self.title:
                    self.title = " ".join(entities.unescape(html[at:end]).split())
                elif name == "textarea":
                    self._data(html[at:end])
                at = end

    def _flush(self):
        line = " ".join("".join(self._text).split())
        self._text = []
        if line:
            self.lines.append((line, self._stack[-1][1] if self._stack else 0))

    def _pop(self, k: int):
        for tag, _ in self._stack[k:]:
            self._open[tag] -= 1
            self._hidden -= tag in UNSEEN
        del self._stack[k:]

    def _start(self, tag: str, attributes: str):
        if tag in ("html", "body"):
            return
        if tag not in INLINE and tag not in UNSEEN:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDED and self._open[tag]:
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k][0] == tag:
                    self._pop(k)
                    break
                if self._stack[k][0] in ENDED[tag]:
                    break
        element = self._stack[-1][1] if self._stack else 0
        if tag in UNSEEN:
            self._hidden += 1
        elif tag not in INLINE and not self._hidden:
            shape = tag
            if _SHOWN.search(attributes):
                given = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)}
                shape += "".join(f"[{a}={given[a]}]" for a in PRESENTATION if given.get(a))
            self.parents.append(element)
            self.tags.append(tag)
            self.shapes.append(shape)
            self.nodes.append(_hash(f"{self.nodes[element]}>{shape}"))
            self.inside.append([])
            self.inside[element].append(len(self.parents) - 1)
            element = len(self.parents) - 1
        self._stack.append((tag, element))
        self._open[tag] += 1

    def _end(self, tag: str):
        if tag not in INLINE and tag not in UNSEEN:
            self._flush()
        if self._open[tag]:
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k][0] == tag:
                    self._pop(k)
                    break

    def _data(self, data: str):
        if not self._hidden:
            self._text.append(entities.unescape(data) if "&" in data else data)

    def node(self, e: int) -> int:
        """An element's place in the style tree; of a table that lays out, with its first cell's presentation."""
        place = self.nodes[e]
        if self.tags[e] == "table":
            while self.inside[e] and self.tags[self.inside[e][0]] in LAYOUT:
                e = self.inside[e][0]
                place = _hash(f"{place}>{self.shapes[e]}")
        return place

    def style(self, e: int) -> int:
        """The sequence of an element's children, repetitions taken together; never 0."""
        tags = [self.shapes[c] for c in self.inside[e]]
        return _hash(",".join(t for i, t in enumerate(tags) if i == 0 or t != tags[i - 1])) or 1


def _name(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", fold(text))


def _aligned(choices: list) -> list[tuple[int, int]]:
    """The longest ``(line, place)`` in the order of both, of the ascending places that each line may take.

    A line that also stands far below can't take those between along with it.
    """
    ends: list[int] = []  # the least place at which a chain of each length ends
    last: list[tuple[int, int, tuple | None]] = []
    for i, places in enumerate(choices):
        for j in reversed(places):
            n = bisect_left(ends, j)
            link = i, j, last[n - 1] if n else None
            if n == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[n], last[n] = j, link
    out, link = [], last[-1] if last else None
    while link is not None:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def read_page(html: str | None, text: str | None, url: str | None) -> dict:
    """One page as its title's hash and parallel lists: its lines, and the elements that hold them.

    Lines: ``line_no``, ``length``, ``line`` (hash of the text), ``element``
    (-1 where ``html`` doesn't tell), ``named`` (it is the first part of the
    page's title, or what the last part of its address was made of),
    ``teaser``, ``heading``. Elements: ``parent``, ``node`` (the place in the
    style tree), ``style`` (the presentation there, 0 if no element is
    inside), ``flow``; the first one is ``body``.
    """
    shown = (text or "").split("\n")
    tree = Tree(html or "")
    squeezed = [" ".join(line.split()) for line in shown]
    place: list[int] = [-1] * len(shown)
    if squeezed == [line for line, _ in tree.lines]:
        place = [element for _, element in tree.lines]
    else:
        stands: dict[str, list[int]] = {}
        for j, (line, _) in enumerate(tree.lines):
            stands.setdefault(line, []).append(j)
        for i, j in _aligned([stands.get(line, ()) for line in squeezed]):
            place[i] = tree.lines[j][1]
    title = tree.title
    titles = {t.strip() for t in re.split(r"\s[|–—·-]\s", title)[:1]} | {title, title.split(" | ")[0]}
    try:
        slug = unquote(urlsplit(url or "").path).rstrip("/").rsplit("/", 1)[-1]
    except ValueError:
        slug = ""
    slug = _name(re.sub(r"[-_]?\d+$|\.\w{2,5}$", "", slug))
    # Only elements that hold lines are kept.
    holding = {0}
    for e in set(place) - {-1}:
        while e not in holding:
            holding.add(e)
            e = tree.parents[e]
    kept = sorted(holding)
    number = {e: k for k, e in enumerate(kept)} | {-1: -1}
    out: dict[str, list] = {c: [] for c in ("line_no", "length", "line", "element", "named", "teaser", "heading")}
    for i, (line, e) in enumerate(zip(squeezed, place)):
        if not line:
            continue
        named = line in titles
        if not named and not (title and html) and len(slug) >= 5:
            own = _name(line)
            named = own == slug or (len(slug) >= 20 and own.startswith(slug)) or (len(slug) >= 20 and len(own) >= 20 and slug.startswith(own))
        out["line_no"].append(i + 1)
        out["length"].append(len(line))
        out["line"].append(_hash(line))
        out["element"].append(number[e])
        out["named"].append(named)
        out["teaser"].append(("…" in line or "..." in line) and _TEASER.search(line) is not None)
        out["heading"].append(len(line) < 80 and line[-1] not in ".!?…")
    out["title"] = _hash(f"{title}\n")  # no line has its hash
    out["parent"] = [number[tree.parents[e]] if e else -1 for e in kept]
    out["node"] = [tree.node(e) for e in kept]
    out["style"] = [tree.style(e) if tree.inside[e] else 0 for e in kept]
    # An element without elements inside flows, unless one beside it at the same place has some.
    parts = {(tree.parents[e], tree.nodes[e]) for e in kept if tree.inside[e]}
    out["flow"] = [tree.tags[e] in FLOW or (tree.parents[e], tree.nodes[e]) not in parts for e in kept]
    return out


def _site(url: str | None) -> tuple[str, str]:
    """Host and address without what a second capture may change."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.netloc.removeprefix("www.")
        return host, host + parts.path.rstrip("/")
    except ValueError:
        return "", ""


_LISTS = "line_no array<int>, length array<int>, line array<long>, element array<int>, named array<boolean>, teaser array<boolean>, heading array<boolean>, parent array<int>, node array<long>, style array<long>, flow array<boolean>"
_PAGE = f"page_id long, host long, url long, title long, {_LISTS}, feature array<long>, form array<long>"
#: The feature that every page has; how many have it is the size of the host.
SIZE = 0


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_pages(pages: DataFrame) -> DataFrame:
    """All pages as lists of hashes; see ``read_page``. ``feature`` and ``form`` are each page's distinct lines (of form 0) and nodes with their presentation."""
    wanted = _names(_PAGE)

    def read(batches):
        for frame in batches:
            made: dict[str, list] = {c: [] for c in wanted}
            for page, url, html, text in zip(frame["page_id"], frame["source_url"], frame["html"], frame["text"]):
                host, address = _site(url)
                row = read_page(html, text, url)
                features = {(SIZE, 0), (row["title"], 0), *((line, 0) for line in row["line"]), *((n, s) for n, s in zip(row["node"][1:], row["style"][1:]) if s)}
                row |= {"page_id": page, "host": _hash(host or f"page {page}"), "url": _hash(address or f"page {page}"), "feature": [f for f, _ in features], "form": [s for _, s in features]}
                for c in wanted:
                    made[c].append(row[c])
            yield pd.DataFrame(made)

    source = pages.where("page_id is not null and text is not null and text <> ''").select("page_id", "source_url", "html", "text")
    return source.mapInPandas(read, _PAGE)


def style_tree(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees: ``host, feature, pages, weighed, hosts`` and one row with the number of hosts.

    ``pages`` is how many pages of the host have a line or node, ``weighed``
    what the entropy of the node's presentations is made of (the sum of n log
    n over them), ``hosts`` how many hosts have the line. Captures of one
    address count once. Lines of a single page are left out: their importance
    is 1. All counts combine before the shuffle and none gathers the pages of
    a host, so one host may hold any share of them.
    """
    seen = read.select("host", "url", F.inline(F.arrays_zip("feature", "form"))).distinct()
    forms = seen.groupBy("host", "feature", "form").agg(F.count("*").alias("n"))
    merged = cut(forms.groupBy("host", "feature").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("weighed"), F.max(F.col("form") != 0).alias("is_node")))
    spread = merged.where("not is_node").groupBy("feature").agg(F.count("*").alias("hosts")).where("hosts > 1")
    tree = merged.join(spread, "feature", "left").na.fill(1, ["hosts"]).where(f"pages > 1 or hosts > 1 or feature = {SIZE}")
    return tree.select("host", "feature", "pages", "weighed", "hosts"), merged.where(f"feature = {SIZE}").agg(F.count("*").alias("all_hosts"))


def _told(pages: DataFrame, features: DataFrame, keys: list[str], values: list[str], wanted: DataFrame) -> DataFrame:
    """``pages`` with ``told_feature`` and the ``values`` as lists of all features that ``wanted`` (``page_id`` and ``keys``) asks for.

    Only features that ``features`` has travel, and a page is gathered whole,
    never a host.
    """
    found = wanted.join(features, keys).groupBy("page_id").agg(F.collect_list(F.struct("feature", *values)).alias("_told"))
    lists = [F.coalesce(F.col(f"_told.{c}"), F.array().cast("array<double>" if c == "weighed" else "array<long>")).alias(f"told_{c}") for c in ("feature", *values)]
    return pages.join(found, "page_id", "left").select(*(c for c in pages.columns), *lists)


class Branches:
    """The branches of one page: which lines are of which, and how important each branch is."""

    def __init__(self, page: dict, line: list[float], constant: list[bool], presentation: dict[int, float]):
        self.parent, self.node, self.flow = page["parent"], page["node"], page["flow"]
        element, length = page["element"], page["length"]
        many = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(many)]
        for e in range(1, many):
            self.children[self.parent[e]].append(e)
        # Bottom-up: an element's composite importance, its own lines being leaves.
        self.mass, self.size = [0.0] * many, [0.0] * many
        self.constant = [True] * many
        for e, w, x, c in zip(element, length, line, constant):
            if e >= 0:
                self.mass[e] += w * x
                self.size[e] += w
                self.constant[e] &= c
        self.own = list(self.size)
        self.importance = [0.0] * many
        for e in range(many - 1, -1, -1):
            average = self.mass[e] / self.size[e] if self.size[e] else 0.0
            if len(self.children[e]) + (self.own[e] > 0) > 1:  # a mere holder of one element is its element
                average = CONTENT * average + (1 - CONTENT) * presentation.get(self.node[e], 1.0)
            self.importance[e] = average
            if e:
                self.mass[self.parent[e]] += average * self.size[e]
                self.size[self.parent[e]] += self.size[e]
                self.constant[self.parent[e]] &= self.constant[e]
        self.branch = [-1] * many
        self.places: list[int] = []
        self.weights: list[float] = []
        self.total = self.size[0]
        self._part(0)

    def _new(self, elements: list[int], node: int):
        k = len(self.places)
        self.places.append(node)
        size = sum(self.size[e] for e in elements)
        self.weights.append(sum(self.importance[e] * self.size[e] for e in elements) / size if size else 0.0)
        for e in elements:
            self.branch[e] = k

    def _part(self, first: int):
        """Parts ``first`` into its children, those into theirs where they mix what is important with what isn't."""
        waiting = [first]
        while waiting:
            held = waiting.pop()
            children = self.children[held]
            flowing = [e for e in children if self.flow[e]]
            if held:
                while flowing and self.constant[flowing[0]]:
                    self._new([flowing[0]], self.node[flowing.pop(0)])
                while flowing and self.constant[flowing[-1]]:
                    self._new([flowing[-1]], self.node[flowing.pop()])
            for e in children:
                if self.flow[e]:
                    continue
                inner = self._mixed(e)
                if inner is None:
                    self._new([e], self.node[e])
                else:
                    waiting.append(inner)
            if flowing or self.own[held]:
                self._new(flowing, _flow(self.node[held]))
                self.branch[held] = len(self.places) - 1

    def _mixed(self, e: int) -> int | None:
        """The element within ``e`` whose children part, if ``e`` isn't of one piece."""
        while not self.own[e] and len(self.children[e]) == 1:
            e = self.children[e][0]
        children = self.children[e]
        if len(children) < 2 or self.importance[e] < NESTED:
            return None
        if any(not self.flow[c] and self.importance[c] < NESTED for c in children):
            return e
        if self.size[e] >= WRAPPER * self.total:
            flowing = [c for c in children if self.flow[c]]
            if flowing and (self.constant[flowing[0]] or self.constant[flowing[-1]]):
                return e
        return None

    def of(self, element: int) -> int:
        """The branch that an element stands in."""
        while element > 0 and self.branch[element] < 0:
            element = self.parent[element]
        return self.branch[element]


def _flow(node: int) -> int:
    return _hash(f"{node} flow")


_BRANCHED = "page_id long, host long, line_no array<int>, line array<long>, own array<float>, named array<boolean>, teaser array<boolean>, heading array<boolean>, branch array<int>, kept array<boolean>, main array<boolean>, body array<boolean>, first array<boolean>, place array<long>, mass array<float>, flat boolean"


def _each(frames: DataFrame, decide, schema: str) -> DataFrame:
    """``decide`` over each page's columns."""
    wanted = _names(schema)

    def run(batches):
        for frame in batches:
            made: dict[str, list] = {c: [] for c in wanted}
            columns = list(frame.columns)
            for row in zip(*(frame[c].tolist() for c in columns)):
                got = decide(dict(zip(columns, row)))
                for c in wanted:
                    made[c].append(got[c])
            yield pd.DataFrame(made)

    return frames.mapInPandas(run, schema)


def _importance(many: float, of: float) -> float:
    """``1 - log(many) / log(of)``: the entropy of a feature that ``many`` of ``of`` pages share, taken from 1."""
    return min(1.0, max(0.0, 1 - math.log(many) / math.log(of))) if of > 1 else 1.0


def _branches(page: dict) -> dict:
    """One page: its branches' importance, what is removed, and the branches that name it."""
    told = {f: (m, w, h) for f, m, w, h in zip(*(page[f"told_{c}"].tolist() for c in ("feature", "pages", "weighed", "hosts")))}
    size, hosts = told[SIZE][0], page["all_hosts"]
    lines = page["line"].tolist()
    n = len(lines)
    own, web, constant, presentation = np.ones(n), np.ones(n), [False] * n, {}
    for i, f in enumerate(lines):
        if f in told:
            own[i] = _importance(told[f][0], size)
            web[i] = _importance(told[f][2], hosts)
            constant[i] = (own[i] < REPEATED and told[f][0] >= REPEATS) or (web[i] < REPEATED and told[f][2] >= REPEATS)
    for f, s in zip(page["node"], page["style"]):
        if s:
            m, weighed = told[f][:2] if f in told else (1, 0.0)
            # -sum(p log_m p) with p = n / m
            presentation[f] = 1 - weighed / (m * math.log(m)) if m > 1 else 1.0
    out = {c: page[c] for c in ("page_id", "host", "line_no", "teaser", "heading")} | {"line": lines, "own": own, "named": page["named"]}
    element = np.asarray(page["element"])
    no, yes = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
    if (element < 0).all():
        return out | {"branch": np.full(n, -1), "kept": yes, "main": no, "body": no, "first": no, "place": [], "mass": [], "flat": True}
    # The fewer pages a host has, the more the merged tree of all hosts tells.
    line = np.minimum(own, web + (1 - web) * (1 - 1 / math.log2(size + 1)))
    length, named, teaser = np.asarray(page["length"]), np.asarray(page["named"]), np.asarray(page["teaser"])
    found = Branches({c: page[c].tolist() for c in ("parent", "node", "flow", "element", "length")}, line.tolist(), constant, presentation)
    number = np.array([found.of(e) if e >= 0 else -1 for e in element.tolist()])
    first = np.concatenate(([True], number[1:] != number[:-1]))
    inside = {k: number == k for k in np.unique(number).tolist()}
    importance = {k: found.weights[k] if k >= 0 else float(line[i].mean()) for k, i in inside.items()}
    mass = {k: float((line[i] * length[i]).sum()) for k, i in inside.items()}
    # A title that every page of the host repeats names none of them.
    title = told.get(page["title"])
    if title is not None and title[0] >= REPEATS and _importance(title[0], size) < REPEATED:
        named = no
    naming = [k for k, i in inside.items() if k >= 0 and named[i].any()]
    telling = [k for k in naming if importance[k] >= REMOVED] or naming
    body = max(telling, key=lambda k: (not teaser[inside[k]].any(), named[inside[k]][0], mass[k], -k)) if telling else -2
    kept = np.array([k == body or importance[k] >= REMOVED for k in number.tolist()])
    place = np.array([found.places[k] if k >= 0 else 0 for k in number.tolist()], dtype=np.int64)
    weight = [mass[k] if k in mass and importance[k] >= REMOVED and not teaser[inside[k]].any() else 0.0 for k in range(len(found.places))]
    alike = (place == found.places[body]) & kept & (number >= 0) if body >= 0 else no
    if body >= 0 and named[alike].all() and sum(weight) > weight[body]:
        # A heading in a branch of its own: the text it heads is the branch of most important content.
        text = max((k for k in inside if k >= 0 and k != body), key=lambda k: (weight[k], -k))
        alike |= (place == found.places[text]) & kept & (number >= 0)
    return out | {"named": named, "branch": number, "kept": kept, "main": number == body, "body": alike, "first": first, "place": found.places, "mass": weight, "flat": False}


def _page_body(page: dict) -> dict:
    """The lines of one page's body."""
    told = {f: counts for f, *counts in zip(*(page[f"told_{c}"].tolist() for c in ("feature", "bodies", "boxes", "box_firsts")))}
    text_body, box_count, box_first = np.array([told.get(f, (0, 0, 0)) for f in page["line"].tolist()], dtype=np.int64).reshape(-1, 3).T
    box = box_count > text_body
    named, teaser, heading, number = (np.asarray(page[c]) for c in ("named", "teaser", "heading", "branch"))
    box_heading = (box_first > text_body) & heading
    n = len(number)
    keep = np.zeros(n, dtype=bool)
    if not page["flat"]:
        body = np.asarray(page["body"])
        if not body.any():  # the page isn't named: its host's body nodes, less what boxes hold
            places = page["place"]
            nodes = np.array([k >= 0 and places[k] in told and told[places[k]][0] > 0 for k in number.tolist()], dtype=bool)
            body = np.asarray(page["kept"]) & nodes & (number >= 0)
            for k in np.unique(number[body]):
                if box[number == k].all():
                    body = body & (number != k)
            at = np.flatnonzero(body)
            if len(at) and at[0] > 0:  # what heads it may be a branch of its own
                ahead = number == number[at[0] - 1]
                if page["kept"][at[0] - 1] and number[at[0] - 1] >= 0 and (heading & ~box & ~box_heading & ~teaser)[ahead].all():
                    body = body | ahead
        for k in np.unique(number[body]):
            mine = number == k
            if page["main"][np.flatnonzero(mine)[0]] or not (box_heading[mine][0] or teaser[mine].any()):
                keep |= mine
        if keep.any() and not named[keep].any() and not (np.asarray(page["own"])[keep] > 0.5).any():
            keep[:] = False
        return {"page_id": page["page_id"], "line_no": np.asarray(page["line_no"])[keep]}
    ends = box | teaser
    starts = np.flatnonzero(named & ~teaser).tolist()

    def run_from(i: int) -> int:
        after = np.flatnonzero(ends[i + 1 :])
        return int(after[0]) + i + 1 if len(after) else n

    if starts:  # a menu may name the page too
        start = max(starts, key=lambda i: (run_from(i) - i, -i))
    else:
        start, waiting = None, False
        for i in range(n):
            if box_heading[i]:
                waiting = True
            elif ends[i]:
                waiting = False
            elif not waiting or heading[i]:
                start = i
                break
    if start is not None:
        keep[start : run_from(start)] = True
        if keep.sum() == 1 and not starts:
            keep[:] = False
    return {"page_id": page["page_id"], "line_no": np.asarray(page["line_no"])[keep]}


def body_lines(pages: DataFrame) -> DataFrame:
    """``page_id, line_no``: the lines of ``text`` that belong to each page's own body.

    * Lines are split at ``\\n`` and counted from 1; empty ones belong to none.
    * A page whose ``html`` is null, empty or doesn't hold its lines is read
      by its text alone, with what the other pages tell of its lines. A null
      or empty ``text`` has no lines. A page without a body has none.
    * Captures of one address come out one by one but count once. A null
      ``source_url`` makes a site of its own. Ids are taken to be unique.
      Further columns are ignored. Texts are read whole, trees at any depth.
    """
    read = cut(read_pages(pages))
    tree, hosts = style_tree(read)
    wanted = read.select("page_id", "host", F.explode(F.array_distinct("feature")).alias("feature"))
    weighed = _told(read.drop("feature", "form", "url"), tree, ["host", "feature"], ["pages", "weighed", "hosts"], wanted).join(F.broadcast(hosts))
    branched = cut(_each(weighed, _branches, _BRANCHED))

    # What stands in bodies and what in boxes, over all pages that tell.
    no_host = F.lit(0).cast("long")
    naming = branched.where("not flat and exists(body, b -> b)")
    lines = naming.select(F.inline(F.arrays_zip("line", "body", "first"))).select(no_host.alias("host"), F.col("line").alias("feature"), (F.col("body") & ~F.col("first")).alias("_in"), (~F.col("body")).alias("_box"), (~F.col("body") & F.col("first")).alias("_box_first"))
    placed = F.filter(F.arrays_zip("branch", "named", "body"), lambda x: x["body"] & x["named"])
    nodes = naming.select("host", "place", F.explode(placed).alias("_x")).select("host", F.get("place", F.col("_x.branch")).alias("feature"), F.lit(True).alias("_in"), F.lit(False).alias("_box"), F.lit(False).alias("_box_first"))
    counts = lines.unionByName(nodes).groupBy("host", "feature").agg(F.count_if("_in").alias("bodies"), F.count_if("_box").alias("boxes"), F.count_if("_box_first").alias("box_firsts"))
    counts = counts.where(f"boxes > 0 or bodies > 1 or host <> 0")
    # Hosts none of whose pages is named: the node of most important content.
    unnamed = branched.where("not flat").groupBy("host").agg(F.max(F.exists("body", lambda b: b)).alias("_any")).where("not _any").select("host")
    masses = branched.join(unnamed, "host", "left_semi").select("host", F.inline(F.arrays_zip("place", "mass"))).groupBy("host", "place").agg(F.sum("mass").alias("mass"))
    chosen = masses.groupBy("host").agg(F.max_by("place", F.struct("mass", "place")).alias("feature"), F.max("mass").alias("mass")).where("mass > 0")
    counts = counts.unionByName(chosen.select("host", "feature", F.lit(1).cast("long").alias("bodies"), F.lit(0).cast("long").alias("boxes"), F.lit(0).cast("long").alias("box_firsts")))
    asked = branched.select("page_id", F.explode(F.array_distinct("line")).alias("feature")).select("page_id", no_host.alias("host"), "feature")
    asked = asked.unionByName(branched.where("not exists(body, b -> b)").select("page_id", "host", F.explode(F.array_distinct("place")).alias("feature")))
    known = _told(branched.drop("mass", "host"), counts, ["host", "feature"], ["bodies", "boxes", "box_firsts"], asked)
    return _each(known, _page_body, "page_id long, line_no array<long>").select("page_id", F.explode("line_no").alias("line_no"))
