"""Links out of list pages: a table function over HTML, and the href rules as column expressions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces whose pages are no entries.
NAMESPACES = ("Wikipedia:", "Help:", "Portal:", "Category:", "File:", "Template:", "Talk:", "Special:", "Book:", "Draft:", "Module:", "MediaWiki:")
#: How titles of list pages begin.
LISTS = r"^(?i)(List|Outline|Index) of\b"
#: Sections that are never scanned.
SKIPPED = (
    "see also", "references", "notes", "further reading", "external links", "bibliography", "sources", "notable researchers",
    "notable memory researchers", "famous mnemonists", "people", "scholars", "contributors", "in popular culture", "in fiction", "media",
)
#: Classes of elements and tables without entries, and of links that are none.
NOISE = {"navbox", "infobox", "thumb", "sidebar", "hatnote", "reflist"}
NO_CONTENT = {"ambox", "navbox", "infobox", "sidebar", "metadata", "plainlinks", "hatnote"}
NO_LINK = {"external", "mw-cite-backlink"}
SCANNED = {"ul", "ol", "div", "dl", "section", "p", "table"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}


def href_title(href: Column, prefix: str = "/wiki/") -> Column:
    """The page title that a link names: what follows ``prefix`` up to '#', percent-decoded ('+' stays), '_' as
    blank; null if the link is another, its title empty, in one of NAMESPACES or that of a list."""
    rest = F.split_part(F.substring(href, F.lit(len(prefix) + 1), F.length(href)), F.lit("#"), F.lit(1))
    title = F.replace(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    bad = title.rlike("^(" + "|".join(NAMESPACES) + ")") | title.rlike(LISTS) | (title == "")
    return F.when(F.startswith(href, F.lit(prefix)) & ~bad, title)


def _title(href: str, prefix: str) -> str | None:
    from urllib.parse import unquote

    if not href.startswith(prefix):
        return None
    t = unquote(href[len(prefix) :].split("#", 1)[0]).replace("_", " ")
    return None if not t or t.startswith(NAMESPACES) or re.match(r"(list|outline|index) of\b", t, re.I) else t


class _Node:
    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = set((attrs.get("class") or "").split())

    def walk(self, tags=None, without=lambda n: False):
        for c in self.children:
            if isinstance(c, _Node) and not without(c):
                if tags is None or c.tag in tags:
                    yield c
                yield from c.walk(tags, without)

    def text(self, sep: str = "") -> str:
        return sep.join(c.strip() if isinstance(c, str) else c.text(sep) for c in self.children).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr", "td", "th"):  # these close an open one of their kind
            n = self.at
            while n.parent and n.tag not in ("ul", "ol", "table", tag) and not (tag in ("td", "th") and n.tag in ("tr", "td", "th")):
                n = n.parent
            if n.tag == tag or (tag in ("td", "th") and n.tag in ("td", "th")):
                self.at = n.parent
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        if data.strip():
            self.at.children.append(data)


def _top_nodes(tree: _Tree):
    """(section, element) of a page's elements outside of any list or box, in order. A second-level heading opens the
    section of its words, other headings open none; what comes before is in section ''."""
    root = next((n for n in tree.root.walk() if "mw-parser-output" in n.classes), None) or next(tree.root.walk({"body"}), tree.root)
    section = ""
    for n in root.children:
        if isinstance(n, str):
            continue
        marks = [c for c in n.classes if c.startswith("mw-heading") and c[10:].isdigit()] if n.tag == "div" else []
        if n.tag == "h2" or "mw-heading2" in marks:
            words = n.text(" ").lower()
            section = words.removesuffix("]").rstrip().removesuffix("edit").rstrip().removesuffix("[").strip() if words.endswith("]") else words
        elif not marks:
            yield section, n


def extract_entries(html: str, skip: tuple[str, ...] = (), prefix: str = "/wiki/") -> list[tuple[str, str]]:
    """(title, anchor) of a list page's entries in page order, each title once: the first link of every list item
    and of the first cell of every row of content tables, outside the sections of SKIPPED and ``skip``."""
    tree = _Tree()
    tree.feed(html or "")
    closed = {*SKIPPED, *(s.replace("_", " ").strip().lower() for s in skip)}
    is_content = lambda n: n.tag == "table" and "wikitable" in n.classes and not n.classes & NO_CONTENT

    def places(n):
        tables = [n] if is_content(n) else [t for t in n.walk({"table"}) if is_content(t)]
        for t in tables:
            for row in t.walk({"tr"}):
                cells = list(row.walk({"td", "th"}))
                if {"td"} & {c.tag for c in cells}:
                    yield cells[0]
        if not is_content(n):
            yield from n.walk({"li"}, without=lambda x: x.tag == "table" or bool(x.classes & NOISE))

    found: dict[str, str] = {}
    for section, n in _top_nodes(tree):
        if section in closed or n.tag not in SCANNED:
            continue
        for place in places(n):
            link = next((x for x in place.walk({"a"}) if "href" in x.attrs), None)
            title = None if link is None or link.classes & NO_LINK else _title(link.attrs["href"], prefix)
            if title and title not in found:
                found[title] = link.text() or title
    return list(found.items())


def entries(pages, html: str = "html", key: str = "id", prefix: str = "/wiki/"):
    """(key, position, title, anchor) of each page's entries, page by page in Arrow batches."""
    import pyarrow as pa

    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = [(k, i, t, a) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (t, a) in enumerate(extract_entries(h, prefix=prefix))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[key, "position", "title", "anchor"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, position int, title string, anchor string")
