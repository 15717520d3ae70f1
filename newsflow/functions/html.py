"""News tables and links of HTML pages, read by the standard parser: entities, quotes, nesting and any tag names."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle

# The functions below travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    """Element of a page: name, attributes, children, which are elements and texts."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []

    def every(self, name: str | None = None) -> list[Element]:
        """Elements of a name below this one, in page order."""
        found, todo = [], list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, Element):
                if name is None or node.name == name:
                    found.append(node)
                todo.extend(reversed(node.children))
        return found

    def text(self) -> str:
        """Texts below, each without outer blanks."""
        parts, todo = [], list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, Element):
                todo.extend(reversed(node.children))
            else:
                parts.append(node.strip())
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def links(html: str | None) -> list[tuple[int, str, str]]:
    """(pos, address, label) of every link with an address."""
    found = [(a.attributes["href"], a.text()) for a in parse(html).every("a") if "href" in a.attributes]
    return [(i, href, label) for i, (href, label) in enumerate(found)]


def news_rows(html: str | None, table_id: str = "news-table") -> list[tuple[int, str, str, str, str]]:
    """(pos, cell, full, address, headline) of the rows of the first element with this id.

    A row needs two cells and a link in the second one. `full` is the cell with the date of the last dated row before
    it where it is a time only.
    """
    table = next((e for e in parse(html).every() if e.attributes.get("id") == table_id), None)
    out, day = [], None
    for pos, row in enumerate(table.every("tr") if table else []):
        cells = row.every("td")
        link = next(iter(cells[1].every("a")), None) if len(cells) > 1 else None
        if link is None or "href" not in link.attributes:
            continue
        cell = cells[0].text()
        if " " in cell or "-" in cell or cell.lower().startswith("today"):
            full, day = cell, _day_of(cell)
        else:
            full = f"{day} {cell}" if day else cell
        out.append((pos, cell, full, link.attributes["href"], link.text()))
    return out


def block_rows(html: str | None) -> int | None:
    """Rows of the first news block that has more than one row and a link, nested ones included; none without such a block.

    Blocks are looked for best first: a table of the class, an element of the id, a table or div with a class that
    contains the word. Of each kind the first element counts.
    """
    every = parse(html).every()

    def classes(e: Element) -> str:
        return e.attributes.get("class", "")

    kinds = (
        lambda e: e.name == "table" and "fullview-news-outer" in classes(e).split(),
        lambda e: e.attributes.get("id") == "news-table",
        lambda e: e.name == "table" and "news" in classes(e),
        lambda e: e.name == "div" and "news-table" in classes(e),
    )
    for kind in kinds:
        block = next(filter(kind, every), None)
        if block is not None:
            rows = len(block.every("tr"))
            if rows > 1 and block.every("a"):
                return rows
    return None


def block_counts(html: pd.Series) -> pd.Series:
    """`block_rows` of a batch of pages."""
    return html.map(block_rows, na_action="ignore").astype("Int32")


def _day_of(cell: str) -> str:
    """Cell without a time at its end."""
    head, _, clock = cell.rpartition(" ")
    if head and clock[:1].isdigit() and ":" in clock:
        return head.strip()
    if clock.lower() in ("am", "pm") and ":" in head:
        return head.rpartition(" ")[0].strip()
    return cell
