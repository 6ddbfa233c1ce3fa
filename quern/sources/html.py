"""Products, categories, tables and links out of stored HTML pages.

Pages are parsed by a tolerant event parser, in Arrow batches; nothing is fetched.  A record extractor is a function
from (url, html) to rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import first_wins

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                stack.extend(reversed(node.children))
        return " ".join(" ".join(out).split())

    def has(self, tag: str | None = None, cls: str | None = None) -> bool:
        return (tag is None or self.tag == tag) and (cls is None or cls in self.attrs.get("class", "").split())

    def find(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.has(tag, cls)]

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.has(tag, cls)), None)

    def inside(self, cls: str) -> bool:
        node = self.parent
        while node and cls not in node.attrs.get("class", "").split():
            node = node.parent
        return node is not None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# -- record extractors


def links(url: str, html: str) -> list[tuple]:
    """(href, resolved, text) of each anchor; relative references are resolved against the page."""
    return [(n.attrs["href"], urljoin(url or "", n.attrs["href"]), n.text()) for n in tree(html).find("a") if n.attrs.get("href")]


def key_values(url: str, html: str) -> list[tuple]:
    """(key, value) of each table row with a heading and a cell; the last of a key wins."""
    found: dict[str, str] = {}
    for row in tree(html).find("tr"):
        key = " ".join(x for n in row.find("th") if (x := n.text()))
        value = " ".join(x for n in row.find("td") if (x := n.text()))
        if key and value:
            found[key] = value
    return list(found.items())


def categories(url: str, html: str) -> list[tuple]:
    """(title, link, parent, level) of the list items that hold a link, by their nesting."""
    out = []
    for item in tree(html).find("li"):
        anchor = next((c for c in item.children if isinstance(c, Node) and c.tag == "a"), None)
        if anchor is None:
            continue
        above, level, parent = item.parent, 0, None
        while above:
            if above.tag == "li":
                level += 1
                own = next((c for c in above.children if isinstance(c, Node) and c.tag == "a"), None)
                parent = parent or (own.text() if own else None)
            above = above.parent
        out.append((anchor.text(), urljoin(url or "", anchor.attrs.get("href", "")), parent, level))
    return out


def paging(url: str, html: str) -> list[tuple]:
    """(page, begin, size): the distinct pages that paging links lead to, as offsets."""
    found = re.findall(r'pageNumber:\s*"?(\d+)"?\s*,\s*pageSize:\s*"?(\d+)', html or "")
    return [(int(p), (int(p) - 1) * int(s), int(s)) for p, s in dict.fromkeys(found)]


def thumbnails(url: str, html: str) -> list[tuple]:
    """(id, name, crawl_link, img_url, price, weight) of each product in a grid."""
    out = []
    for box in tree(html).find(cls="product"):
        name = box.first(cls="product_name")
        anchor = name.first("a") if name else None
        if anchor is None or not anchor.text():
            continue
        ident = re.search(r'"catentry_id"\s*:\s*"(\d+)"', (box.parent or box).text())
        image = next((n for b in box.find(cls="image") for n in b.find("img")), None)
        price, weight = box.first(cls="price"), box.first(cls="product_weight")
        out.append((ident.group(1) if ident else None, (anchor.attrs.get("title") or anchor.text()).strip(), urljoin(url or "", anchor.attrs.get("href", "")), image.attrs.get("src") if image else None, price.text() if price else None, weight.text() if weight else ""))
    return out


def details(url: str, html: str) -> list[tuple]:
    """(id, page_name, canonical link, details) of a product page."""
    root = tree(html)
    info = root.first(cls="product-info")
    if info is None:
        return []
    header = info.first(cls="main_header")
    ident = re.search(r'"catentry_id"\s*:\s*"(\d+)"', root.text())
    pairs = {}
    for row in root.find("tr"):
        if row.inside("product-characteristics") or row.inside("product-desc"):
            key, value = (" ".join(x for n in row.find(t) if (x := n.text())) for t in ("th", "td"))
            if key and value:
                pairs[key] = value
    base = re.match(r"^(\w+://)([^/?#]*)", url or "")
    link = f"{base.group(1)}{base.group(2).lower()}/product?id={ident.group(1)}" if base and ident else None
    return [(ident.group(1) if ident else None, header.text() if header else None, link, pairs)]


def nutrition(url: str, html: str) -> list[tuple]:
    """(id, name, crawl_link, details) of each row of a nutrition table; the page's and the table's headings are its
    top and sub category."""
    root = tree(html)
    top, sub, out = None, None, []
    for node in root.walk():
        if node.tag in ("h1", "h2", "h3"):
            top, sub = node.text(), None
        elif node.tag == "h4":
            sub = node.text()
        elif node.tag == "table":
            headers = [n.text() for n in node.find("th")]
            for row in node.find("tr"):
                cells = row.find("td")
                if not cells or not headers:
                    continue
                pairs = dict(zip(headers, (c.text() for c in cells), strict=False))
                anchor = next((n for c in cells for n in c.find("a")), None)
                href = urljoin(url or "", anchor.attrs.get("href", "")) if anchor else None
                ident = re.search(r"/(\d+)\.\w+$", href or "")
                pairs |= {"top_cat": top or ""} | ({"sub_cat": sub} if sub else {})
                out.append((ident.group(1) if ident else None, cells[0].text(), href, pairs))
    return out


SCHEMAS: dict[Callable, str] = {
    links: "href string, resolved string, text string",
    key_values: "key string, value string",
    categories: "title string, link string, parent string, level int",
    paging: "page int, begin int, size int",
    thumbnails: "id string, name string, crawl_link string, img_url string, price string, weight string",
    details: "id string, page_name string, link string, details map<string,string>",
    nutrition: "id string, name string, crawl_link string, details map<string,string>",
}


def extract(pages: DataFrame, what: Callable, key: str = "page_id") -> DataFrame:
    """(page_id, n, ...): the records of each page, numbered in the page's order."""
    schema = f"{key} {dict(pages.dtypes)[key]}, n int, {SCHEMAS[what]}"
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = [(k, n, *r) for k, u, h in zip(some[key], some["url"], some["html"], strict=True) for n, r in enumerate(what(u, h))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(key, "url", "html").mapInPandas(run, schema)


def reconciled(thumbs: DataFrame, pages: DataFrame) -> DataFrame:
    """Grid products with their page's link and details; the page's name goes first if it has one.  ``complete`` tells
    whether id, name and price are all there.  The first of an id wins."""
    unique = first_wins(thumbs, "id", [F.col("page_id"), F.col("n")])
    other = first_wins(pages, "id", [F.col("page_id"), F.col("n")]).select("id", "page_name", "link", "details")
    joined = unique.join(other, "id", "left").withColumn("name", F.coalesce(F.nullif("page_name", F.lit("")), "name")).drop("page_name")
    return joined.withColumn("complete", F.coalesce(F.col("id") != "", F.lit(False)) & F.coalesce(F.col("name") != "", F.lit(False)) & F.coalesce(F.col("price") != "", F.lit(False)))


def nutrition_products(rows: DataFrame, dropped_top: str | None = None) -> DataFrame:
    """Nutrition rows as products with their categories as tags, but for one dropped top category."""
    kept = rows if dropped_top is None else rows.where(F.coalesce(F.try_element_at("details", F.lit("top_cat")), F.lit("")) != dropped_top)
    return kept.withColumn("tags", F.array_compact(F.array(F.try_element_at("details", F.lit("top_cat")), F.try_element_at("details", F.lit("sub_cat")))))
