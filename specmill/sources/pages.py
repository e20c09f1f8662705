"""Web pages as rows: title, canonical address, links, structured products, embedded JSON, pagination, documents, text blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_arabic
from ..functions.url import resolve_one

LINK = "struct<uri:string,label:string>"
OFFER = "struct<price:string,currency:string,availability:string,uri:string>"
PRODUCT = f"struct<name:string,description:string,mpn:string,sku:string,brand:string,offers:array<{OFFER}>>"
DOCUMENT = "struct<uri:string,label:string,media_type:string,linked_identity:string>"
SCHEMA = (
    f"page_id bigint, url string, title string, canonical_url string, visible_text string, links array<{LINK}>, products array<{PRODUCT}>, embedded_json array<string>, "
    f"pagination array<{LINK}>, documents array<{DOCUMENT}>, skipped_json int, text_blocks array<string>"
)
DOCUMENT_ENDINGS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".rtf", ".txt")
HIDDEN = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "main", "ul", "ol", "table", "title", "body"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict[str, str]]] = []
        self.title = ""
        self.canonical: str | None = None
        self.scripts: list[tuple[str, str]] = []
        self.links: list[tuple[dict[str, str], str, bool]] = []
        self.blocks: list[list[str]] = [[]]
        self.anchor: list[str] | None = None
        self.anchor_attrs: dict[str, str] = {}
        self.identities: list[str | None] = [None]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "link":
            if a.get("rel", "").lower() == "canonical":
                self.canonical = a.get("href")
            elif a.get("rel", "").lower() in ("next", "prev"):
                self.links.append((a, "", True))
        if tag in BLOCKS:
            self.blocks.append([])
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        if tag == "a":
            self._end_anchor()
            self.anchor, self.anchor_attrs = [], a
        if tag == "script":
            self.scripts.append((a.get("type", "").lower(), ""))
        self.open.append((tag, a))
        self.identities.append(a.get("data-product-id") or a.get("data-sku") or a.get("data-mpn") or self.identities[-1])

    def _end_anchor(self) -> None:
        if self.anchor is not None:
            paged = any("pag" in (x.get("class", "") + " " + x.get("aria-label", "")).lower() for _, x in self.open) or self.anchor_attrs.get("rel", "").lower() in ("next", "prev")
            self.links.append(({**self.anchor_attrs, "_identity": self.identities[-1] or ""}, " ".join("".join(self.anchor).split()), paged))
            self.anchor = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end_anchor()
        if tag in BLOCKS:
            self.blocks.append([])
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:], self.identities[k + 1 :]
                break

    def handle_data(self, data: str) -> None:
        names = [t for t, _ in self.open]
        if names and names[-1] == "script":
            kind, text = self.scripts[-1]
            self.scripts[-1] = (kind, text + data)
        if HIDDEN & set(names):
            return
        if "title" in names:
            self.title += data
            return
        if self.anchor is not None:
            self.anchor.append(data)
        self.blocks[-1].append(data)


def _text(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("name") or value.get("@value")
    return None if value is None or isinstance(value, list | dict) else str(value)


def product_nodes(roots: list[object]) -> tuple[list[dict], dict[str, dict]]:
    """SCA-43, JN-20, AGG-20: nodes of type Product, and the definitions of ``@id``, of which the fullest stands."""
    found, named, todo = [], {}, list(reversed(roots))
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            kinds = node.get("@type")
            key = node.get("@id")
            if isinstance(key, str):
                rank = lambda n: (len(n), json.dumps(n, sort_keys=True))
                if len(node) > 1 and (key not in named or rank(node) > rank(named[key])):
                    named[key] = node
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                found.append(node)
            todo.extend(v for v in reversed(node.values()) if isinstance(v, list | dict))
    return found, named


def offers_of(node: dict, named: dict[str, dict], base: str | None) -> list[dict]:
    out = []
    raw = node.get("offers")
    for offer in raw if isinstance(raw, list) else [raw]:
        if isinstance(offer, dict) and set(offer) == {"@id"}:
            offer = named.get(offer["@id"], {})
        if not isinstance(offer, dict):
            continue
        specs = offer.get("priceSpecification")
        for spec in specs if isinstance(specs, list) else [specs or offer]:
            spec = spec if isinstance(spec, dict) else offer
            out.append({"price": _text(spec.get("price", offer.get("price"))), "currency": _text(spec.get("priceCurrency", offer.get("priceCurrency"))), "availability": _text(offer.get("availability")), "uri": resolve_one(base, _text(offer.get("url")))})
    return out


def product_like(value: object) -> list[dict]:
    """SCA-42: objects anywhere in JSON that have a name and an identifier."""
    out, todo = [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            if any(_text(node.get(k)) for k in ("name", "title", "productName")) and any(_text(node.get(k)) for k in ("mpn", "model", "productId", "sku")):
                out.append(node)
            todo.extend(v for v in reversed(node.values()) if isinstance(v, list | dict))
    return out


def first_of_each(rows: list[dict], key: str = "uri") -> list[dict]:
    """SRT-11."""
    return list({r[key]: r for r in reversed(rows)}.values())[::-1]


def read_page(page_id: int | None, url: str | None, html: str | None) -> tuple:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    base = resolve_one(url, reader.canonical) or resolve_one(url, url) or url
    links, paged, documents = [], [], []
    for attrs, label, is_paged in reader.links:
        uri = resolve_one(url, attrs.get("href"))
        if uri is None:
            continue
        if uri.split("?")[0].lower().endswith(DOCUMENT_ENDINGS):
            documents.append({"uri": uri, "label": label, "media_type": attrs.get("type") or None, "linked_identity": attrs.get("_identity") or None})
        elif is_paged:
            paged.append({"uri": uri, "label": label})
        else:
            links.append({"uri": uri, "label": label})
    roots, embedded, skipped = [], [], 0
    for kind, text in reader.scripts:
        if "json" not in kind:
            continue
        try:
            value = json.loads(text)
        except ValueError:
            skipped += 1
            continue
        (roots if kind == "application/ld+json" else embedded).append(value if kind == "application/ld+json" else text)
    nodes, named = product_nodes(roots)
    products = [{"name": _text(n.get("name")), "description": _text(n.get("description")), "mpn": _text(n.get("mpn")), "sku": _text(n.get("sku")), "brand": _text(n.get("brand")), "offers": offers_of(n, named, url)} for n in nodes]
    blocks = list(dict.fromkeys(b for b in (" ".join("".join(x).split()) for x in reader.blocks) if b))
    return page_id, url, " ".join(reader.title.split()) or None, base, " ".join(blocks), first_of_each(links), products, embedded, first_of_each(paged), first_of_each(documents), skipped, blocks


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.strip().split(" ")[0] for x in "page_id,url,title,canonical_url,visible_text,links,products,embedded_json,pagination,documents,skipped_json,text_blocks".split(",")]
    for batch in batches:
        rows = [read_page(*r) for r in zip(batch["page_id"], batch["url"], batch["html"], strict=True)]
        yield pd.DataFrame(rows, columns=names)


def parse_pages(pages: DataFrame) -> DataFrame:
    """SRC-12, SCA-35 to SCA-37: (page_id, url, html) as parsed pages. Pages are independent; nothing is shuffled."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(_batches, SCHEMA).withColumn("has_arabic", has_arabic(F.col("visible_text")))
