"""Items of feed documents that are not well-formed: what a strict parser gives up on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sections that entities have no meaning in, references that XML knows, and characters that it doesn't allow.
_VERBATIM = re.compile(r"(<!\[CDATA\[.*?\]\]>|<!--.*?-->)", re.DOTALL)
_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9A-Fa-f]+|amp|lt|gt|quot|apos);|([A-Za-z][A-Za-z0-9]*;)?)")
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_DECLARED = re.compile(r"^\s*<\?xml[^>]*\?>")

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "published", "description")])
RECOVERED = T.StructType([T.StructField("items", T.ArrayType(ITEM)), T.StructField("defect", T.StringType())])


def _known_reference(found: re.Match) -> str:
    if found[1]:
        return found[0]
    if found[2]:
        meant = html.unescape(found[0])
        if meant != found[0]:
            return html.escape(meant)
    return "&amp;" + found[0][1:]


def repaired(xml: str) -> str:
    """Ampersands that begin no reference stand for themselves, named references of HTML for their characters."""
    parts = _VERBATIM.split(_NOT_XML.sub("", _DECLARED.sub("", xml, count=1)))
    return "".join(p if i % 2 else _REFERENCE.sub(_known_reference, p) for i, p in enumerate(parts))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _fields(item: ElementTree.Element) -> tuple[str | None, ...]:
    found: dict[str, str | None] = {}
    links = []
    for child in item:
        name = _local(child.tag)
        text = "".join(child.itertext()).strip() or None
        if name == "link" and (_local(item.tag) == "entry"):
            if child.get("rel") in (None, "alternate"):
                links.append(child.get("href"))
        else:
            found.setdefault(name, text)
    link = links[0] if links else found.get("link")
    published = found.get("pubDate") or found.get("date") or found.get("published") or found.get("updated")
    return found.get("title"), link, published, found.get("description") or found.get("summary")


def _elements(parser: ElementTree.XMLPullParser, xml: str) -> Iterator[ElementTree.Element]:
    parser.feed(xml)
    for _, element in parser.read_events():
        yield element
    parser.close()


def recovered(xml: str | None) -> tuple[list[tuple[str | None, ...]], str | None] | None:
    """(items, defect): every item that ends before the first defect, which is None where repairs were enough."""
    if xml is None:
        return None
    parser = ElementTree.XMLPullParser(("end",))
    items: list[tuple[str | None, ...]] = []
    try:
        for element in _elements(parser, repaired(xml)):
            if _local(element.tag) in ("item", "entry"):
                items.append(_fields(element))
                element.clear()
    except ElementTree.ParseError as defect:
        return items, str(defect)
    return items, None


@F.pandas_udf(RECOVERED)
def recovered_batch(xml: pd.Series) -> pd.DataFrame:
    found = [recovered(x) or (None, None) for x in xml]
    return pd.DataFrame(
        {
            "items": [None if items is None else [dict(zip(ITEM.names, i, strict=True)) for i in items] for items, _ in found],
            "defect": [defect for _, defect in found],
        }
    )
