"""Documents from HTML, JSON, XML and text bodies.

HTML has no parser in Spark, so one Arrow UDF per body returns the whole document, with white
space collapsed and secrets hidden in every text. Texts are cut to stated bounds, as the results
show.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canon
from tidemark.functions import text as tx
from tidemark.sources import markup

#: Bounds: characters of texts, entries of lists, JSON paths, depth, and children of a node.
VISIBLE, SECTION, FIELD, PLANS, HEADINGS, PATHS, DEPTH, CHILDREN = 50_000, 2_000, 500, 50, 100, 200, 8, 100
#: Selectors of the parts of a page.
PLAN = '[data-plan], .pricing-plan, [class*="pricing-plan"], .plan-card'
PLAN_NAME = 'h1, h2, h3, [class*="name"]'
PLAN_PRICE = '.price, [itemprop="price"], [data-price], [class*="price"]'
PLAN_STOCK = '.availability, [itemprop="availability"], [class*="stock"]'
TERMS = '.terms, [class*="terms"], [class*="policy"], [id*="terms"], [id*="policy"]'
CHANGELOG = '.changelog, [class*="changelog"], [class*="release-note"], [id*="changelog"]'
DROPPED = "script, style, noscript, template, svg, canvas, iframe"

_S = T.StringType()
_SECTIONS = T.ArrayType(T.StructType([T.StructField("heading", _S), T.StructField("text", _S)]))
OFFER_FIELDS = ("name", "sku", "gtin", "mpn", "brand", "model", "price", "priceCurrency", "availability", "url")
DOCUMENT = T.StructType(
    [
        T.StructField("title", _S),
        T.StructField("description", _S),
        T.StructField("canonical_url", _S),
        T.StructField("headings", T.ArrayType(_S)),
        T.StructField("visible_text", _S),
        T.StructField("selected_sections", T.ArrayType(T.StructType([T.StructField("selector", _S), T.StructField("text", _S)]))),
        T.StructField("product_offers", T.ArrayType(T.StructType([T.StructField(f, _S) for f in OFFER_FIELDS]))),
        T.StructField(
            "pricing_plans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", _S),
                        T.StructField("price_text", _S),
                        T.StructField("availability_text", _S),
                        T.StructField("features", T.ArrayType(_S)),
                        T.StructField("evidence", _S),
                    ]
                )
            ),
        ),
        T.StructField("policies", _SECTIONS),
        T.StructField("changelog", _SECTIONS),
    ]
)


def content_kind(content_type: Column) -> Column:
    """html, json, xml or text by the media type; null for others."""
    media = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    return (
        F.when(media.isin("text/html", "application/xhtml+xml"), "html")
        .when((media == "application/json") | media.endswith("+json"), "json")
        .when(media.isin("application/xml", "text/xml") | media.endswith("+xml"), "xml")
        .when(media == "text/plain", "text")
    )


#: Names of content encodings with the form of their header for zlib.
ENCODINGS = {"gzip": 31, "x-gzip": 31, "deflate": 15}


def decode_body(body: bytes | None, encoding: str | None, limit: int) -> tuple[bytes | None, str | None]:
    """Bytes of a body by its first listed content encoding, or why there are none.

    No more than ``limit`` bytes are ever unpacked, so a small body can't fill an executor.
    """
    if body is None:
        return None, None
    name = (encoding or "identity").split(",")[0].strip().lower() or "identity"
    if name == "identity":
        return (body, None) if len(body) <= limit else (None, "response_too_large")
    if name not in ENCODINGS:
        return None, "unsupported_encoding"
    unpacker = zlib.decompressobj(ENCODINGS[name])
    try:
        out = unpacker.decompress(body, limit + 1)
    except zlib.error:
        return None, "broken_encoding"
    if len(out) > limit:
        return None, "response_too_large"
    return (out, None) if unpacker.eof else (None, "broken_encoding")


def decoded(body: Column, encoding: Column, limit: int = 2 * 1024 * 1024) -> Column:
    """Struct (body, problem) of a binary column by its content encoding; the body is text."""
    schema = T.StructType([T.StructField("body", _S), T.StructField("problem", _S)])

    def batch(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        made = [decode_body(b, e, limit) for b, e in zip(bodies, encodings, strict=True)]
        rows = [(None if b is None else bytes(b).decode("utf-8", "replace"), p) for b, p in made]
        return pd.DataFrame(rows, columns=["body", "problem"], dtype=object)

    return F.pandas_udf(batch, schema)(body, encoding)


_SPACES = re.compile(tx.SPACES)


def _clean(value: str | None, limit: int) -> str:
    return canon.redact_text(_SPACES.sub(" ", value or "").strip(), limit)


def _safe_url(value: str | None) -> str | None:
    """A URL without user, fragment and values of secret keys; other text is cleaned."""
    if not value:
        return None
    try:
        u = urlsplit(value.strip())
        host = u.netloc.rpartition("@")[2]
    except ValueError:
        return _clean(value, 2_048)
    if not u.scheme:
        return _clean(value, 2_048)
    pairs = [
        (k, "[REDACTED]" if canon.SECRET_KEY.search(k) else canon.redact_text(v, 256))
        for k, v in parse_qsl(u.query, keep_blank_values=True)
    ]
    return urlunsplit((u.scheme, host, u.path, urlencode(pairs), ""))


def _scalar(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value) if isinstance(value, (str, int, float)) else None


def _offer(item: dict) -> dict:
    nested = item.get("offers")
    nested = nested[0] if isinstance(nested, list) and nested else nested
    nested = nested if isinstance(nested, dict) else {}
    brand = item.get("brand")
    pick = lambda *names: next((v for src, n in names if (v := src.get(n)) is not None), None)
    both = lambda n: pick((item, n), (nested, n))
    found = {
        "name": item.get("name"),
        "sku": item.get("sku"),
        "gtin": pick(*[(item, n) for n in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin")]),
        "mpn": item.get("mpn"),
        "brand": brand.get("name") if isinstance(brand, dict) else brand,
        "model": item.get("model"),
        "price": pick(*[(src, n) for src in (item, nested) for n in ("price", "lowPrice", "highPrice")]),
        "priceCurrency": both("priceCurrency"),
        "availability": both("availability"),
        "url": both("url"),
    }
    texts = {k: _scalar(v) or None for k, v in found.items()}
    return {k: v and (_safe_url(v) if k == "url" else canon.redact_text(v, FIELD)) for k, v in texts.items()}


def walked(value) -> Iterator:
    """All values within a JSON value, level by level, with the bounds of depth and children."""
    level = [value]
    for _ in range(DEPTH + 1):
        yield from level
        held = (v.values() if isinstance(v, dict) else v for v in level if isinstance(v, (dict, list)))
        level = [child for children in held for child in islice(children, CHILDREN)]


#: Bounds of linked data: blocks of a page, characters of a block, values and records of a block.
BLOCKS, BLOCK_SIZE, VISITED, RECORDS = 50, 131_072, 500, 20


def linked_data(root: markup.Node) -> list[dict]:
    """Products and offers in JSON-LD blocks, those nearer to the root first; bad blocks are skipped.

    An offer inside of a product belongs to the product and is no record of its own.
    """
    records: list[dict] = []
    for block in markup.select(root, 'script[type="application/ld+json"]')[:BLOCKS]:
        raw = block.text()
        if not raw or len(raw) > BLOCK_SIZE:
            continue
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            continue
        typed = [v for v in islice(walked(value), VISITED) if isinstance(v, dict) and "@type" in v]
        kinds = [set(v["@type"]) if isinstance(v["@type"], list) else {v["@type"]} for v in typed]
        inside = set()
        for v, kind in zip(typed, kinds, strict=True):
            if "Product" in kind:
                offers = v.get("offers")
                inside.add(id(offers[0] if isinstance(offers, list) and offers else offers))
        records += [
            _offer(v)
            for v, kind in zip(typed, kinds, strict=True)
            if "Product" in kind or (kind & {"Offer", "AggregateOffer"} and id(v) not in inside)
        ]
    return records[:RECORDS]


def html_document(html: str | None, base: str | None = None, include=(), exclude=()) -> dict | None:
    """The document of an HTML body; null of null."""
    if html is None:
        return None
    root = markup.parse(html)
    for selector in exclude:
        for node in markup.select(root, selector):
            node.remove()
    offers = linked_data(root)
    plans = []
    for node in markup.select(root, PLAN)[:PLANS]:
        heading = markup.first(node, PLAN_NAME)
        name = _clean(node.attrs.get("data-plan", heading.text() if heading else ""), 200)
        if not name:
            continue
        price, stock = markup.first(node, PLAN_PRICE), markup.first(node, PLAN_STOCK)
        features = [_clean(n.text(), FIELD) for n in markup.select(node, "li")]
        plans.append(
            {
                "name": name,
                "price_text": (_clean(price.text(), FIELD) or None) if price else None,
                "availability_text": (_clean(stock.text(), FIELD) or None) if stock else None,
                "features": [f for f in features if f][:CHILDREN],
                "evidence": _clean(node.text(), SECTION),
            }
        )

    def sections(selector: str) -> list[dict]:
        out = []
        for node in markup.select(root, selector)[:PLANS]:
            heading = markup.first(node, "h1, h2, h3")
            text = _clean(node.text(), SECTION)
            if text:
                out.append({"heading": (_clean(heading.text(), 300) or None) if heading else None, "text": text})
        return out

    policies, changelog = sections(TERMS), sections(CHANGELOG)
    title = markup.first(root, "title")
    description = markup.first(root, 'meta[name="description"]')
    canonical = markup.first(root, 'link[rel="canonical"]')
    href = canonical.attrs.get("href") if canonical else None
    for node in markup.select(root, DROPPED):
        node.remove()
    chosen = [
        {"selector": s, "text": _clean(" ".join(n.text() for n in markup.select(root, s)), 10_000)} for s in include
    ]
    chosen = [c for c in chosen if c["text"]]
    body = markup.first(root, "body")
    visible = " ".join(c["text"] for c in chosen) if include else (body.text() if body else "") or root.text()
    headings = [_clean(n.text(), FIELD) for n in markup.select(root, "h1, h2, h3")]
    return {
        "title": (_clean(title.text(), FIELD) or None) if title else None,
        "description": (_clean(description.attrs.get("content"), 1_000) or None) if description else None,
        "canonical_url": _safe_url(urljoin(base or "", href)) if href else None,
        "headings": [h for h in headings if h][:HEADINGS],
        "visible_text": _clean(visible, VISIBLE),
        "selected_sections": chosen,
        "product_offers": offers,
        "pricing_plans": plans,
        "policies": policies,
        "changelog": changelog,
    }


def _checked(include, exclude) -> tuple[tuple, tuple]:
    for selector in (*include, *exclude):
        if problem := markup.selector_problem(selector):
            raise ValueError(f"selector {selector!r}: {problem}")
    return tuple(include), tuple(exclude)


def with_html_document(df: DataFrame, html: str, url: str | None = None, include=(), exclude=()) -> DataFrame:
    """Adds ``document``, a struct with cleaned and redacted texts, for an HTML column."""
    return with_document(df.withColumn("kind_", F.lit("html")), html, "kind_", url, include, exclude).drop("kind_")


def body_document(body: str | None, kind: str | None, base: str | None = None, include=(), exclude=()) -> dict | None:
    """The document of a body of a kind that :func:`content_kind` gives; null of null or other kinds.

    JSON and XML have the texts of their scalars as visible text; if they can't be read there is
    no document.
    """
    if body is None or kind not in ("html", "json", "xml", "text"):
        return None
    if kind == "html":
        return html_document(body, base, include, exclude)
    if kind == "text":
        visible = body
    else:
        pairs = flatten_json(body) if kind == "json" else flatten_xml(body)
        if pairs is None:
            return None
        visible = " ".join("null" if v is None else v for _, v in pairs)
    lists = {n: [] for n in ("headings", "selected_sections", "product_offers", "pricing_plans", "policies", "changelog")}
    return {"title": None, "description": None, "canonical_url": None, "visible_text": _clean(visible, VISIBLE), **lists}


def with_document(df: DataFrame, body: str, kind: str, url: str | None = None, include=(), exclude=()) -> DataFrame:
    """Adds ``document``, a struct with cleaned and redacted texts, for a body column and its kind."""
    include, exclude = _checked(include, exclude)

    def batch(bodies: pd.Series, kinds: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = zip(bodies, kinds, urls, strict=True)
        made = [body_document(b, k, u, include, exclude) for b, k, u in rows]
        empty = dict.fromkeys(DOCUMENT.fieldNames())
        return pd.DataFrame([m or empty for m in made], columns=DOCUMENT.fieldNames(), dtype=object)

    udf = F.pandas_udf(batch, DOCUMENT)
    return df.withColumn("document", udf(F.col(body), F.col(kind), F.col(url) if url else F.lit(None).cast("string")))


def _entries(path: str, item) -> list[tuple[str, object]]:
    if isinstance(item, list):
        return [(f"{path}[{i}]", v) for i, v in enumerate(item[:CHILDREN])]
    named = [(k, v) for k, v in islice(item.items(), CHILDREN) if k not in canon.DROPPED]
    return [(f"{path}.{canon.redact_text(k, 128)}", v) for k, v in named]


def _shown(item) -> str | None:
    if isinstance(item, str):
        return canon.redact_text(item)
    if item is None or isinstance(item, bool):
        return None if item is None else json.dumps(item)
    return canon.number_text(float(item)) if math.isfinite(item) else None


def flatten(value, limit: int = PATHS) -> list[tuple[str, str | None]]:
    """Paths of the scalars of a JSON value, level by level, with their texts; secrets are hidden."""
    out: dict[str, str | None] = {}
    level: list[tuple[str, object]] = [("$", value)]
    for _ in range(DEPTH + 1):
        scalars = [(p, v) for p, v in level if not isinstance(v, (dict, list))]
        for path, item in scalars[: limit - len(out)]:
            out[path[:512]] = _shown(item)
        level = [entry for path, item in level if isinstance(item, (dict, list)) for entry in _entries(path, item)]
    return list(out.items())[:limit]


def flatten_json(text: str | None) -> list[tuple[str, str | None]] | None:
    """:func:`flatten` of a JSON text; null if it is none."""
    try:
        return None if text is None else flatten(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _element(node: ElementTree.Element):
    children = [c for c in node if isinstance(c.tag, str)]
    text = (node.text or "").strip()
    if not children and not node.attrib:
        return text
    out: dict = {f"@_{k}": v for k, v in node.attrib.items()}
    for child in children:
        made = _element(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), made]
        else:
            out[child.tag] = made
    if text:
        out["#text"] = text
    return out


def flatten_xml(text: str | None) -> list[tuple[str, str | None]] | None:
    """Paths of an XML text, attributes with the prefix @_; documents with a DTD are refused."""
    if text is None or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    return flatten({root.tag: _element(root)})


def with_paths(df: DataFrame, body: str, kind: str = "json") -> DataFrame:
    """Explodes a JSON or XML column into rows (…, path, value); unreadable bodies have no rows."""
    parse = {"json": flatten_json, "xml": flatten_xml}[kind]

    def batch(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"path": p, "value": v} for p, v in (parse(b) or [])])

    schema = T.ArrayType(T.StructType([T.StructField("path", _S), T.StructField("value", _S)]))
    udf = F.pandas_udf(batch, schema)
    return df.withColumn("pair_", F.explode(udf(F.col(body)))).select(
        *df.columns, F.col("pair_.path").alias("path"), F.col("pair_.value").alias("value")
    )


def text_document(body: Column) -> Column:
    return tx.clean(body, VISIBLE)


def read_bodies(spark: SparkSession, folder: str, limit: int = 2 * 1024 * 1024) -> DataFrame:
    """Files as (path, body, problem); ``length`` is checked before contents are read."""
    files = spark.read.format("binaryFile").load(folder)
    fine = F.col("length") <= limit
    return files.select(
        "path",
        F.when(fine, F.make_valid_utf8(F.col("content").cast("string"))).alias("body"),
        F.when(~fine, F.lit("response_too_large")).alias("problem"),
    )
