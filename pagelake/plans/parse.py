"""From html to typed columns: one Arrow crossing per page, whatever features are asked for.

``extract(pages, "links", "title")`` adds a column per feature. The tree is built once in the Python worker
and only the asked-for records come back, so neither trees nor unused features cross the boundary; all that follows
(filters, windows, joins, aggregates) is Catalyst's. Pages that are null give null features.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass
from typing import Any, Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.url_join import parse_url
from ..operators import contacts, content, feeds, fingerprint, forms, links, media, metadata, pagination, readability
from ..operators.alike import Alike
from ..operators.dom import Document, outer_html
from .config import MediaConfig, ParserConfig


@dataclass(frozen=True)
class Feature:
    """Something read from a parsed page: a function of (document, base) and its type as DDL.

    ``alike``: it doesn't depend on the base, nor on digits in the sense of operators.alike.
    """

    read: Callable[[Document, Any], Any]
    ddl: str
    alike: bool = False


FEATURES: dict[str, Feature] = {
    "metadata": Feature(metadata.metadata, metadata.SCHEMA),
    "title": Feature(lambda d, b: metadata.title(d), "string"),
    "language": Feature(lambda d, b: metadata.language(d), "string"),
    "charset": Feature(lambda d, b: metadata.charset(d), "string"),
    "structured_data": Feature(metadata.structured_data, metadata.STRUCTURED),
    "links": Feature(links.links, links.SCHEMA),
    "link_candidates": Feature(links.link_candidates, links.CANDIDATES),
    "raw_text": Feature(content.main_text, "string"),
    "headings": Feature(content.headings, f"array<{content.HEADING}>"),
    "main_heading": Feature(content.main_heading, content.HEADING),
    "outline": Feature(content.outline, content.OUTLINE),
    "paragraphs": Feature(content.paragraphs, "array<string>"),
    "lists": Feature(content.lists, content.LISTS),
    "tables": Feature(content.tables, content.TABLES),
    "code_blocks": Feature(content.code_blocks, content.CODE),
    "quotes": Feature(content.quotes, content.QUOTES),
    "images": Feature(content.images, content.IMAGES),
    "stats": Feature(content.stats, content.STATS),
    "forms": Feature(forms.forms, forms.SCHEMA, alike=True),
    "has_forms": Feature(lambda d, b: "form" in d.by_tag, "boolean", alike=True),
    "pagination": Feature(pagination.pagination, pagination.SCHEMA),
    "has_pagination": Feature(pagination.has_pagination, "boolean"),
    "next_page": Feature(pagination.next_page, "string"),
    "prev_page": Feature(pagination.prev_page, "string"),
    "contacts": Feature(contacts.contacts, contacts.SCHEMA),
    "contact_page": Feature(contacts.contact_page, "string"),
    "feeds": Feature(feeds.feeds, feeds.FEEDS),
    "sitemaps": Feature(feeds.sitemaps, feeds.SITEMAPS),
    "fingerprint": Feature(fingerprint.fingerprint, fingerprint.SCHEMA),
    "amp": Feature(fingerprint.amp, fingerprint.AMP),
    "cache_hints": Feature(fingerprint.cache_hints, fingerprint.CACHE),
    "media": Feature(media.media, media.SCHEMA),
    "media_images": Feature(media.images, media.IMAGES),
    "media_videos": Feature(media.videos, media.VIDEOS),
    "media_audio": Feature(media.audio, media.AUDIO),
    "media_documents": Feature(media.documents, media.DOCS),
    "media_embeds": Feature(media.embeds, media.EMBEDS),
    "has_media": Feature(media.has_media, media.HAS),
    "article": Feature(readability.article, readability.SCHEMA),
    "html_again": Feature(lambda d, b: outer_html(d.root), "string"),
}


def selected_links(selector: str, kind: str = "css", absolute: bool = False) -> Feature:
    """Hrefs of a selector's matches, distinct; with ``absolute``, resolved and distinct again."""

    def read(doc, base):
        found = links.select_links(doc, selector, kind)
        return links.absolute(found, base) if absolute else found

    return Feature(read, "array<string>")


def texts(selector: str) -> Feature:
    """Non-empty trimmed text of every match."""
    return Feature(lambda d, b: [t for n in d.select(selector) if (t := n.joined())], "array<string>")


def attributes(selector: str, name: str) -> Feature:
    """Non-empty values of an attribute of every match."""
    return Feature(lambda d, b: [v for n in d.select(selector) if (v := n.attrs.get(name))], "array<string>")


def first_text(selector: str) -> Feature:
    """Text nodes of the first match joined by line breaks, empty without a match."""
    return Feature(lambda d, b: n.joined("\n") if (n := d.first(selector)) is not None else "", "string")


def readable(selector: str) -> Feature:
    return Feature(lambda d, b: readability.readable_or_selected(d, selector), "string")


def elements(selector: str, kind: str = "css") -> Feature:
    """Every match as (index, name, text, attrs, html): the rows that element hooks work on."""

    def read(doc, base):
        found = doc.select(selector) if kind == "css" else doc.xpath(selector)
        out = []
        for k, n in enumerate(found):
            if isinstance(n, tuple):
                out.append({"index": k, "name": n[1], "text": n[2], "attrs": {n[1]: n[2]}, "html": None})
            elif not isinstance(n, str):
                out.append({"index": k, "name": n.tag, "text": n.joined(), "attrs": dict(n.attrs), "html": outer_html(n)})
        return out

    return Feature(read, "array<struct<index:int,name:string,text:string,attrs:map<string,string>,html:string>>")


def children(parent: str, selector: str, attr: str | None = None) -> Feature:
    """For every match of ``parent``, the non-empty texts (or attribute values) of its descendants by ``selector``."""

    def read(doc, base):
        out = []
        for p in doc.select(parent):
            found = doc.select(selector, p)
            out.append([v for n in found if (v := n.attrs.get(attr) if attr else n.joined())])
        return out

    return Feature(read, "array<array<string>>")


def media_feature(config: MediaConfig) -> Feature:
    return Feature(lambda d, b: media.media(d, b, config), media.SCHEMA)


def text_feature(config: ParserConfig) -> Feature:
    more, least = config.content_selectors, config.min_paragraph_length
    return Feature(lambda d, b: content.main_text(d, b, more, least), "string")


def _plain(kind: pa.DataType):
    """What turns a value into one that pyarrow takes: maps as lists of pairs, decimals as text-exact numbers. None where values can stay."""
    if pa.types.is_map(kind):
        return lambda v: None if v is None else list(v.items())
    if pa.types.is_decimal(kind):
        import decimal

        return lambda v: None if v is None else decimal.Decimal(v)
    if pa.types.is_list(kind) and (inner := _plain(kind.value_type)):
        return lambda v: None if v is None else list(map(inner, v))
    if pa.types.is_struct(kind):
        inner = {f.name: turn for f in kind if (turn := _plain(f.type))}
        if inner:
            return lambda v: None if v is None else v | {n: turn(v.get(n)) for n, turn in inner.items()}
    return None


#: Pages of a batch that goes to Python, and bytes of a batch after which a worker gives freed memory back: what it holds doesn't grow with a task.
PAGE_ROWS, TRIMMED = 500, 1 << 20


def page_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most PAGE_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= PAGE_ROWS:
        spark.conf.set(key, PAGE_ROWS)


def _trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def extract(
    pages: DataFrame, *names: str, html: str = "html", base: str | None = "url", fragment: bool = False, **features: Feature
) -> DataFrame:
    """``pages`` with a column for each named feature of FEATURES and each feature given by keyword.

    ``base`` names the column against which links are resolved (None: there is none). A page that is null gives
    nulls; existing columns of a feature's name are replaced.
    """
    wanted = {n: FEATURES[n] for n in names} | features
    page_batches(pages.sparkSession)
    ddl = "struct<" + ",".join(f"`{n}`:{f.ddl}" for n, f in wanted.items()) + ">"
    spark_type = T._parse_datatype_string(ddl)
    arrow_type = to_arrow_type(spark_type)
    readers = [(n, f.read, _plain(arrow_type.field(n).type)) for n, f in wanted.items()]

    alike, worker = all(f.alike for f in wanted.values()), {}

    def record(text: str, at=None) -> dict:
        doc = Document(text, fragment)
        out = {n: turn(read(doc, at)) if turn else read(doc, at) for n, read, turn in readers}
        doc.free()
        return out

    @F.arrow_udf(spark_type)
    def parse(page: pa.Array, url: pa.Array) -> pa.Array:
        kept = worker.setdefault("alike", Alike(record)) if alike else None
        rows = []
        collecting = gc.isenabled()
        gc.disable()  # trees are taken apart, so there is nothing to search for but trees again and again
        try:
            if alike:
                rows = [None if text is None else kept(text) for text in page.to_pylist()]
            else:
                for text, where in zip(page, url):
                    text = text.as_py()
                    rows.append(None if text is None else record(text, parse_url(where.as_py())))
            out = pa.array(rows, arrow_type)
            if page.nbytes > TRIMMED:
                rows.clear()
                _trim()
            return out
        finally:
            if collecting:
                gc.enable()

    # marked so that no optimizer rule (such as the filter that Generate implies) evaluates it a second time
    parse = parse.asNondeterministic()
    where = F.col(base).cast("string") if base else F.lit(None).cast("string")
    found = pages.withColumn("_parsed", parse(F.col(html).cast("string"), where))
    return found.withColumns({n: F.col("_parsed").getField(n) for n in wanted}).drop("_parsed")


PARTS = ("metadata", "headings", "paragraphs", "lists", "quotes", "stats")


def parse_pages(pages: DataFrame, config: ParserConfig | None = None, html: str = "html", base: str | None = "url", fragment: bool = False) -> DataFrame:
    """``pages`` with the whole parsed record; what the configuration turns off is an empty array.

    Fragments carry neither metadata nor structured data.
    """
    from ..functions import text as words

    config = config or ParserConfig()
    optional = {
        "links": config.extract_links, "images": config.extract_images, "tables": config.extract_tables,
        "code_blocks": config.extract_code_blocks, "structured_data": config.extract_structured_data and not fragment,
    }
    on = [n for n in PARTS if not (fragment and n == "metadata")] + [n for n, yes in optional.items() if yes]
    if config.min_paragraph_length != 20:
        on.remove("paragraphs")
    extra = {"raw_text": text_feature(config)}
    if config.min_paragraph_length != 20:
        least = config.min_paragraph_length
        extra["paragraphs"] = Feature(lambda d, b: content.paragraphs(d, b, least), "array<string>")
    out = extract(pages, *on, html=html, base=base, fragment=fragment, **extra)
    for n, yes in optional.items():
        if not yes:
            out = out.withColumn(n, F.array().cast(FEATURES[n].ddl))
    return out.withColumn("text", words.text_content(F.col("raw_text"), config.compute_readability)).drop("raw_text")


def parsed_column(spark: SparkSession):
    """Names and types of the record, for schemas of tables that hold it."""
    return {n: T._parse_datatype_string(f.ddl) for n, f in FEATURES.items()}


def has_structured_data(structured):
    return F.size(structured) > 0
