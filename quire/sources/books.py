"""Book scans: directories of files, EPUB, HTML and Markdown, all as tables of chapters (path, ordinal, title, text).

Archives are read inside tasks from Spark's binary scan; nothing is unpacked to disk. What cannot be read gives a row
with an ``error`` instead of failing the job. PDF and MOBI need parsers that are not part of this library: a parser is a
function bytes -> [(title, text)] registered by format.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_title, file_format, strip

Parser = Callable[[bytes], list[tuple[str, str]]]

#: Parts of a page that are not text, and those that end a line.
SKIPPED = {"script", "style", "nav", "header", "footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: Fewer characters than this make a chapter short.
SHORT = 100


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping, self.parts, self.title, self.heading = [], [], "", None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping.append(tag)
        elif tag in ("h1", "h2", "h3") and not self.title:
            self.heading = ""

    def handle_endtag(self, tag):
        if tag in self.skipping:
            while self.skipping.pop() != tag:
                pass
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            words = " ".join(self.heading.split())
            self.title, self.heading = (words if len(words) > 2 else ""), None

    def handle_data(self, data):
        if self.skipping:
            return
        if self.heading is not None:
            self.heading += data
        if data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text): the first heading of over two characters, and the stripped text nodes joined by newlines."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return p.title, "\n".join(p.parts)


def read_epub(data: bytes) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Metadata and chapters of an EPUB in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(root))
        base = posixpath.dirname(root)
        meta: dict[str, str] = {}
        items, spine = {}, []
        for e in package.iter():
            name = e.tag.rpartition("}")[2]
            if "purl.org/dc" in e.tag and e.text and e.text.strip():
                meta.setdefault(name, e.text.strip())
            elif name == "item" and "html" in (e.get("media-type") or ""):
                items[e.get("id")] = posixpath.normpath(posixpath.join(base, unquote(e.get("href"))))
            elif name == "itemref":
                spine.append(e.get("idref"))
        paths = [items[i] for i in spine if i in items] or list(items.values())
        return meta, [html_text(z.read(p).decode("utf-8", "replace")) for p in paths]


def failure_kind(message: Column | str) -> Column:
    """What went wrong with a file, by its message."""
    m = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    kinds = [("encrypted", "encrypt|password|drm"), ("memory", "memory"), ("missing", "no such file|not found|keyerror"), ("permission", "permission|denied"), ("corrupt", "corrupt|damaged|badzipfile|not a zip|truncated|parseerror")]
    out = F.when(m == "", F.lit(None).cast("string"))
    for kind, pattern in kinds:
        out = out.when(m.rlike(pattern), kind)
    return out.otherwise("format")


def files(spark: SparkSession, path: str, glob: str = "*.{epub,pdf,mobi,azw,azw3}") -> DataFrame:
    """(path, format, length, md5, content) of the book files under ``path``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", file_format("path").alias("format"), "length", F.md5("content").alias("md5"), "content")


def chapters(book_files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, metadata, ordinal, title, text, short, error) of every chapter of files (path, format, content)."""
    parsers = dict(parsers or {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, kind, content in zip(*(c.to_pylist() for c in b.columns)):
                name = posixpath.splitext(posixpath.basename(path))[0]
                try:
                    if kind in parsers:
                        meta, parts = {}, parsers[kind](content)
                    elif kind == "epub":
                        meta, parts = read_epub(content)
                    else:
                        raise ValueError(f"no parser for format {kind}")
                    meta = {"title": name, **meta}
                    rows += [(path, list(meta.items()), i, t or f"{name} {i + 1}", x, len(x) < SHORT, None) for i, (t, x) in enumerate(parts)]
                except Exception as e:  # any damage of one file becomes that file's row
                    rows.append((path, [("title", name)], 0, name, "", True, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "metadata", "ordinal", "title", "text", "short", "error"])

    schema = "path string, metadata map<string,string>, ordinal int, title string, text string, short boolean, error string"
    return book_files.select("path", "format", "content").mapInArrow(read, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, title, text) of pages (page_id, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [html_text(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in both], pa.string()), pa.array([x for _, x in both], pa.string())], names=["page_id", "title", "text"])

    return pages.select("page_id", "html").mapInArrow(read, "page_id long, title string, text string")


def markdown_chapters(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, title, text) of Markdown texts cut at second-level headings; lines before the first are left out.

    A text without such a heading is one chapter without a title. The cut is a split inside the row: no shuffle.
    """
    parts = F.split(F.coalesce("text", F.lit("")), "(?m)^(?=## )")
    found = F.filter(parts, lambda p: p.startswith("## "))
    cells = F.transform(found, lambda p, i: F.struct(i.alias("ordinal"), clean_title(F.regexp_extract(p, "^## ([^\\n]*)", 1)).alias("title"), strip(F.regexp_replace(p, "^## [^\\n]*\\n?", "")).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text")))
    return docs.select(key, F.inline(F.when(F.size(found) > 0, cells).otherwise(whole)))


def front_matter(x: Column | str, field: str) -> Column:
    """A field of a Markdown text's front matter, null where absent."""
    x = F.col(x) if isinstance(x, str) else x
    head = F.regexp_extract(F.coalesce(x, F.lit("")), "(?s)^---\\n(.*?)\\n---", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, f"(?m)^{field}:[ \\t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))


def vault(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Book documents in JSON files under ``path``, unwrapped from a ``data`` envelope; summaries and mind maps are left out."""
    raw = spark.read.schema(f"{schema}, data struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(schema))}>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    names = [f.strip().split(" ", 1)[0] for f in _fields(schema)]
    kept = raw.withColumn("path", F.input_file_name()).where(~F.col("path").rlike("_summary|\\.mindmap"))
    return kept.select("path", *(F.coalesce(F.col(f"data.{n}"), F.col(n)).alias(n) for n in names))


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, text) of lines (key, line, text) put together where a line has no end mark and the next goes on in lower
    case or Han."""
    w = Window.partitionBy(key).orderBy("line")
    before = F.lag("text").over(w)
    goes_on = before.isNotNull() & ~before.rlike("[.!?。！？；;:：]\\s*$") & F.col("text").rlike("^\\s*[a-z\\u4e00-\\u9fff]")
    marked = lines.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    return marked.groupBy(key, "part").agg(joined.alias("text"))


def without_running_heads(lines: DataFrame, key: str = "doc_id", short: int = 50, often: int = 3) -> DataFrame:
    """Lines (key, line, text) without those shorter than ``short`` that a document has more than ``often`` times."""
    t = F.trim("text")
    n = F.count(F.lit(1)).over(Window.partitionBy(key, t))
    return lines.withColumn("_n", n).where(~((F.length(t) < short) & (F.length(t) > 0) & (F.col("_n") > often))).drop("_n")
