"""Files of many formats to Markdown: a branch for each tool, and branches for what another one failed on.

A converter takes rows (path, content) and returns rows (path, text, error).  Files are
routed by their suffix; each branch is stored, so nothing is converted twice, and the
files that it failed on are read again by the branch that its fallback names.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.sources.files import plain_html
from quizloom.sources.scratch import store

Converter = Callable[[DataFrame], DataFrame]
#: Files that a task hands on at once, and characters of an error that are kept.
SLICE, ERROR_CHARS = 64, 1000


def by_file(one: Callable[[PurePosixPath, bytes], str]) -> Converter:
    """A converter from a function of a path and its bytes; what that raises is the file's error."""

    def attempt(path: str, content: bytes | None) -> tuple[str | None, str | None]:
        try:
            if content is None:
                raise ValueError("no content")
            return one(PurePosixPath(path or ""), content), None
        except Exception as problem:  # noqa: BLE001  any failure of a file is a result
            return None, (str(problem) or type(problem).__name__)[:ERROR_CHARS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                done = [attempt(p.as_py(), c.as_py()) for p, c in zip(some.column("path"), some.column("content"), strict=True)]
                texts, errors = ([d[k] for d in done] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([some.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return lambda rows: rows.select("path", "content").mapInArrow(run, "path string, text string, error string")


def _decoded(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


class _Blocks(HTMLParser):
    """A page as Markdown blocks: headings, list items and paragraphs, in order."""

    BREAKS = frozenset("address article aside blockquote body dd div dl dt fieldset footer form header hr html main nav ol p pre section table td th tr ul".split())
    HIDDEN = frozenset(("script", "style", "template", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.closed, self.mark, self.pieces, self.blocks = 0, False, "", [], []

    def _flush(self, mark: str = "") -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(self.mark + text)
        self.mark, self.pieces = mark, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._flush("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._flush("- ")
        elif tag in self.BREAKS:
            self._flush()
        elif tag == "br":
            self.pieces.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        self.closed = self.closed or tag == "html"
        if tag in self.BREAKS or tag == "li" or tag[:1] == "h" and tag[1:].isdigit():
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)


def structured_html(path: PurePosixPath, content: bytes) -> str:
    """Headings, items and paragraphs; an error where the page isn't whole."""
    parser = _Blocks()
    parser.feed(_decoded(content))
    parser.close()
    if not parser.closed or parser.hidden:
        raise RuntimeError(f"the page ends before it is closed: {path.name}")
    parser._flush()
    return "\n\n".join(parser.blocks)


def html_document(path: PurePosixPath, content: bytes) -> str:
    """The title, or the file's stem, and the visible texts of any page."""
    title, body = plain_html(_decoded(content))
    return f"# {path.stem if title is None else title}\n\n{body}"


def table_document(path: PurePosixPath, content: bytes) -> str:
    """CSV, or TSV by the suffix, with a header."""
    rows = list(csv.reader(io.StringIO(_decoded(content)), delimiter="\t" if path.suffix.lower() == ".tsv" else ","))
    if not rows:
        raise ValueError("no columns to read")
    width = len(rows[0])
    if any(len(r) > width for r in rows):
        raise ValueError(f"a row has more than {width} fields")
    body = [[*r, *[""] * (width - len(r))] for r in rows[1:] if r]
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in [rows[0], ["---"] * width, *body]]
    return f"## {path.stem}\n\n" + ("\n".join(lines) if body else "(No rows found)")


def sheets_document(path: PurePosixPath, content: bytes) -> str:
    """Every sheet of a workbook; needs pandas' reader for the format on the executors."""
    import pandas as pd

    sheets = pd.read_excel(io.BytesIO(content), sheet_name=None)
    parts = [table_document(PurePosixPath(f"{name}.csv"), sheet.to_csv(index=False).encode()) for name, sheet in sheets.items()]
    return "\n\n".join(parts)


def xml_document(path: PurePosixPath, content: bytes) -> str:
    """The file's stem, and a heading for every element with text and all text below it.  A document type is refused, since entities may expand without bound."""
    raw = _decoded(content)
    if "<!doctype" in raw.lower():
        raise ValueError("a document type isn't read")
    lines = [f"# {path.stem}"]
    for e in ElementTree.fromstring(raw).iter():
        whole = " ".join(t for t in (" ".join(x.split()) for x in e.itertext()) if t)
        if whole:
            lines.append(f"## {str(e.tag).rpartition('}')[2]}\n\n{whole}")
    return "\n\n".join(lines)


def document(path: PurePosixPath, content: bytes) -> str:
    """Texts as they are and whole pages; other formats need a converter of their own in this one's place."""
    end = path.suffix.lower()
    if end in (".html", ".htm"):
        return structured_html(path, content)
    if end in (".txt", ".md", ".mmd", ".markdown"):
        return _decoded(content)
    raise RuntimeError(f"no converter for {end}")


def _table_or_sheets(path: PurePosixPath, content: bytes) -> str:
    return table_document(path, content) if path.suffix.lower() in (".csv", ".tsv") else sheets_document(path, content)


CONVERTERS: dict[str, Converter] = {
    "convert_with_pandoc": by_file(document),
    "convert_tabular_document": by_file(_table_or_sheets),
    "convert_xml_document": by_file(xml_document),
    "convert_html_with_fallback": by_file(html_document),
}
#: The tool that takes the files of a suffix that another tool failed on.
FALLBACKS = {("convert_with_pandoc", ".html"): "convert_html_with_fallback", ("convert_with_pandoc", ".htm"): "convert_html_with_fallback"}


def convert(files: DataFrame, converters: dict[str, Converter] | None = None, fallbacks: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """files: path, content.  Each with suffix, tool (that made its text, or was tried last), text, status (completed or failed), error and tried.

    Defined results: a suffix without a tool, a tool without a converter, a null content and a null path fail;
    repeated paths are converted each by itself, and each takes the fallback that the path needs.
    """
    converters = CONVERTERS if converters is None else converters
    fallbacks = FALLBACKS if fallbacks is None else fallbacks
    routed = files.select("path", "content", T.suffix(F.col("path")).alias("suffix"), T.conversion_tool(F.col("path")).alias("tool"))
    known = F.col("tool").isin(*converters)
    unsupported = F.concat(F.lit("Unsupported file suffix: `"), F.coalesce("suffix", F.lit("")), F.lit("`"))
    no_tool = F.when(F.col("tool").isNull(), unsupported).otherwise(F.concat(F.lit("No converter for tool: "), "tool"))
    none = F.lit(None).cast("string")
    out = [routed.where(~F.coalesce(known, F.lit(False))).select("path", "tool", none.alias("text"), no_tool.alias("error"), F.array().cast("array<string>").alias("tried"))]

    def branch(rows: DataFrame, tool: str, before: list[str]) -> None:
        tried = F.array(*map(F.lit, [*before, tool]))
        done = converters[tool](rows).select("path", F.lit(tool).alias("tool"), T.clean_text(F.col("text")).alias("text"), "error", tried.alias("tried"))
        done = store(done, f"converted-{tool}")
        ends = {s: other for (name, s), other in fallbacks.items() if name == tool and other in converters and other not in [*before, tool]}
        again = F.col("error").isNotNull() & T.suffix(F.col("path")).isin(*ends)
        out.append(done.where(~F.coalesce(again, F.lit(False))))
        failed = done.where(again).select("path").distinct()
        if ends and not failed.isEmpty():
            for other in sorted(set(ends.values())):
                mine = rows.where(T.suffix(F.col("path")).isin(*[s for s, o in ends.items() if o == other]))
                branch(mine.join(failed, "path", "left_semi"), other, [*before, tool])

    for tool in converters:
        branch(routed.where(F.col("tool") == tool).select("path", "content"), tool, [])
    rows = reduce(DataFrame.unionByName, out)
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    return rows.select("path", T.suffix(F.col("path")).alias("suffix"), "tool", "text", status.alias("status"), "error", "tried")


def metadata_rows(converted: DataFrame, metadata: DataFrame, inputs: str, outputs: str) -> DataFrame:
    """converted: path, suffix, tool, text; metadata: path and the fields of a description.  The metadata records of the converted files."""
    from quizloom.sources.records import output_path

    made = converted.select(
        F.col("path").alias("source_path"), output_path(F.col("path"), inputs, outputs, ".mmd").alias("markdown_path"), "suffix",
        F.col("tool").alias("conversion_tool"), T.word_count(F.coalesce("text", F.lit(""))).alias("markdown_token_estimate"),
    )
    fields = metadata.select(F.col("path").alias("source_path"), *[F.col(f"`{n}`") for n in (*V.METADATA_FIELDS, "Metadata Warning")])
    return made.join(fields, "source_path")


def description(reply: Column, path: Column, text: Column) -> Column:
    """struct of the metadata fields and Metadata Warning: what an object told, else what path and text tell, with a warning.

    An object with an error that isn't empty counts as no description.
    """
    from quizloom.functions import replies

    v = replies.parsed(reply)
    told = lambda n: replies.said(v, f'$["{n}"]')
    plain = F.coalesce(reply, F.lit(""))
    broken = F.when(v.isNull() | (told("error") != ""), F.lit("Metadata extraction returned invalid JSON: "))
    error = F.concat(F.coalesce(broken, F.when(~replies.is_object(v), F.lit("Metadata extraction did not return JSON: "))), plain)
    own = {"Name": T.file_stem(path), "Brief Description": F.lit(V.NO_DESCRIPTION), "Type": T.fallback_type(text)}
    field = lambda n: T.canonical_type(told(n)) if n == "Type" else told(n)
    fields = [F.when(error.isNull(), field(n)).otherwise(own.get(n, F.lit(""))).alias(n) for n in V.METADATA_FIELDS]
    return F.struct(*fields, F.substring(error, 1, V.WARNING_CHARS).alias("Metadata Warning"))
