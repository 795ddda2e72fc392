"""Scans: input files by suffix, and documents in several formats as Markdown."""

from __future__ import annotations

import io
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quizloom.functions import text as T
from quizloom.functions import values as V
from quizloom.sources.scratch import is_file


def input_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, suffix, tool of the supported files, in path order; contents stay unread until they are selected.

    A path that names one file is that file, whatever its suffix.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = read.load(path).withColumn("suffix", T.suffix(F.col("path"))).withColumn("tool", T.conversion_tool(F.col("path")))
    return rows if is_file(spark, path) else rows.where(F.col("tool").isNotNull()).orderBy("path")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text; bytes that aren't UTF-8 are left out."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [bytes(c).decode("utf-8", "ignore") for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, text string")


class _Html(HTMLParser):
    """Texts outside of scripts and styles, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.texts = 0, []

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data) -> None:
        if not self.hidden and data.strip():
            self.texts.append(data.strip())


class _Titled(_Html):
    """The same, and the text of the first title."""

    def __init__(self) -> None:
        super().__init__()
        self.title, self._inside = None, False

    def handle_starttag(self, tag, attrs) -> None:
        super().handle_starttag(tag, attrs)
        if tag == "title" and self.title is None:
            self.title, self._inside = "", True

    def handle_endtag(self, tag) -> None:
        super().handle_endtag(tag)
        self._inside = self._inside and tag != "title"

    def handle_data(self, data) -> None:
        super().handle_data(data)
        if self._inside:
            self.title += data.strip()


def plain_html(html: str) -> tuple[str | None, str]:
    """Title (None without one) and visible texts, one a line."""
    parser = _Titled()
    parser.feed(html)
    parser.close()
    return parser.title, "\n".join(parser.texts)


def html_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, body: the page's visible texts, one a line."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h in b[html]:
                p = _Html()
                p.feed(h or "")
                out.append("\n".join(p.texts))
            yield pd.DataFrame({key: b[key], "body": out})

    return pages.select(key, html).mapInPandas(parse, f"{key} {dict(pages.dtypes)[key]}, body string")


def html_title(html: Column) -> Column:
    return T.trim_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_markdown(pages: DataFrame, key: str, html: str, stem: Column) -> DataFrame:
    """key, text: a heading of the title, else of stem, and the visible texts."""
    title = pages.select(F.col(key), html, F.nullif(html_title(F.col(html)), F.lit("")).alias("_t"), stem.alias("_stem"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, t, s in zip(b[html], b["_t"], b["_stem"], strict=True):
                p = _Html()
                p.feed(h or "")
                out.append(f"# {unescape(t) if t else s}\n\n" + "\n".join(p.texts))
            yield pd.DataFrame({key: b[key], "text": out})

    return title.mapInPandas(parse, f"{key} {dict(pages.dtypes)[key]}, text string")


def xml_markdown(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, text: a heading for every element with text, and all text below it; null for what doesn't parse or has a document type."""

    def one(raw: str) -> str | None:
        if "<!doctype" in raw.lower():  # entities may expand without bound
            return None
        try:
            root = ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            return None
        parts = []
        for e in root.iter():
            whole = " ".join("".join(e.itertext()).split())
            if whole:
                parts.append(f"## {e.tag.rpartition('}')[2]}\n\n{whole}")
        return "\n\n".join(parts)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [one(x or "") for x in b[xml]]})

    return files.select(key, xml).mapInPandas(parse, f"{key} {dict(files.dtypes)[key]}, text string")


def _markdown_row(values: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), F.lit(" |"))


def table_markdown(table: DataFrame, title: str) -> DataFrame:
    """line, text: a Markdown table as one row a line, in the table's own order of partitions and rows."""
    head = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "| " + " | ".join("---" for _ in table.columns) + " |"]
    top = table.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "line long, text string")
    rows = table.select(F.monotonically_increasing_id().alias("line"), _markdown_row([F.col(f"`{c}`") for c in table.columns]).alias("text"))
    return top.unionByName(rows)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or TSV by the path's suffix, with a header."""
    return spark.read.csv(path, header=True, sep="\t" if path.lower().endswith(".tsv") else ",", inferSchema=True)


def excel_sheets(files: DataFrame) -> DataFrame:
    """path, sheet, csv of every sheet of the files (path, content).  Needs pandas' Excel reader on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (p, name, sheet.to_csv(index=False))
                for p, c in zip(b["path"], b["content"], strict=True)
                for name, sheet in pd.read_excel(io.BytesIO(bytes(c)), sheet_name=None).items()
            ]
            yield pd.DataFrame(out, columns=["path", "sheet", "csv"])

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, csv string")


METADATA = S.StructType([S.StructField(n, S.StringType()) for n in ("source_path", "markdown_path", "md_path", "mmd_path", "suffix", "conversion_tool")]).add("markdown_token_estimate", S.IntegerType())
for _n in ("Name", "Date", "Authors", "Brief Description", "Type", "Metadata Warning"):
    METADATA.add(_n, S.StringType())


def metadata_records(spark: SparkSession, path: str, schema: S.StructType = METADATA) -> DataFrame:
    """Records of JSON files that hold one object, a list of objects, or either under processed_files; run summaries are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("_file", F.input_file_name())
    raw = raw.where(~F.col("_file").endswith("/run_summary.json"))
    inner = F.get_json_object("value", "$.processed_files")
    body = F.coalesce(inner, F.col("value"))
    many = F.when(F.ltrim(body).startswith("["), F.from_json(body, S.ArrayType(schema))).otherwise(F.array(F.from_json(body, schema)))
    rows = raw.select("_file", F.posexplode(many).alias("_at", "r")).orderBy("_file", "_at").select("r.*")
    where = F.coalesce("markdown_path", "md_path", "mmd_path")
    return rows.withColumn("markdown_path", where).drop("md_path", "mmd_path")


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """category, item_index, item (JSON) of a benchmark file; a category that is missing has no items."""
    raw = spark.read.text(path, wholetext=True)
    each = None
    for category in V.CATEGORIES:
        items = F.expr(f"variant_get(parse_json(value), '$.{category}', 'array<variant>')")
        rows = raw.select(F.lit(category).alias("category"), F.posexplode(items).alias("item_index", "v"))
        rows = rows.select("category", "item_index", F.to_json("v").alias("item"))
        each = rows if each is None else each.unionByName(rows)
    return each


def benchmark_rest(spark: SparkSession, path: str) -> str:
    """The members of a benchmark file that are no category, as a JSON object."""
    whole = F.try_parse_json("value")
    names = F.filter(F.json_object_keys("value"), lambda n: ~n.isin(*V.CATEGORIES))
    member = lambda n: F.try_variant_get(whole, F.concat(F.lit("$['"), n, F.lit("']")), "variant")
    raw = spark.read.text(path, wholetext=True)
    told = raw.select(F.to_json(F.map_from_arrays(names, F.transform(names, member))).alias("rest")).first()
    return told["rest"] if told and told["rest"] else "{}"


def resumed(spark: SparkSession, output: str, fresh: DataFrame, force: bool = False) -> DataFrame:
    """The table written at output by an earlier run, or fresh."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(output) if there and not force else fresh
