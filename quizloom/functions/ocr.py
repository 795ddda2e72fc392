"""Post-processing of OCR pages: references, boxes and page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import values as V

#: A detected region: label, then boxes.
REFERENCE = r"(?s)(<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>)"


def references(c: Column) -> Column:
    """Array of struct(whole, label, boxes)."""
    part = lambda i: F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(i))
    return F.arrays_zip(part(1).alias("whole"), part(2).alias("label"), part(3).alias("boxes"))


def boxes(c: Column, width: Column, height: Column) -> Column:
    """Array of [x1, y1, x2, y2] in pixels from a list of boxes on a grid of 0 to 999."""
    size = [width, height, width, height]
    scaled = lambda b: F.array(*[(F.get(b, F.lit(i)) / 999 * size[i]).cast("int") for i in range(4)])
    return F.transform(F.from_json(c, "array<array<double>>"), scaled)


def strip_references(c: Column, page: Column) -> Column:
    """Image regions become numbered picture links, others go; two operator names and runs of blank lines are simplified."""

    def step(acc: Column, r: Column) -> Column:
        image = r["label"] == "image"
        link = F.concat(F.lit("![](images/"), page.cast("string"), F.lit("_"), acc["n"].cast("string"), F.lit(".jpg)\n"))
        text = F.replace(acc["text"], r["whole"], F.when(image, link).otherwise(F.lit("")))
        return F.struct(text.alias("text"), (acc["n"] + F.when(image, 1).otherwise(0)).alias("n"))

    folded = F.aggregate(references(c), F.struct(c.alias("text"), F.lit(0).alias("n")), step, lambda a: a["text"])
    plain = F.replace(F.replace(folded, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))
    return F.replace(F.replace(plain, F.lit("\n\n\n\n"), F.lit("\n\n")), F.lit("\n\n\n"), F.lit("\n\n"))


def finished_pages(pages: DataFrame, end: str = V.END_OF_TEXT) -> DataFrame:
    """Pages whose text ends as it should, without the end mark."""
    return pages.where(F.contains("text", F.lit(end))).withColumn("text", F.replace("text", F.lit(end), F.lit("")))


def join_pages(pages: DataFrame, key: str = "doc_id", page: str = "page", mark: str = V.PAGE_SPLIT) -> DataFrame:
    """One row per document: its pages in order, each followed by mark.  A document's pages are few."""
    ordered = F.array_sort(F.collect_list(F.struct(page, "text")))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: F.concat(p["text"], F.lit(mark))), "").alias("text"))


def grid_for(width: Column, height: Column, least: int = 2, most: int = 6) -> Column:
    """struct(columns, rows): the tile grid whose aspect ratio is closest, fewer tiles first among equals."""
    sizes = [(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if least <= c * r <= most]
    grids = [F.struct(F.lit(c).alias("columns"), F.lit(r).alias("rows")) for c, r in sorted(sizes, key=lambda s: s[0] * s[1])]
    scored = F.transform(F.array(*grids), lambda g: F.struct(F.abs(width / height - g["columns"] / g["rows"]).alias("d"), (g["columns"] * g["rows"]).alias("n"), g.alias("g")))
    return F.array_min(scored)["g"]


def kept_page_numbers(pages: DataFrame, key: str = "doc_id", page: str = "page", end: str = V.END_OF_TEXT) -> DataFrame:
    """The finished pages with kept: their number from 0 among those of their document."""
    order = Window.partitionBy(key).orderBy(page)
    return finished_pages(pages, end).withColumn("kept", F.row_number().over(order) - 1)
