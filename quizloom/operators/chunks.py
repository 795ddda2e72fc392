"""Chunks, Markdown sections and the segments that are read."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.functions import values as V


def windows(docs: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Overlapping windows over white-space tokens: chunk_index, token_start, token_end, text."""
    step = max(1, size - overlap)
    words = T.words(F.col("text"))
    rows = docs.select(key, words.alias("_w")).withColumn("_n", F.size("_w"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / F.lit(step))).cast("int")
    # Null for a text without tokens, so that it makes no chunk.
    every = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("chunk_index"), (i * step).alias("token_start"), F.least(F.col("_n"), i * step + size).alias("token_end"),
        F.array_join(F.slice("_w", i * step + 1, size), " ").alias("text"),
    )))
    return rows.select(key, F.explode(every).alias("c")).select(key, "c.*")


#: Characters that no pattern counts as white space.
_VISIBLE = r"[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]"
#: Places that a byte-level tokenizer's words never span: before a single space or line break, behind a line break, between a letter and its stop.
_CUT = re.compile(rf"(?s:(?=[ \n.,;:!?])(?:(?<={_VISIBLE})(?=[ \n]{_VISIBLE})|(?<=[A-Za-z])(?=[.,;:!?]))|(?<=\n)(?={_VISIBLE})(?<={_VISIBLE}\n))")
#: Pieces whose counts a task keeps at most.
KEPT_PIECES = 400_000
#: Texts that are cut into pieces at once.
TEXTS_AT_ONCE = 200


class _Tokens:
    """Tokens of texts, by pieces that are encoded once where the tokenizer's words lie within them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.made, self.counts = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        words, of = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.in_pieces = (
            words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and of.get("type") == "BPE" and not of.get("dropout")
            and not any(told.get(x) for x in ("normalizer", "post_processor", "truncation", "padding"))
        )
        self.special = [t["content"] for t in told.get("added_tokens") or []]

    def encode(self, text: str):
        return self.made.encode(text, add_special_tokens=False)

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text's pieces, all counted."""
        cut = [_CUT.split(t) if self.in_pieces and not any(x in t for x in self.special) else [t] for t in texts]
        if len(self.counts) > KEPT_PIECES:
            self.counts.clear()
        new = list(set().union(*cut).difference(self.counts))
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            self.counts.update(zip(some, map(len, self.made.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return cut

    def windows(self, pieces: list[str], size: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        """First token, token after the last, first character and character after the last of each window."""
        to = list(accumulate(map(self.counts.__getitem__, pieces), initial=0))
        at = list(accumulate(map(len, pieces), initial=0))

        def place(token: int) -> tuple[int, int]:
            i = bisect_right(to, token) - 1
            a, b = self.encode(pieces[i]).token_to_chars(token - to[i])
            return at[i] + a, at[i] + b

        for start in range(0, to[-1], max(1, size - overlap)):
            end = min(to[-1], start + size)
            yield start, end, place(start)[0], place(end - 1)[1]
            if end == to[-1]:
                break


def tokenizer_windows(docs: DataFrame, key: str, tokenizer: str, size: int, overlap: int) -> DataFrame:
    """The same over a tokenizer's tokens; texts are cut at the tokens' character offsets."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens(tokenizer)
        for batch in batches:
            out = []
            texts = [t or "" for t in batch["text"]]
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                some = texts[lo : lo + TEXTS_AT_ONCE]
                for k, text, pieces in zip(batch[key][lo : lo + TEXTS_AT_ONCE], some, tokens.pieces(some), strict=True):
                    for i, (start, end, a, b) in enumerate(tokens.windows(pieces, size, overlap)):
                        if piece := text[a:b].strip():
                            out.append((k, i, start, end, piece))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "token_start", "token_end", "text"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInPandas(cut, f"{key} {kind}, chunk_index int, token_start int, token_end int, text string")


def units(c: Column) -> Column:
    """Paragraphs, else lines, else the whole text."""
    some = lambda parts: F.filter(F.transform(parts, T.trim_all), lambda x: x != "")
    paragraphs, lines = some(F.split(c, r"\n{2,}")), some(F.split(c, r"\R"))
    return F.when(F.size(paragraphs) > 0, paragraphs).when(F.size(lines) > 0, lines).otherwise(F.array(c))


def split_unit(c: Column, size: int, chars_per_token: int = 4) -> Column:
    """A unit that is too long as lines, else sentences, else runs of words; the first that gives several pieces."""
    limit = max(1, size * chars_per_token)
    some = lambda parts: F.filter(F.transform(parts, T.trim_all), lambda x: x != "")
    lines, sentences, words = some(F.split(c, r"\R")), some(F.split(c, r"(?<=[.!?。！？])\s+")), T.words(c)
    mean = F.greatest(F.lit(1), F.floor(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words))).cast("int")
    many = F.greatest(F.lit(1), F.floor(F.lit(limit) / mean)).cast("int")
    starts = F.sequence(F.lit(1), F.size(words), many)
    runs = F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, many), " "))).otherwise(F.array(c))
    return (
        F.when(F.length(c) <= limit, F.array(c)).when(F.size(lines) > 1, lines).when(F.size(sentences) > 1, sentences).otherwise(runs)
    )


def pack(docs: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Units packed greedily up to size words, with whole units of up to overlap words carried over."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key, text.alias("text"), F.flatten(F.transform(units(text), lambda u: split_unit(u, size))).alias("_u"))
    counts = F.concat(F.transform("_u", T.word_count), F.array(T.word_count(F.col("text"))))
    return fold_units(rows.withColumn("_n", counts), key, size, overlap)


def fold_units(rows: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """rows: key, text, _u (units) and _n (their counts, and at the end the count of the whole text).  The packed chunks.

    The fold is sequential inside a document and documents are independent, so it runs in the
    tasks that hold them; it adds up counts and joins texts once a chunk is full.
    """

    def bounds(counts: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """First unit, unit after the last, token_start and tokens of each chunk."""
        first = used = start = 0
        for i, n in enumerate(counts):
            if i > first and used + n > size:
                yield first, i, start, used
                start, low, first, kept = max(0, start + used - overlap), first, i - 1, counts[i - 1]  # the last unit in any case
                while first > low and kept < overlap and kept + counts[first - 1] <= overlap:
                    first -= 1
                    kept += counts[first]
                used = kept
            used += n
        yield first, len(counts), start, used

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text, pieces, counts in zip(batch[key], batch["text"], batch["_u"], batch["_n"], strict=True):
                *each, whole = map(int, counts)
                if whole <= size:
                    out.append((k, 0, 0, whole, text))
                else:
                    out += [(k, i, start, start + used, "\n\n".join(pieces[a:b]).strip()) for i, (a, b, start, used) in enumerate(bounds(each))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "token_start", "token_end", "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text", "_u", "_n").mapInPandas(fold, f"{key} {kind}, chunk_index int, token_start int, token_end int, text string")


def chunk_config(kind: Column, stage: str) -> Column:
    """struct(size, overlap) by document type; null for an unsupported one."""
    out = F.lit(None).cast("struct<size:int,overlap:int>")
    for (name, at), (size, overlap) in V.CHUNKING.items():
        if at == stage:
            out = F.when(kind == name, F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))).otherwise(out)
    return out


def strategy(kind: Column, n_chunks: Column) -> Column:
    return (
        F.when(~kind.isin("MCQ", "SAQ", "CaseReport"), "unsupported_document_type").when(n_chunks <= 1, "single_chunk")
        .otherwise(F.concat(F.lit("token_chunked_"), F.lower(kind)))
    )


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sections(docs: DataFrame, key: str | list[str]) -> DataFrame:
    """Markdown sections: ordinal, title, level, text.  What stands before the first heading is the preamble."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\R", "\n")
    heading = r"^(#{1,6})[^\S\n]+(\S.*?)[^\S\n]*(?:\n|$)"
    parts = F.transform(F.split(text, r"(?m)(?=^#{1,6}[^\S\n]+\S)"), lambda p: F.struct(
        F.when(p.rlike(heading), F.regexp_extract(p, heading, 2)).otherwise("Preamble").alias("title"),
        F.length(F.when(p.rlike(heading), F.regexp_extract(p, heading, 1)).otherwise("")).alias("level"), T.trim_all(p).alias("text"),
    ))
    full = F.filter(parts, lambda s: s["text"] != "")
    none = F.array(F.struct(F.lit("Full Document").alias("title"), F.lit(0).alias("level"), F.lit("").alias("text")))
    rows = docs.select(*_keys(key), full.alias("_s"))
    some = F.when(F.size("_s") > 0, F.col("_s")).otherwise(none)
    return rows.select(*_keys(key), F.posexplode(some).alias("ordinal", "s")).select(*_keys(key), "ordinal", "s.*")


def matched_sections(parts: DataFrame, titles: DataFrame, key: str | list[str]) -> DataFrame:
    """Sections whose heading holds a recommended title of their document, or is held by it; the first of each heading.

    titles: rows (key, title).  The join is on the document; the titles of one document are few.
    """
    key = _keys(key)
    wanted = titles.select(*key, T.normalize_heading(F.col("title")).alias("_t")).where("_t != ''")
    wanted = wanted.groupBy(*key).agg(F.collect_set("_t").alias("_titles"))
    rows = parts.withColumn("_h", T.normalize_heading(F.col("title"))).where("_h != ''").join(wanted, key)
    rows = rows.where(F.exists("_titles", lambda t: F.contains(F.col("_h"), t) | F.contains(t, F.col("_h"))))
    w = Window.partitionBy(*key, "_h").orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_h", "_titles")


def segments(docs: DataFrame, matched: DataFrame, reports: DataFrame, key: str | list[str]) -> DataFrame:
    """segment_type, title, text: matched sections, else the chunks that a report recommends, else the whole document."""
    key = _keys(key)
    one = matched.select(*key, F.lit("section").alias("segment_type"), "title", "text")
    two = reports.where("recommended").select(
        *key, F.lit("read_chunk").alias("segment_type"), F.concat(F.lit("Structure chunk "), (F.col("chunk_index") + 1).cast("string")).alias("title"), "text"
    )
    two = two.join(one.select(*key).distinct(), key, "left_anti")
    three = docs.select(*key, F.lit("full_document").alias("segment_type"), F.lit("Full Document").alias("title"), "text")
    three = three.join(one.select(*key).union(two.select(*key)).distinct(), key, "left_anti")
    return one.unionByName(two).unionByName(three)


def structure_context(reports: DataFrame, key: str, most: int = 8) -> DataFrame:
    """JSON of the first reports of a document, each with its first sections (column sections: an array)."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    first = reports.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    row = F.struct("chunk_index", "summary", F.slice("sections", 1, most).alias("sections"))
    return first.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("context"))
