"""Chunkers as table functions for SQL: select key, c.* from docs, lateral word_chunks(text, 512, 96) c.

Each takes one text and yields its chunks; batches travel as Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_index int, token_start int, token_end int, text string"
# Unicode's white space and line ends, as the column functions take them.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_LINE_END = re.compile("\\r\\n|[\\n-\\r\\x85\\u2028\\u2029]")
_HEADING = re.compile(r"^(#{1,6})[^\S\n]+(\S.*?)[^\S\n]*$", re.M | re.A)


class WordChunks:
    """Overlapping windows over white-space tokens; none for a text without tokens."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        words = [w for w in _SPACE.split(text or "") if w]
        for i, start in enumerate(range(0, len(words), max(1, size - overlap))):
            end = min(len(words), start + size)
            yield i, start, end, " ".join(words[start:end])
            if end == len(words):
                return


class TokenizerChunks:
    """The same over the tokens of a tokenizer file, which is loaded once a task; texts are cut at the tokens' characters."""

    def __init__(self) -> None:
        self.path, self.made = None, None

    def eval(self, text: str, tokenizer: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        if self.path != tokenizer:
            from tokenizers import Tokenizer

            self.path, self.made = tokenizer, Tokenizer.from_file(tokenizer)
        at = self.made.encode(text or "", add_special_tokens=False).offsets
        for i, start in enumerate(range(0, len(at), max(1, size - overlap))):
            end = min(len(at), start + size)
            piece = text[at[start][0] : at[end - 1][1]].strip()
            if piece:
                yield i, start, end, piece
            if end == len(at):
                return


class MarkdownSections:
    """Sections by heading, the text before the first one as the preamble; a text without any is one section."""

    def eval(self, text: str) -> Iterator[tuple[int, str, int, str]]:
        text = _LINE_END.sub("\n", text or "")
        marks = [(m.start(), m[2], len(m[1])) for m in _HEADING.finditer(text)]
        parts = [(0, "Preamble", 0), *marks] if not marks or marks[0][0] else marks
        ends = [p[0] for p in parts[1:]] + [len(text)]
        whole = [(title, level, text[a:b].strip()) for (a, title, level), b in zip(parts, ends, strict=True)]
        some = [s for s in whole if s[2]] or [("Full Document", 0, "")]
        for i, s in enumerate(some):
            yield i, *s


FUNCTIONS = {
    "word_chunks": F.udtf(WordChunks, returnType=CHUNK, useArrow=True),
    "tokenizer_chunks": F.udtf(TokenizerChunks, returnType=CHUNK, useArrow=True),
    "markdown_sections": F.udtf(MarkdownSections, returnType="ordinal int, title string, level int, text string", useArrow=True),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL under their names."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
