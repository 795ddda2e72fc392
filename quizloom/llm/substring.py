"""Substring deduplication by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  Words covered by a window that also
starts earlier are removed, where earlier is a smaller doc_id, or the same
document and an earlier start.

1. A window's anchor is the leftmost smallest hash of its ``GRAM``-word grams, so
   equal windows have equal anchors.  Anchors are counted over the corpus; only
   those that occur more than once can hold a repeated window.
2. Documents with such anchors give pieces: the words around an anchor that its
   windows cover.  Pieces are dealt to shards by anchor, in document order.
3. In a shard, each anchor's pieces are streamed through a suffix automaton of the
   earlier ones; where the matching statistics reach ``WINDOW``, the window
   occurred before.  Then the piece joins the automaton.
4. A place of an anchor that more than ``HEAVY`` places share isn't gathered in a
   shard.  Its windows are reduced to their first places by a combining aggregation,
   and a document is told which of its own are first; all others of that anchor
   occurred before.  No row is made for those.
5. The windows' places go back to the texts, which are cut.

The reference grows with the corpus, so its shards travel by shuffle and not by
broadcast, and no automaton holds more than ``HEAVY`` pieces.  The texts cross one
shuffle; the joins that need them (2, 4 and 5) read the same one.

Defined results: a null text has no words; a text shorter than a window loses
nothing; a null doc_id comes after every other one; rows with one doc_id are
separate documents ordered by a hash of their text, and rows that are the same in
both count as one document; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm import words
from quizloom.llm.scratch import store

WINDOW, GRAM = 20, 8
HEAVY = 2000


class SuffixAutomaton:
    """Of several sequences; states are list positions."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _redirect(self, p: int, symbol, q: int) -> int:
        """The state of length size[p] + 1 that p reaches by symbol; q, where p goes now, is split if it is longer."""
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._redirect(last, symbol, q)
                continue
            new, p = self._state(self.size[last] + 1, 0, {}), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._redirect(p, symbol, self.next[p][symbol])
            last = new

    def matching(self, sequence) -> Iterator[int]:
        """Length of the longest suffix up to each symbol that occurs in an added sequence."""
        state = length = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield length


def _anchors_of(run: words.Run, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, anchor position, first and last window of each anchor; positions count in the run's words."""
    none = np.zeros(0, np.int64)
    n = len(hashed) - WINDOW + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none, none
    row, grams = run.row_of_word(), words.grams(hashed, GRAM)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for t in range(1, WINDOW - GRAM + 1):
        lower = grams[t : t + n] < best
        best[lower], at[lower] = grams[t : t + n][lower], t
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    place = start + at[start]
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(start)) - 1
    return row[start[heads]], best[start[heads]], place[heads], start[heads], start[tails]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, t = (batch.column(c).to_numpy() for c in ("k", "t"))
        for run in words.runs(batch.column("text"), lower=False):
            row, anchor, place, _, _ = _anchors_of(run, run.hashes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(k[run.lo + row]), pa.array(t[run.lo + row]),
                    pa.array((place - run.first[row]).astype(np.int32)),
                ],
                names=["anchor", "k", "t", "place"],
            )


def _pieces(heavy: bool):
    """Pieces of the light anchors, or single windows of the heavy ones."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t = (batch.column(c).to_numpy() for c in ("k", "t"))
            wanted = batch.column("places")
            for run in words.runs(batch.column("text"), lower=False):
                hashed = run.hashes()
                row, anchor, place, first, last = _anchors_of(run, hashed)
                lists = [np.asarray(wanted[run.lo + i].values) for i in range(run.hi - run.lo)]
                want = np.concatenate([x + f for x, f in zip(lists, run.first[:-1], strict=True)]) if lists else place[:0]
                keep = np.isin(place, want)
                row, anchor, first, last = row[keep], anchor[keep], first[keep], last[keep]
                if heavy:
                    many = last - first + 1
                    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    row = np.repeat(row, many)
                    sums = words.grams(hashed, WINDOW)[at]
                    other = words.grams(words.mix(hashed + np.uint64(1)), WINDOW)[at]
                    columns = [sums.view(np.int64), other.view(np.int64), k[run.lo + row], t[run.lo + row], (at - run.first[row]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "k", "t", "start"])
                else:
                    short = hashed.astype(np.uint32)
                    text = [short[x : y + WINDOW].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                    columns = [anchor.view(np.int64), k[run.lo + row], t[run.lo + row], (first - run.first[row]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c) for c in columns], pa.array(text, pa.binary())], names=["anchor", "k", "t", "start", "piece"]
                    )

    return make


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor, document and start: the ranges of window starts that occurred before."""
    now = last = None
    seen: list[bytes] = []
    known: set[bytes] = set()
    automaton: SuffixAutomaton | None = None
    repeated: list[int] = []
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        rows = zip(*(batch.column(c).to_pylist() for c in ("anchor", "k", "t", "start", "piece")), strict=True)
        for anchor, k, t, start, piece in rows:
            if anchor != now:
                now, last, seen, known, automaton = anchor, None, [], set(), None
            if (k, t, start) != last:  # a repeated row has the result of the first
                last = (k, t, start)
                symbols = np.frombuffer(piece, np.uint32).tolist()
                n = len(symbols) - WINDOW + 1
                if piece in known:
                    repeated = list(range(n))
                elif not known:
                    repeated = []
                else:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                    for old in seen:
                        automaton.add(np.frombuffer(old, np.uint32).tolist())
                    seen = []
                    repeated = [i - WINDOW + 1 for i, size in enumerate(automaton.matching(symbols)) if size >= WINDOW]
                if len(repeated) < n:
                    known.add(piece)
                    seen.append(piece)
            i = 0
            while i < len(repeated):
                j = i
                while j + 1 < len(repeated) and repeated[j + 1] == repeated[j] + 1:
                    j += 1
                for column, value in zip(out, (k, t, start + repeated[i], start + repeated[j]), strict=True):
                    column.append(value)
                i = j + 1
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, types, strict=True)], names=["k", "t", "lo", "hi"])


def _windows_again(run: words.Run, told: list[dict[int, np.ndarray]]) -> list[np.ndarray]:
    """Of each row the starts of the windows at its heavy anchors, without those that are first."""
    row, _, place, first, last = _anchors_of(run, run.hashes())
    heavy = np.concatenate([x[HEAVY_PLACE] + f for x, f in zip(told, run.first[:-1], strict=True)])
    keep = np.isin(place, heavy)
    row, first, last = row[keep], first[keep], last[keep]
    many = last - first + 1
    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    fresh = np.concatenate([x[FRESH] + f for x, f in zip(told, run.first[:-1], strict=True)])
    row = np.repeat(row, many)
    again = ~np.isin(at, fresh)
    cut = np.searchsorted(row[again], np.arange(len(told) + 1))
    return [at[again][x:y] - f for x, y, f in zip(cut[:-1], cut[1:], run.first[:-1], strict=True)]


#: What a document is told of its windows: a range of starts, a place of a heavy anchor, or a start of a first window at one.
RANGE, HEAVY_PLACE, FRESH = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("told")
        for run in words.runs(batch.column("text"), lower=False):
            n, removed, kept, told, ranges = [], [], [], [], []
            for i in range(run.lo, run.hi):
                each = lists[i].values if lists[i].is_valid else None
                what, x, y = (np.asarray(each.field(c)).astype(np.int64) if each is not None else np.zeros(0, np.int64) for c in ("what", "x", "y"))
                told.append({kind: x[what == kind] for kind in (RANGE, HEAVY_PLACE, FRESH)})
                ranges.append(y[what == RANGE])
            again = _windows_again(run, told) if any(len(x[HEAVY_PLACE]) for x in told) else None
            text = run.data.tobytes()
            for i in range(run.hi - run.lo):
                a, b = run.first[i], run.first[i + 1]
                drop = np.zeros(b - a + 1, np.int64)
                np.add.at(drop, told[i][RANGE], 1)
                np.add.at(drop, ranges[i] + WINDOW, -1)
                if again is not None:
                    np.add.at(drop, again[i], 1)
                    np.add.at(drop, again[i] + WINDOW, -1)
                keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0) + a
                pieces = [text[x:y] for x, y in zip(run.start[keep].tolist(), run.stop[keep].tolist(), strict=True)]
                n.append(b - a)
                removed.append(b - a - len(keep))
                kept.append(b" ".join(pieces).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(run.lo, run.hi - run.lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sums = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in batch.column("kept")]
        columns = [*(batch.column(c) for c in ("doc_id", "n_words", "n_removed")), pa.array(sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, k (doc_id, the largest long for null), t (hash of the text) and text."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1).cast("long"))
    return docs.select(F.col("doc_id").cast("long"), key.alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (k, t, what, x, y) for documents: RANGE, windows that start at x..y occurred earlier; HEAVY_PLACE and FRESH, x alone."""
    texts = _located(docs)
    anchors = texts.select("k", "t", "text").mapInArrow(_anchors, "anchor long, k long, t long, place int")
    counts = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = store(counts.where("n > 1"), "anchors")

    def places_of(some: DataFrame) -> DataFrame:
        return anchors.join(some.select("anchor"), "anchor", "left_semi")

    def documents_with(places: DataFrame) -> DataFrame:
        lists = places.groupBy("k", "t").agg(F.collect_set("place").alias("places"))
        return texts.join(lists, ["k", "t"]).select(*texts.columns, "places")

    def told(rows: DataFrame, what: int, x: str, y: str) -> DataFrame:
        return rows.select("k", "t", F.lit(what).alias("what"), F.col(x).alias("x"), F.col(y).alias("y"))

    light = documents_with(places_of(shared.where(F.col("n") <= HEAVY)))
    pieces = light.mapInArrow(_pieces(False), "anchor long, k long, t long, start int, piece binary")
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor", "k", "t", "start")
    found = told(ordered.mapInArrow(_stream, "k long, t long, lo int, hi int"), RANGE, "lo", "hi")
    heavy = shared.where(F.col("n") > HEAVY)
    if not heavy.isEmpty():
        places = places_of(heavy)
        windows = documents_with(places).mapInArrow(_pieces(True), "a long, b long, k long, t long, start int")
        first = windows.groupBy("a", "b").agg(F.min(F.struct("k", "t", "start")).alias("first")).select("first.*")
        found = found.unionByName(told(places, HEAVY_PLACE, "place", "place")).unionByName(told(first, FRESH, "start", "start"))
    return found


def _with_repeats(docs: DataFrame) -> DataFrame:
    lists = repeats(docs).groupBy("k", "t").agg(F.collect_set(F.struct("what", "x", "y")).alias("told"))
    texts = _located(docs)
    return texts.join(lists, ["k", "t"], "left").select(*texts.columns, "told")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return _with_repeats(docs).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def digest_repeats(docs: DataFrame) -> DataFrame:
    """As remove_repeats, with a SHA-256 of what stays in place of it."""
    return _with_repeats(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
