"""Language identification with spans of mixed-language text.

The script of a word narrows the languages that may have written it; its byte
trigrams score those that remain; Viterbi with a penalty for every switch labels
the words of a document, and the language of most letters is the document's.

Counts of trigrams and scripts are taken over all training rows, combined in each
task and then by a shuffle.  The model has ``2 ** BITS`` numbers a language; beyond
``MOST_NUMBERS`` in all, which takes over 400 languages, languages have fewer, so its
size is bounded and no language is left out.  It is broadcast, and all documents are
labelled in one pass without a shuffle.

Training rows have a lang, and crc32(doc_id as text) mod 3 is not 1.  lang, source
and doc_id are no inputs of a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing was learned; a null doc_id is held out; rows with one
doc_id are labelled by their own text; ties go to the language that sorts first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm import words

BITS, LEAST_BITS = 15, 8
MOST_NUMBERS = 400 << 15
SWITCH = 12.0
#: Up to so many languages texts are labelled in blocks of so many words, beyond that word by word.
FEW_LANGUAGES, BLOCK = 16, 32
#: Share of a language's words in a script from which it may have written a word in it.
LEAST_SHARE = 0.002
SMOOTH = 0.1
UNKNOWN = "und"

#: Script of a letter by the first byte of its UTF-8 form: Latin 1, Greek 2, Cyrillic 3, Armenian 4, Hebrew 5,
#: Arabic 6, Indic 7, other Asian 8, kana 9, Han 10, Hangul 11, beyond the basic plane 12; 0 for none.  The second byte
#: tells Thai and Lao (13) after 0xE0, and the later Latin and Greek letters after 0xE1.
_RANGES = (
    (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD5, 4), (0xD6, 0xD7, 5),
    (0xD8, 0xDD, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11), (0xF0, 0xF4, 12),
)
_SCRIPT = np.zeros(256, np.int8)
for _lo, _hi, _script in _RANGES:
    _SCRIPT[_lo : _hi + 1] = _script
_SECOND = ((0xE0, 0xB8, 0xBB, 13), (0xE1, 0xB8, 0xBB, 1), (0xE1, 0xBC, 0xBF, 2))
SCRIPTS = 14


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # SCRIPTS x languages


def bits_for(n_languages: int) -> int:
    """Bits of a bucket's number."""
    bits = BITS
    while bits > LEAST_BITS and n_languages << bits > MOST_NUMBERS:
        bits -= 1
    return bits


def _trigrams(run: words.Run, bits: int) -> np.ndarray:
    """Bucket of the trigram that begins one byte before each byte; what is no letter counts as a space."""
    padded = np.full(len(run.data) + 2, 32, np.uint32)
    padded[1:-1] = run.data
    padded[1:-1][words.no_letter(run.data)] = 32
    edge = run.offsets[1:-1]
    code = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    code[edge[edge < len(code)]] &= 0x00FFFF  # the text before is not part of it
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64)


def _scripts(run: words.Run) -> np.ndarray:
    if not len(run.start):
        return np.zeros(0, np.int8)
    script, second = _SCRIPT[run.data], run.data[1:]
    for lead, lo, hi, other in _SECOND:
        at = np.flatnonzero(run.data[:-1] == lead)
        script[at[(second[at] >= lo) & (second[at] <= hi)]] = other
    return np.maximum.reduceat(script, run.start)


def _bytes_of_words(run: words.Run) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all bytes of words, and the number of the word of each."""
    size = run.stop - run.start
    first = np.cumsum(size) - size
    return np.repeat(run.start - first, size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def _count(languages: list[str]):
    index, bits = {x: i for i, x in enumerate(languages)}, bits_for(len(languages))
    buckets = 1 << bits

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets + SCRIPTS), np.int64)
        for batch in batches:
            label = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for run in words.runs(batch.column("text"), lower=True, letters=True):
                at, word = _bytes_of_words(run)
                of_word = label[run.lo + run.row_of_word()]
                flat = of_word[word] * total.shape[1] + _trigrams(run, bits)[at]
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
                flat = of_word * total.shape[1] + buckets + _scripts(run)
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which), pa.array(bucket), pa.array(total[which, bucket])], names=["language", "bucket", "n"]
        )

    return run_all


def fit(docs: DataFrame) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id"))).select("text", "lang")
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    buckets = 1 << bits_for(len(languages))
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros((SCRIPTS, 0), bool))
    counts = known.mapInArrow(_count(languages), "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    total = np.zeros((len(languages), buckets + SCRIPTS))
    total[table.column("language").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    grams, scripts = total[:, :buckets] + SMOOTH, total[:, buckets:]
    weights = np.log(grams / grams.sum(1, keepdims=True)).T
    allowed = (scripts >= LEAST_SHARE * scripts.sum(1, keepdims=True)) & (scripts > 0)
    return Model(languages, np.ascontiguousarray(weights), allowed.T)


def viterbi(emitted: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of all words; emitted: words x labels; first: offsets of the texts."""
    if 0 < emitted.shape[1] <= FEW_LANGUAGES and len(emitted):
        return _by_blocks(emitted, first, switch)
    return _side_by_side(emitted, first, switch)


def _by_blocks(emitted: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Texts are cut into blocks of BLOCK words, which go side by side.

    A block's scores from each label before it to each label at its end are found first; they give every block the
    scores that it begins with, and then its label at the end.  A text of n words takes n / BLOCK steps of its own.
    """
    n_labels, size = emitted.shape[1], np.diff(first)
    many = -(-size // BLOCK)  # blocks of each text
    head = np.cumsum(many) - many
    n = int(many.sum())
    text = np.repeat(np.arange(len(size)), many)
    begin = first[:-1][text] + (np.arange(n) - head[text]) * BLOCK
    at = begin + np.arange(BLOCK)[:, None]  # word of each step and block
    inside = at < first[1:][text]
    e = np.where(inside, emitted[np.minimum(at, len(emitted) - 1)].transpose(2, 0, 1), 0.0)  # labels x steps x blocks

    # From each label before a block (first axis of the three) to each label now (second).
    across = np.full((n_labels, n_labels, n), -switch)
    across[np.arange(n_labels), np.arange(n_labels)] = 0.0
    across += e[:, 0]
    for t in range(1, BLOCK):
        np.maximum(across, across.max(1, keepdims=True) - switch, out=across)
        across += e[:, t]

    order = np.argsort(-many, kind="stable")
    active = np.searchsorted(-many[order], -np.arange(1, int(many.max()) + 1), "right")  # texts of j + 1 blocks or more
    came_in = np.zeros((n_labels, n))
    now = np.zeros((n_labels, len(size)))
    for j, k in enumerate(active):
        block = head[order[:k]] + j
        came_in[:, block] = now[:, :k]
        now[:, :k] = (now[:, None, :k] + across[:, :, block]).max(0)
        now[:, :k] -= now[:, :k].max(0)

    switched = np.zeros((BLOCK, n_labels, n), bool)  # whether the best way to a label switches
    best = np.zeros((BLOCK, n), np.int64)  # the best label before each step
    ways = came_in
    for t in range(BLOCK):
        best[t] = ways.argmax(0)
        top = ways.max(0) - switch
        switched[t] = ways < top
        ways = np.maximum(ways, top) + e[:, t]
    ends = ways.argmax(0)

    # For each label at the end of a block, the label before the block.
    every = np.arange(n)
    back = np.repeat(np.arange(n_labels)[:, None], n, 1)
    for t in range(BLOCK - 1, -1, -1):
        back = np.where(np.take_along_axis(switched[t], back, 0), best[t], back)
    label = np.zeros(n, np.int64)
    for j in range(len(active) - 1, -1, -1):
        block = head[order[: active[j]]] + j
        last = many[order[: active[j]]] == j + 1
        after = block + ~last  # a last block stands for itself
        label[block] = np.where(last, ends[block], back[label[after], after])

    out = np.zeros(len(emitted), np.int32)
    for t in range(BLOCK - 1, -1, -1):
        out[at[t, inside[t]]] = label[inside[t]]
        label = np.where(switched[t, label, every], best[t], label)
    return out


def _side_by_side(emitted: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Texts go side by side, the longest ahead."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, longest = first[:-1][order], int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(1, longest + 1), "right")  # texts of t + 1 words or more
    came = np.zeros((len(emitted), emitted.shape[1]), bool)  # whether the best way to a label switches
    best = np.zeros(len(emitted), np.int32)  # the best label up to each word
    out = np.zeros(len(emitted), np.int32)
    now = np.zeros((len(order), emitted.shape[1]))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        ways = now[:n]
        if t:
            top = ways.max(1, keepdims=True) - switch
            came[at] = ways < top
            np.maximum(ways, top, out=ways)
        ways += emitted[at]
        best[at] = ways.argmax(1)
        ways -= ways.max(1, keepdims=True)
    label = np.zeros(len(order), np.int32)
    for t in range(longest - 1, -1, -1):
        n, fresh = active[t], active[t + 1] if t + 1 < longest else 0
        at = begin[:n] + t
        label[fresh:n] = best[at[fresh:]]
        out[at] = label[:n]
        if t:
            label[:n] = np.where(came[at, label[:n]], best[at - 1], label[:n])
    return out


def label_words(texts: pa.Array, model: Model) -> Iterator[tuple[words.Run, np.ndarray]]:
    """Each run of texts with the label of every word."""
    for run in words.runs(texts, lower=True, letters=True, limit=max(1 << 14, (1 << 22) // (2 * max(4, len(model.languages))))):
        weights = model.weights[_trigrams(run, int(model.weights.shape[0]).bit_length() - 1)]
        sums = np.zeros((len(weights) + 1, weights.shape[1]))
        np.cumsum(weights, 0, out=sums[1:])
        emitted = sums[run.stop] - sums[run.start]
        may = model.allowed[_scripts(run)]
        emitted[~may & may.any(1, keepdims=True)] -= 1000.0
        emitted -= emitted.max(1, keepdims=True, initial=-np.inf)
        yield run, viterbi(emitted, run.first)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(model: Model, batch: pa.RecordBatch) -> tuple[list, list]:
    names, scores = [], []
    column = batch.column("text")
    if not model.languages:
        return [UNKNOWN] * len(column), [0.0] * len(column)
    for run, label in label_words(column, model):
        size = run.stop - run.start
        row = run.row_of_word()
        n = run.hi - run.lo
        letters = np.bincount(row * len(model.languages) + label, size, n * len(model.languages)).reshape(n, -1)
        for i, (a, top) in enumerate(zip(letters, letters.argmax(1).tolist(), strict=True)):
            total = a.sum()
            ok = total > 0 and _has_letter(column[run.lo + i].as_py() or "")
            names.append(model.languages[top] if ok else UNKNOWN)
            scores.append(float(a[top] / total) if ok else 0.0)
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of its letters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch)
            columns = [*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (~learnable(F.col("doc_id"))).alias("held_out"), "text")
    return rows.mapInArrow(run_all, "doc_id long, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per span: doc_id, lang, first_word (from 0), n_words; words are runs of letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for run, label in label_words(batch.column("text"), shared.value) if shared.value.languages else ():
                row = run.row_of_word()
                cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                columns = [
                    pa.array([ids[run.lo + r] for r in row[cut]], pa.int64()),
                    pa.array([shared.value.languages[x] for x in label[cut]], pa.string()),
                    pa.array((cut - run.first[row[cut]]).astype(np.int64)),
                    pa.array(np.diff(np.append(cut, len(label))).astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "first_word", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run_all, "doc_id long, lang string, first_word long, n_words long")
