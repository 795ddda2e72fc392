"""Secret scans: base patterns, and weak candidates linked across their parts.

``split`` gives the lengths of the text between matches and ``regexp_extract_all``
the matches; each match becomes a row (the texts don't cross the network), and
running sums over a document's matches are their positions.  Identifiers, secrets and
endpoints are then joined by interval within a scope: two parts meet if at most
``SCOPE`` code points lie between them.  Over the parts of a document sorted by their
starts, the furthest end so far and the next start to come tell whether a
complementary part is that near, so the interval join is a few running windows and
takes time linear in the parts.

Weak candidates are reported only where the complementary parts meet:
an ``ident`` or a ``weak`` secret with each other's side, an ``endpoint`` with both.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; rows with one doc_id are told apart by a hash of their text; a null doc_id
counts as a value; an empty table gives an empty result; other columns are passed
through by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.scratch import store

# The base patterns of the contract, with the fewest characters that count.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")

#: Parts that count only together.
IDENT = r"""(?:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
SCOPE = 200


#: Documents with spans are broadcast to be redacted up to this many, and joined by shuffle beyond.
MAX_BROADCAST = 10_000
MANY_CUTS = 100


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (kind, nth, gap before, size, ok) for the matches of pattern; keep: a condition on the match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gap"))
    # One gap more than matches: the last has none.
    each = F.transform(
        F.filter(parts, lambda p: p["found"].isNotNull()),
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), p["gap"].alias("gap"), F.length(p["found"]).alias("size"),
            (keep(p["found"]) if keep else F.lit(True)).alias("ok"),
        ),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,ok:boolean>>"))


def _every_match(text: Column) -> Column:
    """The matches of all kinds; base ones are leftmost and don't overlap within a kind."""
    value = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return F.flatten(
        F.array(
            _matches(text, "(?i)" + ASSIGN, 0, lambda m: F.length(F.regexp_replace(m, value, "")) >= ASSIGN_MIN),
            # A match is the longest run from its start, so asking for the length in the pattern finds the same spans.
            _matches(text, ACCESS.replace("+", "{%d,}" % (ACCESS_MIN - 4)), 1),
            _matches(text, HEX.replace("+", "{%d,}" % HEX_MIN), 2),
            _matches(text, "(?i)" + IDENT, 3),
            _matches(text, WEAK, 4, mixed),
            _matches(text, ENDPOINT, 5),
        )
    )


def _until(kinds: list[int], what: str, largest: bool, window) -> Column:
    of = F.when(F.col("kind").isin(kinds), F.col(what))
    return (F.max(of) if largest else F.min(of)).over(window)


def _near(kinds: list[int], reach: int) -> Column:
    """Whether a part of those kinds, none of them its own, is at most reach code points away; -1: overlaps."""
    doc = Window.partitionBy("doc_id", "t")
    so_far = doc.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = doc.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end, start = _until(kinds, "end", True, so_far), _until(kinds, "start", False, to_come)
    return F.coalesce(end >= F.col("start") - reach, F.lit(False)) | F.coalesce(start <= F.col("end") + reach, F.lit(False))


def spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, t (hash of the text), text without nulls.  Rows (doc_id, t, kind, start, end) of all reported spans."""
    found = docs.select("doc_id", "t", F.explode(_every_match(F.col("text"))).alias("m"))
    # Repeated rows find the same matches; the set has them once.
    found = found.groupBy("doc_id", "t").agg(F.collect_set("m").alias("m")).select("doc_id", "t", F.explode("m").alias("m")).select("doc_id", "t", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "t", "kind").orderBy("nth")).cast("int")
    parts = found.withColumn("end", end).where("ok").select("doc_id", "t", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    base, kind = F.col("kind") <= 2, F.col("kind")
    # A weak part inside a base span, or a weak secret inside an identifier, says nothing new.
    inside = F.when(kind == 4, _near([0, 1, 2, 3], -1)).otherwise(_near([0, 1, 2], -1))
    parts = parts.withColumn("inside", inside).where(base | ~F.col("inside")).drop("inside")
    ids, keys, ends = _near([1, 3], SCOPE), _near([0, 2, 4], SCOPE), _near([5], SCOPE)
    meets = F.when(kind == 3, keys).when(kind == 4, ids | ends).when(kind == 5, ids & keys)
    return parts.withColumn("meets", meets).where(base | F.col("meets")).drop("meets")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))


def _told(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, joined by commas)."""
    rows = _keyed(docs)
    span, base = F.struct("start", "kind", "end"), F.col("kind") <= 2
    lists = spans(rows).groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("every"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = rows.select("doc_id", "t").join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_told(F.coalesce("base", none)), 256).alias("base_sha256"),
        _told(F.coalesce("every", none)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mark, spans that overlap by one; other documents stay as they are."""
    names = docs.columns
    doc = Window.partitionBy("doc_id", "t").orderBy("start", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans(_keyed(docs)).withColumn("before", F.coalesce(before, F.lit(0)))
    # A span starts anew where all before it ended; what lies between is kept.
    rows = rows.withColumn("anew", (F.col("start") >= F.col("before")).cast("int")).withColumn("n", F.sum("anew").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = rows.groupBy("doc_id", "t", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = merged.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    lists = store(lists, "secrets")
    lists = F.broadcast(lists) if lists.count() <= MAX_BROADCAST and lists.where(F.size("_cuts") > MANY_CUTS).isEmpty() else lists
    inner = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    inner = inner.join(lists, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_t")), "left")
    text, cuts = F.col("_text"), F.col("_cuts")
    after = lambda i: F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
    part = lambda of: F.transform(cuts, lambda c, i: of(after(i) + 1, c["start"] - after(i)))
    # substring counts from the start of the text each time; with many cuts its characters are listed once.
    listed = F.transform(F.array(F.split(text, "")), lambda chars: part(lambda at, n: F.array_join(F.slice(chars, at, n), "")))
    kept = F.when(F.size(cuts) > MANY_CUTS, F.get(listed, 0)).otherwise(part(lambda at, n: F.substring(text, at, n)))
    rest = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
    hit = cuts.isNotNull()
    found = inner.withColumn("_clean", F.when(hit, F.array_join(F.concat(kept, F.array(rest)), mark)))
    new = {"text": F.when(hit, F.col("_clean")).otherwise(F.col("_row.text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(hit, F.length("_clean").cast("bigint")).otherwise(F.col("_row.n_chars"))
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])
