"""Document fingerprints: canonical exact digests, checked byte by byte.

A text is canonicalised (NFKC, full case folding, white space folded to one
space and trimmed) and hashed to 128 bits with two seeds of xxhash64.  Texts
with one digest form a bucket; inside a bucket the canonical bytes are compared,
and a bucket that holds different bytes gets a suffix in its fingerprints, so
equal fingerprints always mean equal canonical texts.

Everything is DataFrame functions.  Normalisation and folding are the static
methods of the ICU library that ships with Spark, called through ``reflect``.

Defined results: a null text counts as empty; repeated rows and equal doc_ids
keep their rows; a null doc_id sorts after every other one; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digests that hold different canonical texts are broadcast up to this many, joined by shuffle beyond.
MAX_BROADCAST_COLLISIONS = 10_000


def canonical(text: Column) -> Column:
    def nfkc(t: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))

    folded = F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True)
    )
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """Two xxhash64 words under different seeds, as one struct."""
    return F.struct(F.xxhash64(F.lit(1), canon).alias("a"), F.xxhash64(F.lit(2), canon).alias("b"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per digest: a, b, group_id (smallest doc_id), n_copies, collided.

    The texts are combined before the shuffle, so a text that a third of all rows
    share crosses it once per task.  ``collided`` tells that the smallest and the
    largest canonical text of the bucket differ in their bytes.
    """
    rows = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    rows = rows.select("doc_id", "canon", digest(F.col("canon")).alias("d"))
    return (
        rows.groupBy(F.col("d.a").alias("a"), F.col("d.b").alias("b"))
        .agg(
            F.min("doc_id").alias("group_id"),
            F.count(F.lit(1)).alias("n_copies"),
            F.collect_set("canon").alias("texts"),
        )
        .select("a", "b", "group_id", "n_copies", (F.size("texts") > 1).alias("collided"))
    )


def _name(d: str) -> Column:
    return F.concat(*[F.lpad(F.hex(F.col(f"{d}.{k}")), 16, "0") for k in "ab"])


def name_fingerprints(rows: DataFrame, collided: DataFrame, n_collided: int, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds string columns ``pairs`` = {new column: (digest column, text column)}.

    A collided digest is followed by a SHA-256 of the canonical text.
    """
    for new, (d, text) in pairs.items():
        if not n_collided:
            rows = rows.withColumn(new, _name(d))
            continue
        marks = collided.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_hit"))
        marks = F.broadcast(marks) if n_collided <= MAX_BROADCAST_COLLISIONS else marks
        rows = rows.join(marks, (F.col(f"{d}.a") == F.col("_a")) & (F.col(f"{d}.b") == F.col("_b")), "left")
        suffix = F.when(F.col("_hit"), F.concat(F.lit("-"), F.sha2(canonical(F.col(text)), 256))).otherwise(F.lit(""))
        rows = rows.withColumn(new, F.concat(_name(d), suffix)).drop("_a", "_b", "_hit")
    return rows


def likeness(d1: str, t1: str, d2: str, t2: str) -> Column:
    """1 where the digests and then the canonical bytes agree, else 0."""
    same = F.col(d1) == F.col(d2)
    return F.when(same, (canonical(F.col(t1)) == canonical(F.col(t2))).cast("double")).otherwise(F.lit(0.0))


def with_next(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (doc_id, text, d) with next_text, next_d: the row after it by descending doc_id, the first after the last.

    doc_id is cut into ranges at its quantiles.  Each range is one window, and it
    gets a copy of the first row of the following range, so the texts cross one
    shuffle and no window holds the table.  Ties go by descending text.
    """
    low = F.lit(-(2**63)).cast("bigint")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", low).alias("_k"))
    cuts = rows.agg(F.percentile_approx("_k", [i / n_buckets for i in range(1, n_buckets)], 100 * n_buckets)).first()[0]
    cuts = sorted(set(cuts or []))
    # The range of a key is the number of cuts below it, so all rows of one key fall in one range.
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_k"))) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    # The heads are bounded by the number of ranges.
    heads = sorted((r["_bucket"], r["k"]) for r in rows.groupBy("_bucket").agg(F.max("_k").alias("k")).collect())
    guests = [(after, heads[i - 1][1]) for i, (after, _) in enumerate(heads)]  # of the range below; the top one's go to the lowest
    rows = rows.withColumn("_turn", F.lit(0))
    if guests:
        to = F.create_map(*[F.lit(x) for after, k in guests for x in (k, after)])
        visiting = (
            rows.where(F.col("_k").isin([k for _, k in guests]))
            .withColumn("_bucket", F.element_at(to, F.col("_k")))
            .withColumn("_turn", F.lit(1))
        )
        rows = rows.unionByName(visiting)
    rows = rows.withColumn("d", digest(canonical(F.col("text"))))
    w = Window.partitionBy("_bucket").orderBy("_turn", F.col("_k").desc(), F.col("text").desc())
    return (
        rows.withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_d", F.lead("d").over(w))
        .where(F.col("_turn") == 0)
        .select("doc_id", "text", "d", "next_text", "next_d")
    )


def edited_likeness(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    collided = exact_groups(docs).where("collided").select("a", "b").persist()
    n_collided = collided.count()
    rows = with_next(docs, n_buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    )
    rows = rows.withColumn("edited_d", digest(canonical(F.col("edited"))))
    rows = name_fingerprints(
        rows, collided, n_collided, {"fingerprint": ("d", "text"), "edited_fingerprint": ("edited_d", "edited")}
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("d", "text", "edited_d", "edited").alias("near_edited"),
        likeness("d", "text", "next_d", "next_text").alias("near_next"),
    )
